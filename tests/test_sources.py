"""Readers, writers, rule tables and the sweep loop."""

import csv
import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sweep
from tidemark.plans import tuning
from tidemark.sources import rules, sinks, tables


def test_convert_once_with_null_tokens(spark, tmp_path):
    (tmp_path / "b" / "deep").mkdir(parents=True)
    (tmp_path / "a").mkdir()
    text = "itemid,label,extra\n1,Sodium,x\n2,NA,y\n3.0,\"a, b\",z\nbad,NaN,w\n"
    (tmp_path / "b" / "deep" / "d_labitems.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b" / "d_labitems.csv.bak").write_text("no")
    folders, out = [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "out")
    path = tables.ensure_parquet(spark, "d_labitems", folders, out)
    got = sorted((r.itemid or 0, r.label) for r in spark.read.parquet(path).collect())
    assert got[0][0] == 0 and got[1:] == [(1, "Sodium"), (2, None), (3, "a, b")] and got[0][1] is None
    assert tables.ensure_parquet(spark, "d_labitems", [], out) == path
    with pytest.raises(FileNotFoundError):
        tables.ensure_parquet(spark, "triage", folders, out)


def test_typed_timestamps(spark):
    raw = spark.createDataFrame([("1", "2180-01-01 10:00:00"), ("2", "NA"), ("3", "??")], "hadm_id string, intime string")
    got = tables.typed(raw, tables.SCHEMAS["icustays"]).collect()
    assert got[0].intime.year == 2180 and got[1].intime is None and got[2].intime is None


def test_projection_reaches_the_scan(spark, folder):
    plan = tables.read_table(spark, f"{folder}/lineitem.parquet", ["l_orderkey"]).filter("l_quantity > 5 or true")
    text = tables.read_table(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 5")
    shown = text._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,5.0)]" in shown and "l_tax" not in shown
    assert plan.columns == ["l_orderkey"]


def test_sinks_and_resume(spark, tmp_path):
    work = sweep.combinations(spark, [5, 10], [2, 3])
    out = str(tmp_path / "m")
    sinks.append_metrics(work.filter("min_samples = 2").withColumn("composite_score", F.lit(1.0)), out)
    assert sorted(r.combo_id for r in sinks.finished_combinations(spark, out).collect()) == ["mcs10_ms2", "mcs5_ms2"]
    left = sweep.remaining(work, sinks.read_metrics(spark, out))
    assert sorted(r.combo_id for r in left.collect()) == ["mcs10_ms3", "mcs5_ms3"]
    sinks.write_csv(work, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    sinks.write_table(work, str(tmp_path / "t"), ["min_samples"], ["combo_id"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("min_samples = 3").count() == 2


def test_rule_table(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("priority,label,pattern\n2,B,two\n1,A,one\n1,A,ah \n")
    assert rules.read_rule_groups(spark, str(path)) == [("A", ["one", "ah "]), ("B", ["two"])]
    with pytest.raises(ValueError):
        rules.read_rule_groups(spark, str(path), most=2)


def test_sweep_stops_and_resumes(spark, tmp_path):
    rows = [(i, [float(i % 5), float(i % 3)], "fever" if i % 2 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, at array<double>, t string")
    out = str(tmp_path / "sweep")
    found = tuning.sweep_until(df, "at", "t", 1.0, out, stop_at=30.0, sizes=[5, 400], samples=[2, 4], phrases=["fever"])
    assert sorted(r.combo_id for r in found.collect()) == ["mcs5_ms2", "mcs5_ms4"]
    more = tuning.sweep_until(df, "at", "t", 1.0, out, stop_at=0, sizes=[5, 400], samples=[2, 4], phrases=["fever"])
    assert more.count() == 4
    assert sweep.first_reaching(more, 30.0).first().combo_id == "mcs5_ms2"


def test_line_end_in_a_field(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('itemid,label\n1,"two\nlines"\n2,ok\n')
    got = tables.read_csv(spark, str(path), tables.SCHEMAS["d_labitems"], multi_line=True).collect()
    assert sorted((r.itemid, r.label) for r in got) == [(1, "two\nlines"), (2, "ok")]


def test_line_ends_in_fields_of_files_read_in_parts(spark, tmp_path):
    rng = random.Random(11)
    pieces = ["a", "b c", ",", '"', "\n", "", "é", "\n\n", '""', "NA", " x"]
    for n, end in ((0, "\n"), (1, "\n"), (300, "\n"), (301, "\r\n")):
        rows = [[str(i), "".join(rng.choice(pieces) for _ in range(rng.randrange(6))), rng.choice(["", "p"])] for i in range(n)]
        rows += [[str(n + 1), "end\n" * 400, "p"]] * bool(n)
        path = tmp_path / f"t{n}.csv"
        with path.open("w", newline="") as file:
            out = csv.writer(file, lineterminator=end)
            out.writerow(["stay_id", "chiefcomplaint", "pain"])
            out.writerows(rows)
        schema = "stay_id long, chiefcomplaint string, pain string"
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        want = sorted(map(tuple, tables.typed(reader.csv(str(path)), schema).collect()), key=str)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
            df = tables.read_csv(spark, f"file://{path}", schema, multi_line=True)
            assert sorted(map(tuple, df.collect()), key=str) == want and len(want) == len(rows)
            assert n < 2 or spark.read.text(str(path)).rdd.getNumPartitions() > 3
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tables_are_found_on_any_file_system(spark, tmp_path):
    (tmp_path / "in" / "ed").mkdir(parents=True)
    (tmp_path / "in" / "ed" / "triage.csv").write_text('subject_id,stay_id,acuity,pain,chiefcomplaint\n1,2,3,4,"a\nb"\n')
    folders = [f"file://{tmp_path}/none", f"file://{tmp_path}/in"]
    path = tables.ensure_parquet(spark, "triage", folders, f"file://{tmp_path}/out")
    assert [r.chiefcomplaint for r in spark.read.parquet(path).collect()] == ["a\nb"]
    assert tables.ensure_parquet(spark, "triage", [], f"file://{tmp_path}/out") == path
    assert not tables.exists(spark, f"file://{tmp_path}/none") and list(tables.files_below(spark, f"file://{tmp_path}/none")) == []
