"""The relational job: written tables, and runs that go on where an earlier one ended."""

from pathlib import Path

from tidemark import clinical_values as values
from tidemark.plans import build, encounters
from tidemark.sources.tables import SCHEMAS

CSV = {
    "ed/edstays": "subject_id,hadm_id,stay_id,intime,outtime,disposition,gender,race,arrival_transport\n"
    "1,10,100,2180-01-01 10:00:00,2180-01-01 18:00:00,ADMITTED,F,X,WALK IN\n"
    "2,NA,200,2180-02-01 10:00:00,2180-02-01 12:00:00,HOME,M,Y,AMBULANCE\n"
    "3,NA,300,2180-02-01 10:00:00,2180-02-01 12:00:00,HOME,M,Y,AMBULANCE\n",
    "hosp/patients": "subject_id,anchor_age,anchor_year\n1,60,2179\n2,40,2181\n3,50,2180\n",
    "ed/triage": 'subject_id,stay_id,acuity,pain,chiefcomplaint\n1,100,2,5,"chest\npain"\n2,200,3,NA,cough\n',
    "ed/vitalsign": "stay_id,charttime,sbp,dbp,heartrate,resprate,o2sat,temperature\n"
    "100,2180-01-01 10:20:00,120,80,90,18,98,37\n100,2180-01-01 11:30:00,90,60,500,30,88,39\n",
    "hosp/labevents": "subject_id,itemid,charttime,valuenum,valueuom\n1,7,2180-01-01 10:30:00,2.5,mmol/L\n",
    "hosp/d_labitems": "itemid,label\n7,Lactate\n",
    "hosp/admissions": "hadm_id,hospital_expire_flag\n10,1\n",
    "icu/icustays": "hadm_id,intime\n10,2180-01-01 20:00:00\n",
    "icu/procedureevents": "subject_id,itemid,starttime\n",
    "icu/inputevents": "subject_id,itemid,starttime\n",
}


def test_job_writes_its_tables_and_skips_finished_ones(spark, tmp_path):
    for name, text in CSV.items():
        path = tmp_path / "mimic" / f"{name}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    group = list(values.COHORT_SUBGROUPS)[0]
    topics = spark.createDataFrame(
        [(1, 100, group, "chest pain", 4, "pain"), (2, 200, group, "cough", 1, "cough"), (3, 300, "none of these", "x", -1, "")],
        "subject_id long, stay_id long, cc_system string, chiefcomplaint_proc string, cc_topic int, cc_keywords string",
    )
    out = f"file://{tmp_path}/out"
    got = build.build_analysis(spark, f"file://{tmp_path}", topics, out)
    rows = sorted(map(str, (r.asDict().items() for r in got.select(sorted(got.columns)).collect())))
    source = {n: spark.read.parquet(f"{out}/sources/{n}.parquet") for n in SCHEMAS}
    want = encounters.analysis_tables({**source, "topics": topics})
    assert sorted(got.columns) == sorted(want.columns) and len(rows) == 2 * len(values.WINDOW_HOURS)
    assert rows == sorted(map(str, (r.asDict().items() for r in want.select(sorted(want.columns)).collect())))
    caps = {r.stay_id: r.heartrate_max for r in got.filter("time_window = '2h'").collect()}
    assert caps == {100: values.OUTLIER_CAPS["heartrate_max"], 200: None}

    folder = Path(tmp_path) / "out"
    written = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet") if p.is_file()}
    (folder / "analysis" / "_SUCCESS").unlink()  # as if the last step had been cut off
    again = build.build_analysis(spark, f"file://{tmp_path}", topics.limit(0), out)
    kept = {p: p.stat().st_mtime_ns for p in written if p.exists()}
    assert {p for p in kept if "analysis" not in p.parts} == {p for p in written if "analysis" not in p.parts}
    assert all(kept[p] == written[p] for p in kept if "analysis" not in p.parts) and again.count() == len(rows)
