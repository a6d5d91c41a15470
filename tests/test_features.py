"""Edge cases of joins, windows, labels and casts on hand-made rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    admission_label, any_flag, binary_entropy, clip_upper, measured, null_tokens, to_number,
)
from tidemark.functions.times import epoch_seconds, parse_timestamp
from tidemark.operators.columns import exclude_matching, features_containing, present, require_columns
from tidemark.operators.intervals import first_in_window, interval_join, window_extremes, windowed_first_values
from tidemark.operators.joins import lookup_default, lookup_left
from tidemark.operators.rules import like_ladder
from tidemark.plans import encounters

T0 = datetime(2024, 3, 1, 12, 0, 0)
US = timedelta(microseconds=1)
MIN = timedelta(minutes=1)


def stays(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, subject_id long, ed_intime timestamp_ntz")


def labs(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, charttime timestamp_ntz, tie long, cat string, v double")


def test_interval_bounds_are_closed(spark):
    events = labs(spark, [
        (1, T0 - 15 * MIN, 1, "a", 1.0), (1, T0 - 15 * MIN - US, 2, "a", 2.0), (1, T0 + 30 * MIN, 3, "a", 3.0),
        (1, T0 + 30 * MIN + US, 4, "a", 4.0), (1, None, 5, "a", 5.0), (None, T0, 6, "a", 6.0), (2, T0, 7, "a", 7.0),
    ])
    anchors = stays(spark, [(10, 1, T0), (11, 1, T0 + MIN), (12, 3, T0), (13, 2, None)])
    got = interval_join(anchors, events, "subject_id", "ed_intime", "charttime", 900, 1800)
    assert sorted((r.stay_id, r.tie) for r in got.collect()) == [(10, 1), (10, 3), (11, 3), (11, 4)]


def test_first_value_ties_and_narrow_windows(spark):
    events = labs(spark, [
        (1, T0 + 40 * MIN, 9, "a", 9.0), (1, T0 + 40 * MIN, 2, "a", 2.0), (1, T0 + 50 * MIN, 1, "a", 1.0),
        (1, T0 - 15 * MIN, 5, "b", 5.0), (1, T0 + 120 * MIN, 6, "c", 6.0), (1, T0 + 120 * MIN + US, 7, "d", 7.0),
    ])
    anchors = stays(spark, [(10, 1, T0), (11, 2, T0)])
    found = first_in_window(anchors, events, "stay_id", "subject_id", "ed_intime", "charttime", "tie", "cat",
                            ["a", "b", "c", "d"], 900, 7200, "v")
    wide = windowed_first_values(found, anchors, "stay_id", "ed_intime", ["a", "b", "c", "d"],
                                 {"0.5h": 1800, "2h": 7200})
    got = {(r.stay_id, r.time_window): (r.a, r.b, r.c, r.d, r.has_event) for r in wide.collect()}
    assert got[10, "0.5h"] == (None, 5.0, None, None, True)
    assert got[10, "2h"] == (2.0, 5.0, 6.0, None, True)
    assert got[11, "2h"] == (None, None, None, None, False)


def brute_force(anchors, events, lower, upper):
    out = {}
    for a, s, t in anchors:
        hits = [v for s2, at, _, _, v in events if s2 == s and t - lower <= at <= t + upper]
        if hits:
            out[a] = (len(hits), min(hits), max(hits))
    return out


def test_extremes_match_brute_force_for_a_hot_subject(spark):
    rng = random.Random(7)
    events = [(1 if rng.random() < 0.7 else rng.randint(2, 5), T0 + timedelta(seconds=rng.randint(-9000, 90000)), i, "a",
               float(rng.randint(0, 500))) for i in range(600)]
    anchors = [(i, 1 if i % 2 else rng.randint(2, 6), T0 + timedelta(seconds=rng.randint(-9000, 90000))) for i in range(80)]
    windows = {"a": 1800, "b": 7200}
    got = window_extremes(stays(spark, anchors), labs(spark, events), "stay_id", "subject_id", "ed_intime", "charttime",
                          900, windows, {"lo": F.col("v")}, {"hi": F.col("v")}).collect()
    for w, secs in windows.items():
        mine = {r.stay_id: (r.n_events, r.lo, r.hi) for r in got if r.time_window == w}
        assert mine == brute_force(anchors, events, timedelta(minutes=15), timedelta(seconds=secs))


def test_first_in_window_matches_brute_force(spark):
    rng = random.Random(3)
    events = [(rng.choice([1, 1, 2]), T0 + timedelta(seconds=rng.randint(0, 40000)), i, rng.choice("ab"), float(i))
              for i in range(300)]
    anchors = [(i, rng.choice([1, 2, 3]), T0 + timedelta(seconds=rng.randint(0, 40000))) for i in range(60)]
    found = first_in_window(stays(spark, anchors), labs(spark, events), "stay_id", "subject_id", "ed_intime", "charttime",
                            "tie", "cat", ["a", "b"], 600, 3600, "v").collect()
    for r in found:
        _, s, t = anchors[r.stay_id]
        for name, cat in (("c0", "a"), ("c1", "b")):
            hits = sorted((at, tie) for s2, at, tie, c, _ in events
                          if s2 == s and c == cat and t - timedelta(seconds=600) <= at <= t + timedelta(seconds=3600))
            assert (r[name].tie if r[name] else None) == (hits[0][1] if hits else None)


def test_events_far_from_every_anchor_are_left_out_before_they_are_sorted(spark):
    """The semi join on the cells of the anchors stands below the windows, and null keys and times stay out."""
    events = labs(spark, [(1, T0, 1, "a", 1.0), (1, T0 + timedelta(days=9), 2, "a", 2.0), (None, T0, 3, "a", 3.0), (1, None, 4, "a", 4.0)])
    anchors = stays(spark, [(10, 1, T0), (11, None, T0), (12, 1, None), (13, 1, T0 + timedelta(days=9, hours=5))])
    args = ("stay_id", "subject_id", "ed_intime", "charttime")
    found = first_in_window(anchors, events, *args, "tie", "cat", ["a"], 900, 7200, "v")
    assert {r.stay_id: r.c0 and r.c0.tie for r in found.collect()} == {10: 1, 11: None, 12: None, 13: None}
    extremes = window_extremes(anchors, events, *args, 900, {"a": 1800, "b": 7200}, {"lo": F.col("v")}, {"hi": F.col("v")})
    assert sorted((r.stay_id, r.time_window, r.lo, r.n_events) for r in extremes.collect()) == [(10, "a", 1.0, 1), (10, "b", 1.0, 1)]
    for df in (found, extremes):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("LeftSemi") > plan.rindex("Window ")


def test_plans_have_no_pairing_of_anchors_and_events(spark):
    """The first-value job neither joins events to anchors nor uses a nested loop."""
    df = encounters.first_labs(
        stays(spark, [(1, 1, T0)]),
        spark.createDataFrame([(1, 5, T0, 1.0, "WBC")],
                              "subject_id long, itemid long, charttime timestamp_ntz, valuenum double, lab_category string"),
    )
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "charttime" not in "".join(l for l in plan.splitlines() if "Join" in l)


def test_epoch_seconds_before_1970_and_parse(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:59.5",), ("2024-13-01",), ("soon",), (None,)], "t string")
    got = [r.s for r in df.select(epoch_seconds(parse_timestamp(F.col("t"))).alias("s")).collect()]
    assert got == [-1, None, None, None]


def test_casts_and_null_tokens(spark):
    df = spark.createDataFrame([("",), ("NA",), ("NaN",), ("abc",), ("12",)], "t string")
    assert [r.n for r in df.select(to_number(null_tokens(F.col("t"))).alias("n")).collect()] == [None] * 4 + [12.0]


def test_clip_keeps_null_and_is_idempotent(spark):
    df = spark.createDataFrame([(30.0,), (30.1,), (None,), (float("nan"),)], "x double")
    once = df.select(clip_upper(F.col("x"), 30.0).alias("x"))
    assert [r.x for r in once.collect()] == [30.0, 30.0, None, 30.0]
    assert once.select(clip_upper(F.col("x"), 30.0).alias("x")).collect() == once.collect()


def test_admission_label(spark):
    df = spark.createDataFrame(
        [(1, None, "HOME"), (None, None, "EXPIRED"), (None, None, "HOME"), (None, 1, None), (None, 0, None)],
        "h long, e long, d string",
    )
    assert [r[0] for r in df.select(admission_label(F.col("h"), F.col("e"), F.col("d"))).collect()] == [1, 1, 0, 1, 0]


def test_flags_entropy_and_ladder(spark):
    df = spark.createDataFrame([(0, 0, None, "HEMOGLOBIN A1c glucose"), (0, 1, 2.0, "lipase")], "a int, b int, x double, l string")
    row = df.select(any_flag([F.col("a"), F.col("b")]), measured(F.col("x")),
                    like_ladder(F.col("l"), [("hemoglobin", "Hb"), ("glucose", "Glu")])).collect()
    assert [tuple(r) for r in row] == [(0, 0, "Hb"), (1, 1, "Other")]
    edge = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double").select(binary_entropy(F.col("p")).alias("e"))
    values = [r.e for r in edge.collect()]
    assert all(abs(v) < 1e-6 for v in values[:2]) and abs(values[2] - 1) < 1e-6


def test_outcomes_bounds_and_null_admission(spark):
    base = spark.createDataFrame(
        [(1, 10, 100, T0), (2, 20, None, T0), (3, 30, 300, T0), (4, 40, 400, T0)],
        "subject_id long, stay_id long, hadm_id long, ed_intime timestamp_ntz",
    )
    icu = spark.createDataFrame([(100, T0 + timedelta(hours=24)), (300, T0 + timedelta(hours=24) + US)], "hadm_id long, intime timestamp_ntz")
    vent = spark.createDataFrame([(1, 225792, T0 + 5 * MIN), (2, 225794, T0)], "subject_id long, itemid long, starttime timestamp_ntz")
    press = spark.createDataFrame([(3, 221906, T0 - US)], "subject_id long, itemid long, starttime timestamp_ntz")
    adm = spark.createDataFrame([(400, 1), (100, 0)], "hadm_id long, hospital_expire_flag long")
    got = {r.stay_id: tuple(r)[2:] for r in encounters.outcomes(base, icu, vent, press, adm).collect()}
    assert got == {10: (1, 1, 0, 0, 1), 20: (0, 0, 0, 0, 0), 30: (0, 0, 0, 0, 0), 40: (0, 0, 0, 1, 1)}


def test_measured_flag_null_without_any_lab(spark):
    base = stays(spark, [(1, 1, T0), (2, 2, T0)])
    events = spark.createDataFrame([(1, 7, T0, 1.0, "Glucose")],
                                   "subject_id long, itemid long, charttime timestamp_ntz, valuenum double, lab_category string")
    got = base.join(encounters.first_labs(base, events, {"1h": 1.0}), "stay_id", "left").orderBy("stay_id").collect()
    assert (got[0].wbc_measured, got[0].glucose, got[1].wbc_measured) == (0, 1.0, None)


def test_lookup_joins(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, k long")
    table = spark.createDataFrame([(5, "x"), (None, "never")], "k long, v string")
    assert {r.id: r.v for r in lookup_left(rows, table, "k", "id").collect()} == {1: "x", 2: None, 3: None}
    assert {r.id: r.v for r in lookup_default(rows, table, "k", {"v": "d"}).collect()} == {1: "x", 2: "d", 3: "d"}


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, b_right int")
    assert exclude_matching(df, r"^.*_right$").columns == ["a", "b"]
    assert present(df, ["b", "z"]) == ["b"] and features_containing(["anchor_age", "sbp"], ["age"]) == ["anchor_age"]
    try:
        require_columns(df, ["z"])
        raise AssertionError("no error")
    except ValueError as e:
        assert "z" in str(e)
