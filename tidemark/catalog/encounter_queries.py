"""Cohort, window, outcome and finalising queries."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.standins import (
    CATEGORIES,
    PRESSOR_ITEMS,
    SUBGROUPS,
    VENT_ITEMS,
    WINDOWS,
    load,
    quoted,
    role,
    roles,
    sql_with,
)
from tidemark.functions.scalars import clip_upper, measured, null_tokens, to_number
from tidemark.functions.times import parse_timestamp
from tidemark.operators.aggregates import group_counts, pivot_first
from tidemark.operators.columns import exclude_matching, require_columns
from tidemark.operators.intervals import first_in_window, flag_within, interval_join, windowed_first_values
from tidemark.operators.joins import lookup_default
from tidemark.operators.rules import like_ladder
from tidemark.operators.sweep import remaining
from tidemark.plans import encounters
from tidemark.sources.tables import read_table, register

COHORT_SQL = f"""
    SELECT e.subject_id, e.stay_id, e.hadm_id, e.intime AS ed_intime, e.outtime AS ed_outtime, e.disposition,
           e.gender, e.race, e.arrival_transport, p.anchor_age, t.cc_system, t.chiefcomplaint_proc
    FROM edstays e JOIN patients p ON e.subject_id = p.subject_id
    JOIN topics t ON t.subject_id = e.subject_id AND t.stay_id = e.stay_id
    WHERE t.cc_system IN ({quoted(SUBGROUPS)})"""
LABEL_SQL = """
    SELECT b.*, CASE WHEN b.hadm_id IS NOT NULL THEN 1 WHEN coalesce(a.hospital_expire_flag, 0) = 1 THEN 1
                     WHEN b.disposition = 'EXPIRED' THEN 1 ELSE 0 END AS target_admit_or_expire
    FROM cohort b LEFT JOIN admissions a ON a.hadm_id = b.hadm_id"""
COHORT_ROLES = ["edstays", "patients", "topics", "admissions"]

WINDOW_ROWS = ", ".join(f"('{w}', INTERVAL {int(h * 60)} MINUTE)" for w, h in WINDOWS.items())
SPANS_SQL = f"SELECT * FROM (VALUES {WINDOW_ROWS}) v(time_window, span)"
VITALS_SQL = """
    SELECT b.stay_id, s.time_window, min(v.sbp) AS sbp_min, min(v.heartrate) AS heartrate_min,
           min(v.o2sat) AS o2sat_min, max(v.sbp) AS sbp_max, max(v.heartrate) AS heartrate_max,
           max(v.resprate) AS resprate_max, max(v.temperature) AS temperature_max
    FROM labelled b JOIN vitalsign v ON v.subject_id = b.subject_id CROSS JOIN spans s
    WHERE v.charttime >= b.ed_intime - INTERVAL 15 MINUTE AND v.charttime <= b.ed_intime + s.span
    GROUP BY 1, 2"""
LADDER_SQL = (
    "CASE " + " ".join(f"WHEN lower({{0}}) LIKE '%{n}%' THEN '{c}'" for n, c, _ in CATEGORIES) + " ELSE 'Other' END"
)
LAB_SQL = f"""
    SELECT b.stay_id, b.subject_id, l.itemid, d.label AS lab_name, l.charttime, l.valuenum, l.valueuom,
           {LADDER_SQL.format('d.label')} AS lab_category, s.time_window
    FROM labelled b JOIN labevents l ON l.subject_id = b.subject_id JOIN d_labitems d ON d.itemid = l.itemid
    CROSS JOIN spans s
    WHERE l.charttime >= b.ed_intime - INTERVAL 15 MINUTE AND l.charttime <= b.ed_intime + s.span
      AND l.valuenum IS NOT NULL"""
PIVOT_SQL = f"""
    SELECT stay_id, time_window, {', '.join(f"max(CASE WHEN lab_category = '{c}' THEN valuenum END) AS {n}" for _, c, n in CATEGORIES)}
    FROM (SELECT *, row_number() OVER (PARTITION BY stay_id, time_window, lab_category
                                       ORDER BY charttime, itemid, valuenum) AS rn
          FROM lab_rows WHERE lab_category <> 'Other')
    WHERE rn = 1 GROUP BY 1, 2"""
FLAG_SQL = ", ".join(
    f"CAST(CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END AS TINYINT) AS {n}_measured" for n in ("wbc", "hb", "plt", "cr", "lactate")
)
FIRST_SQL = f"SELECT *, {FLAG_SQL} FROM lab_wide"
OUTCOME_SQL = f"""
    SELECT b.stay_id, b.hadm_id,
      CAST(EXISTS (SELECT 1 FROM icustays i WHERE i.hadm_id = b.hadm_id AND i.intime >= b.ed_intime
                   AND i.intime <= b.ed_intime + INTERVAL 24 HOUR) AS INT) AS icu_24h,
      CAST(EXISTS (SELECT 1 FROM procedureevents p WHERE p.subject_id = b.subject_id AND p.itemid IN ({quoted(VENT_ITEMS)})
                   AND p.starttime >= b.ed_intime AND p.starttime <= b.ed_intime + INTERVAL 24 HOUR) AS INT) AS vent_24h,
      CAST(EXISTS (SELECT 1 FROM inputevents p WHERE p.subject_id = b.subject_id AND p.itemid IN ({quoted(PRESSOR_ITEMS)})
                   AND p.starttime >= b.ed_intime AND p.starttime <= b.ed_intime + INTERVAL 24 HOUR) AS INT) AS pressor_24h,
      CAST(EXISTS (SELECT 1 FROM admissions a WHERE a.hadm_id = b.hadm_id AND a.hospital_expire_flag = 1) AS INT) AS death_hosp
    FROM labelled b"""
COMPOSITE_SQL = """
    SELECT *, CASE WHEN icu_24h = 1 OR vent_24h = 1 OR pressor_24h = 1 OR death_hosp = 1 THEN 1 ELSE 0 END
              AS early_critical_illness FROM components"""
MASTER_SQL = """
    SELECT b.*, s.time_window, t.acuity AS triage_acuity, t.pain AS triage_pain, c.cc_topic, c.cc_keywords,
           v.* EXCLUDE (stay_id, time_window), l.* EXCLUDE (stay_id, time_window)
    FROM labelled b CROSS JOIN spans s
    LEFT JOIN triage t ON t.stay_id = b.stay_id LEFT JOIN topics c ON c.stay_id = b.stay_id
    LEFT JOIN vitals v ON v.stay_id = b.stay_id AND v.time_window = s.time_window
    LEFT JOIN labs l ON l.stay_id = b.stay_id AND l.time_window = s.time_window"""
FINAL_SQL = """
    SELECT m.* EXCLUDE (target_admit_or_expire) REPLACE (
             CASE WHEN lactate > 30.0 THEN 30.0 ELSE lactate END AS lactate,
             CASE WHEN heartrate_max > 300.0 THEN 300.0 ELSE heartrate_max END AS heartrate_max),
           o.early_critical_illness, o.icu_24h, o.death_hosp
    FROM master m JOIN outcome o ON o.stay_id = m.stay_id"""

LABELLED = {"cohort": COHORT_SQL, "labelled": LABEL_SQL, "spans": SPANS_SQL}
LABS = {**LABELLED, "lab_rows": LAB_SQL, "lab_wide": PIVOT_SQL}
MASTER = {**LABS, "vitals": VITALS_SQL, "labs": FIRST_SQL}
OUTCOME = {**LABELLED, "components": OUTCOME_SQL}
LAB_ROLES = [*COHORT_ROLES, "labevents", "d_labitems"]
MASTER_ROLES = [*LAB_ROLES, "vitalsign", "triage"]
OUTCOME_ROLES = [*COHORT_ROLES, "icustays", "procedureevents", "inputevents"]


def labelled(spark, sf):
    t = roles(spark, sf, *COHORT_ROLES)
    return encounters.cohort_labels(
        encounters.cohort(t["edstays"], t["patients"], t["topics"], SUBGROUPS), t["admissions"]
    )


def known_labs(spark, sf):
    return encounters.known_labs(role(spark, sf, "labevents"), role(spark, sf, "d_labitems"), CATEGORIES)


def master(spark, sf):
    base = labelled(spark, sf)
    t = roles(spark, sf, "vitalsign", "triage", "topics")
    return encounters.masters(
        base,
        encounters.vitals_summary(base, t["vitalsign"], WINDOWS, key="subject_id"),
        t["triage"], t["topics"],
        encounters.first_labs(base, known_labs(spark, sf), WINDOWS, categories=CATEGORIES),
        WINDOWS,
    )


def outcome(spark, sf):
    t = roles(spark, sf, "icustays", "procedureevents", "inputevents", "admissions")
    return encounters.outcomes(
        labelled(spark, sf), t["icustays"], t["procedureevents"], t["inputevents"], t["admissions"],
        VENT_ITEMS, PRESSOR_ITEMS,
    )


def analysis(spark, sf):
    names = [*COHORT_ROLES, "labevents", "d_labitems", "vitalsign", "triage", "icustays", "procedureevents", "inputevents"]
    return encounters.analysis_tables(
        roles(spark, sf, *names), SUBGROUPS, WINDOWS, CATEGORIES, VENT_ITEMS, PRESSOR_ITEMS, "subject_id"
    )


@query("cohort", sql_with(["edstays", "patients", "topics"], COHORT_SQL))
def _(spark, sf):
    t = roles(spark, sf, "edstays", "patients", "topics")
    return encounters.cohort(t["edstays"], t["patients"], t["topics"], SUBGROUPS)


@query("admit_label", sql_with(COHORT_ROLES, LABEL_SQL, {"cohort": COHORT_SQL}))
def _(spark, sf):
    return labelled(spark, sf)


@query("label_counts", sql_with(
    COHORT_ROLES, "SELECT target_admit_or_expire, count(*) AS n FROM labelled GROUP BY 1", LABELLED))
def _(spark, sf):
    return group_counts(labelled(spark, sf), "target_admit_or_expire")


@query("window_minmax", sql_with([*COHORT_ROLES, "vitalsign"], VITALS_SQL, LABELLED))
def _(spark, sf):
    return encounters.vitals_summary(labelled(spark, sf), role(spark, sf, "vitalsign"), WINDOWS, key="subject_id")


@query("category_ladder", f"SELECT p_partkey, p_name, {LADDER_SQL.format('p_name')} AS category FROM part")
def _(spark, sf):
    parts = read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_name"])
    return parts.withColumn("category", like_ladder(F.col("p_name"), [(n, c) for n, c, _ in CATEGORIES]))


@query("labs_in_window", sql_with(
    LAB_ROLES, "SELECT * EXCLUDE (time_window) FROM lab_rows WHERE time_window = '24h' AND lab_category <> 'Other'", LABS))
def _(spark, sf):
    return encounters.labs_in_window(labelled(spark, sf), known_labs(spark, sf), 24.0)


@query("first_in_window", sql_with(LAB_ROLES, PIVOT_SQL, LABS))
def _(spark, sf):
    names = [n for _, _, n in CATEGORIES]
    return encounters.first_labs(labelled(spark, sf), known_labs(spark, sf), WINDOWS, categories=CATEGORIES).select(
        "stay_id", "time_window", *names
    )


@query("measured_flags", sql_with(LAB_ROLES, f"SELECT stay_id, time_window, {FLAG_SQL} FROM lab_wide", LABS))
def _(spark, sf):
    labs = encounters.first_labs(labelled(spark, sf), known_labs(spark, sf), WINDOWS, categories=CATEGORIES)
    return labs.select("stay_id", "time_window", *[measured(F.col(n)).alias(f"{n}_measured") for n in ("wbc", "hb", "plt", "cr", "lactate")])


@query("window_pivot", """
    WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
         m AS (SELECT s.event_id, e.event_type, e.value,
                      row_number() OVER (PARTITION BY s.event_id, e.event_type ORDER BY e.ts, e.event_id) AS rn
               FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type <> 'signup'
               WHERE e.ts >= s.ts - INTERVAL 15 MINUTE AND e.ts <= s.ts + INTERVAL 24 HOUR)
    SELECT s.event_id, max(CASE WHEN event_type = 'click' THEN value END) AS click,
           max(CASE WHEN event_type = 'error' THEN value END) AS error,
           max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
           max(CASE WHEN event_type = 'view' THEN value END) AS view
    FROM s LEFT JOIN m ON m.event_id = s.event_id AND rn = 1 GROUP BY s.event_id""")
def _(spark, sf):
    events = load(spark, sf, "events")
    stays = events.filter(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    kinds = ["click", "error", "purchase", "view"]
    found = first_in_window(
        stays, events, "event_id", "user_id", "ts", "ts", "event_id", "event_type", kinds, 900, 86400, "value"
    )
    return windowed_first_values(found, stays, "event_id", "ts", kinds, {"24h": 86400}).drop("has_event", "time_window")


@query("shipments_near_order", """
    SELECT o_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_shipdate >= o_orderdate - INTERVAL 1 DAY AND l_shipdate <= o_orderdate + INTERVAL 30 DAY""")
def _(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderkey", "o_orderdate")
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_shipdate"
    )
    day = 86400
    return interval_join(orders, lines, "key", "o_orderdate", "l_shipdate", day, 30 * day).drop("key")


@query("first_value_pivot", """
    SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS first_a,
           max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS first_n,
           max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS first_r
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag
                                       ORDER BY l_shipdate, l_linenumber, l_extendedprice) AS rn FROM lineitem)
    WHERE rn = 1 GROUP BY l_orderkey""")
def _(spark, sf):
    lines = read_table(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_returnflag", "l_shipdate", "l_linenumber", "l_extendedprice"]
    )
    names = {"A": "first_a", "N": "first_n", "R": "first_r"}
    return pivot_first(lines, "l_orderkey", "l_returnflag", names, "l_shipdate", "l_linenumber", "l_extendedprice")


@query("multi_window_features", sql_with(MASTER_ROLES, MASTER_SQL, MASTER))
def _(spark, sf):
    return master(spark, sf)


@query("attribute_chain", sql_with(
    [*COHORT_ROLES, "triage"],
    "SELECT b.*, t.acuity AS triage_acuity, t.pain AS triage_pain, c.cc_topic, c.cc_keywords FROM labelled b "
    "LEFT JOIN triage t ON t.stay_id = b.stay_id LEFT JOIN topics c ON c.stay_id = b.stay_id", LABELLED))
def _(spark, sf):
    t = roles(spark, sf, "triage", "topics")
    arrival = t["triage"].select("stay_id", F.col("acuity").alias("triage_acuity"), F.col("pain").alias("triage_pain"))
    return labelled(spark, sf).join(arrival, "stay_id", "left").join(
        t["topics"].select("stay_id", "cc_topic", "cc_keywords"), "stay_id", "left"
    )


@query("event_within_24h", """
    SELECT s.event_id, CAST(max(CASE WHEN e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 24 HOUR THEN 1 ELSE 0 END) AS INT) AS purchase_24h
    FROM (SELECT * FROM events WHERE event_type = 'signup') s
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') e ON e.user_id = s.user_id GROUP BY s.event_id""")
def _(spark, sf):
    events = load(spark, sf, "events")
    stays = events.filter(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    found = first_in_window(
        stays, events, "event_id", "user_id", "ts", "ts", "event_id", "event_type", ["purchase"], 0, 86400
    )
    return found.select("event_id", flag_within(found, "c0").alias("purchase_24h"))


@query("composite_outcome", sql_with(OUTCOME_ROLES, COMPOSITE_SQL, OUTCOME))
def _(spark, sf):
    return outcome(spark, sf)


PREVALENCE_FLAGS = [*encounters.FLAGS, "early_critical_illness"]


@query("prevalence", sql_with(
    OUTCOME_ROLES,
    " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) AS n, CAST(sum({f}) AS BIGINT) AS n_positive, "
        f"round(sum({f}) / count(*) * 100, 6) AS percent FROM outcome" for f in PREVALENCE_FLAGS
    ),
    {**OUTCOME, "outcome": COMPOSITE_SQL}))
def _(spark, sf):
    return encounters.outcome_prevalence(outcome(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("final_table", sql_with(
    [*MASTER_ROLES, "icustays", "procedureevents", "inputevents"], FINAL_SQL,
    {**MASTER, "components": OUTCOME_SQL, "outcome": COMPOSITE_SQL, "master": MASTER_SQL}))
def _(spark, sf):
    return analysis(spark, sf)


@query("sorted_stays", sql_with(COHORT_ROLES, "SELECT stay_id, subject_id, ed_intime FROM labelled ORDER BY stay_id", LABELLED))
def _(spark, sf):
    return labelled(spark, sf).select("stay_id", "subject_id", "ed_intime").orderBy("stay_id")


@query("row_count", sql_with(COHORT_ROLES, "SELECT count(*) AS n FROM labelled", LABELLED))
def _(spark, sf):
    return labelled(spark, sf).agg(F.count("*").alias("n"))


@query("clip_outliers", "SELECT event_id, CASE WHEN value > 100.0 THEN 100.0 ELSE value END AS value FROM events")
def _(spark, sf):
    return load(spark, sf, "events").select("event_id", clip_upper(F.col("value"), 100.0).alias("value"))


@query("safe_cast", """
    WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'NA' WHEN event_id % 7 = 2 THEN 'NaN'
                      WHEN event_id % 7 = 3 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS num,
                      CASE WHEN event_id % 5 = 0 THEN '2024-13-45 10:00:00' WHEN event_id % 5 = 1 THEN 'NA'
                      WHEN event_id % 5 = 2 THEN 'soon' ELSE CAST(ts AS VARCHAR) END AS stamp FROM events)
    SELECT event_id, TRY_CAST(CASE WHEN num IN ('', 'NA', 'NaN') THEN NULL ELSE num END AS DOUBLE) AS number,
           TRY_CAST(CASE WHEN stamp IN ('', 'NA', 'NaN') THEN NULL ELSE stamp END AS TIMESTAMP) AS stamp FROM t""")
def _(spark, sf):
    texts = load(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'NA' WHEN event_id % 7 = 2 THEN 'NaN' "
        "WHEN event_id % 7 = 3 THEN 'abc' ELSE CAST(value AS STRING) END AS num",
        "CASE WHEN event_id % 5 = 0 THEN '2024-13-45 10:00:00' WHEN event_id % 5 = 1 THEN 'NA' "
        "WHEN event_id % 5 = 2 THEN 'soon' ELSE CAST(ts AS STRING) END AS stamp",
    )
    return texts.select(
        "event_id", to_number(null_tokens(F.col("num"))).alias("number"), parse_timestamp(null_tokens(F.col("stamp"))).alias("stamp")
    )


@query("projected_scan", "SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS price FROM lineitem")
def _(spark, sf):
    lines = read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return require_columns(lines, ["l_orderkey"]).withColumnsRenamed(
        {"l_orderkey": "order_id", "l_linenumber": "line", "l_extendedprice": "price"}
    )


@query("named_views", """
    SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 6) AS balance
    FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def _(spark, sf):
    register({"encounter_customers": load(spark, sf, "customer"), "encounter_nations": load(spark, sf, "nation")})
    return spark.sql(
        "SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 6) AS balance FROM encounter_customers "
        "JOIN encounter_nations ON n_nationkey = c_nationkey GROUP BY n_name"
    )


@query("drop_and_exclude", "SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    right = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey_right"), "c_mktsegment", F.col("c_name").alias("name_right")
    )
    orders = load(spark, sf, "orders").drop("not_there", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return exclude_matching(orders.join(right, F.col("o_custkey") == F.col("o_custkey_right")), r"^.*_right$")


@query("item_filter", f"SELECT event_id, user_id, ts FROM events WHERE CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) IN ({quoted(PRESSOR_ITEMS)}) AND event_type <> 'signup' AND value IS NOT NULL")
def _(spark, sf):
    events = load(spark, sf, "events").filter((F.col("event_type") != "signup") & F.col("value").isNotNull())
    item = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return events.filter(item.isin(PRESSOR_ITEMS)).select("event_id", "user_id", "ts")


@query("lookup_default", """
    SELECT o.o_orderkey, coalesce(c.segment, 'Unknown') AS segment, coalesce(c.balance, 0.0) AS balance
    FROM orders o LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS segment, c_acctbal AS balance FROM customer
                             WHERE c_mktsegment <> 'FURNITURE') c ON c.k = o.o_custkey""")
def _(spark, sf):
    table = load(spark, sf, "customer").filter(F.col("c_mktsegment") != "FURNITURE").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lookup_default(orders, table, "o_custkey", {"segment": "Unknown", "balance": 0.0}).drop("o_custkey")


@query("resume_antijoin", """
    SELECT DISTINCT 'mcs' || p_size || '_ms' || (p_partkey % 13) AS combo_id FROM part
    WHERE 'mcs' || p_size || '_ms' || (p_partkey % 13) NOT IN
          (SELECT 'mcs' || p_size || '_ms' || (p_partkey % 13) FROM part WHERE p_type = 'ECONOMY')""")
def _(spark, sf):
    combos = load(spark, sf, "part").select(
        F.concat(F.lit("mcs"), "p_size", F.lit("_ms"), (F.col("p_partkey") % 13).cast("string")).alias("combo_id"), "p_type"
    )
    done = combos.filter(F.col("p_type") == "ECONOMY")
    return remaining(combos.select("combo_id").distinct(), done)
