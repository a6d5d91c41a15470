"""The test tables in the roles of the source tables.

The expressions below are plain enough to read the same in Spark and DuckDB, so
each role is written once and both engines derive it from the same whole table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "(SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) AS e"

# role: (columns, from/where)
ROLES = {
    "edstays": (
        [
            "user_id AS subject_id",
            "CASE WHEN k < 40 THEN event_id END AS hadm_id",
            "event_id AS stay_id",
            "ts AS intime",
            "ts + INTERVAL 4 HOUR AS outtime",
            "CASE WHEN k >= 95 THEN 'EXPIRED' WHEN k < 40 THEN 'ADMITTED' ELSE 'HOME' END AS disposition",
            "CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
            "concat('group ', CAST(k % 5 AS VARCHAR(3))) AS race",
            "CASE WHEN k % 3 = 0 THEN 'WALK IN' WHEN k % 3 = 1 THEN 'AMBULANCE' END AS arrival_transport",
        ],
        f"{EVENTS} WHERE event_type = 'signup'",
    ),
    "patients": (
        [
            "c_custkey AS subject_id",
            "CAST(18 + 3 * c_nationkey AS BIGINT) AS anchor_age",
            "CAST(2168 + c_nationkey AS BIGINT) AS anchor_year",
        ],
        "customer",
    ),
    "topics": (
        [
            "user_id AS subject_id",
            "event_id AS stay_id",
            "c_mktsegment AS cc_system",
            "p_name AS chiefcomplaint_proc",
            "CAST(k % 20 - 1 AS INT) AS cc_topic",
            "concat(p_name, ', ', p_type) AS cc_keywords",
        ],
        f"{EVENTS} JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = k WHERE event_type = 'signup'",
    ),
    "triage": (
        [
            "user_id AS subject_id",
            "event_id AS stay_id",
            "CAST(1 + k % 5 AS DOUBLE) AS acuity",
            "CASE WHEN k % 7 = 0 THEN 'uta' ELSE CAST(k % 11 AS VARCHAR(3)) END AS pain",
        ],
        f"{EVENTS} WHERE event_type = 'signup'",
    ),
    "vitalsign": (
        [
            "user_id AS subject_id",
            "ts AS charttime",
            "80 + value AS sbp",
            "CASE WHEN k % 9 <> 0 THEN 40 + value END AS dbp",
            "60 + 2 * value AS heartrate",
            "CASE WHEN k % 4 <> 0 THEN CAST(10 + k AS DOUBLE) END AS resprate",
            "CAST(100 - k AS DOUBLE) AS o2sat",
            "35 + value / 50 AS temperature",
        ],
        f"{EVENTS} WHERE event_type <> 'signup'",
    ),
    "labevents": (
        [
            "user_id AS subject_id",
            "k AS itemid",
            "ts AS charttime",
            "CASE WHEN value >= 5 THEN value END AS valuenum",
            "event_type AS valueuom",
            "event_id AS labevent_id",
        ],
        f"{EVENTS} WHERE event_type <> 'signup'",
    ),
    "d_labitems": (["p_partkey AS itemid", "p_name AS label"], "part"),
    "admissions": (
        ["o_orderkey AS hadm_id", "CAST(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS BIGINT) AS hospital_expire_flag"],
        "orders",
    ),
    "icustays": (
        [
            "event_id AS hadm_id",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN ts + INTERVAL 3 HOUR "
            "WHEN o_orderpriority = '2-HIGH' THEN ts + INTERVAL 24 HOUR ELSE ts + INTERVAL 30 HOUR END AS intime",
        ],
        f"{EVENTS} JOIN orders ON o_orderkey = event_id WHERE event_type = 'signup' AND o_orderstatus = 'F'",
    ),
    "procedureevents": (
        ["user_id AS subject_id", "k AS itemid", "ts AS starttime"],
        f"{EVENTS} WHERE event_type = 'error'",
    ),
    "inputevents": (
        ["user_id AS subject_id", "k AS itemid", "ts AS starttime"],
        f"{EVENTS} WHERE event_type = 'purchase'",
    ),
    # a free-text table: documents with topic numbers, some blank and some masked texts
    "notes": (
        [
            "doc_id",
            "CAST(doc_id % 9 - 1 AS INT) AS topic",
            "text",
            "CASE WHEN n_chars % 10 = 0 THEN '   ' WHEN n_chars % 10 = 1 THEN NULL WHEN n_chars % 10 = 2 THEN ' ___ ____ ' "
            "WHEN n_chars % 10 < 6 THEN replace(text, ' the ', ' ___ ') ELSE text END AS raw",
        ],
        "documents",
    ),
    # a deterministic score in three windows, with many ties, for the metrics
    "scores": (
        [
            "d.doc_id",
            "d.lang",
            "quality AS label",
            "w AS time_window",
            "(d.n_chars * f % 97) / 203.0e0 AS score",
        ],
        "documents d JOIN labels l ON l.doc_id = d.doc_id "
        "JOIN (SELECT '0.5h' AS w, 1 AS f UNION ALL SELECT '1h', 5 UNION ALL SELECT '2h', 11) x ON x.f > 0",
    ),
}

# the shorter lists that stand for item codes, subgroups and lab categories here
SUBGROUPS = ["BUILDING", "MACHINERY", "AUTOMOBILE"]
VENT_ITEMS = [7, 14, 21, 28]
PRESSOR_ITEMS = [3, 33, 43, 53, 63, 73]
CATEGORIES = [
    ("hot widget", "WBC", "wbc"),
    ("widget", "Hemoglobin", "hb"),
    ("ring", "Platelet", "plt"),
    ("bolt", "Creatinine", "cr"),
    ("plate", "Sodium", "na"),
    ("rod", "Potassium", "k"),
    ("gear", "Bicarbonate", "hco3"),
    ("gizmo", "Lactate", "lactate"),
    ("red", "Glucose", "glucose"),
]
WINDOWS = {"0.5h": 0.5, "2h": 2.0, "24h": 24.0}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def role(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One source table derived from the test tables."""
    if name == "scores":
        return _scores(spark, folder)
    columns, source = ROLES[name]
    text, _, where = source.partition(" WHERE ")
    parts = text.split(" JOIN ")
    df = load(spark, folder, "events" if parts[0] == EVENTS else parts[0])
    if parts[0] == EVENTS:
        df = df.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    for part in parts[1:]:
        table, _, condition = part.partition(" ON ")
        df = df.join(load(spark, folder, table), F.expr(condition))
    if where:
        df = df.filter(F.expr(where))
    return df.selectExpr(*columns)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id")
    windows = F.array(
        *[F.struct(F.lit(w).alias("time_window"), F.lit(f).alias("f")) for w, f in (("0.5h", 1), ("1h", 5), ("2h", 11))]
    )
    return docs.select("doc_id", "lang", F.col("quality").alias("label"), "n_chars", F.inline(windows)).selectExpr(
        "doc_id", "lang", "label", "time_window", "(n_chars * f % 97) / 203.0D AS score"
    )


def roles(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: role(spark, folder, n) for n in names}


def sql_with(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the roles it reads (and further named subqueries) as a WITH list."""
    parts = [f"{n} AS (SELECT {', '.join(ROLES[n][0])} FROM {ROLES[n][1]})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def quoted(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
