"""Split, preparation and evaluation queries."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.standins import load, role, sql_with
from tidemark.functions.scalars import binary_entropy
from tidemark.operators import evaluation, preparation, splits
from tidemark.operators.running import exact_percentiles, hash_sample

METRICS = ["auroc", "auprc", "brier", "spec_at_sens"]


def metrics_sql(groups: list[str], min_rows: int = 0, source: str = "scores") -> str:
    """Rank-sum AUROC and threshold-wise precision, independent of the running-count form."""
    g = ", ".join(groups)
    keys = f"{g}, " if groups else ""
    part = f"PARTITION BY {g}" if groups else ""
    match = " AND ".join(f"a.{x} = b.{x}" for x in groups) or "true"
    group_by = f"GROUP BY {g}" if groups else ""
    selected = "".join(f"a.{x}, " for x in groups)
    return f"""
      (WITH base AS (SELECT {keys}score, label FROM {source}),
      ranked AS (SELECT *, rank() OVER ({part} ORDER BY score)
                 + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2.0e0 AS r FROM base),
      one AS (SELECT {keys}count(*) AS n, sum(label) AS p, count(*) - sum(label) AS q,
                     sum(r) FILTER (label = 1) AS rs, avg(pow(score - label, 2)) AS brier FROM ranked {group_by}),
      cuts AS (SELECT {keys}score, sum(label) AS pos, count(*) - sum(label) AS neg FROM base GROUP BY {keys}score),
      curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM cuts
                WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      two AS (SELECT {selected} sum(b.pos / a.p * b.tp / (b.tp + b.fp)) AS auprc,
                     1 - min(b.fp / a.q) FILTER (b.tp / a.p >= 0.9) AS spec
              FROM one a JOIN curve b ON {match} GROUP BY ALL)
      SELECT {selected} CAST(a.n AS BIGINT) AS n, round((a.rs - a.p * (a.p + 1) / 2) / (a.p * a.q), 6) AS auroc,
             round(b.auprc, 6) AS auprc, round(a.brier, 6) AS brier, round(b.spec, 6) AS spec_at_sens
      FROM one a JOIN two b ON {match} WHERE a.p > 0 AND a.q > 0 AND a.n >= {min_rows})"""


def rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in METRICS if m in df.columns})


def scores(spark, sf):
    return role(spark, sf, "scores")


@query("model_metrics", sql_with(["scores"], "SELECT * FROM m", {"m": metrics_sql([])}))
def _(spark, sf):
    return rounded(evaluation.ranking_metrics(scores(spark, sf), "score", "label"))


for _name, _metric in (("auroc", "auroc"), ("avg_precision", "auprc"), ("brier", "brier"), ("spec_at_sens", "spec_at_sens")):

    def _build(spark, sf, metric=_metric):
        return rounded(evaluation.ranking_metrics(scores(spark, sf), "score", "label", ["time_window"])).select(
            "time_window", metric
        )

    query(_name, sql_with(["scores"], f"SELECT time_window, {_metric} FROM m", {"m": metrics_sql(["time_window"])}))(_build)


@query("subgroup_metrics", sql_with(["scores"], "SELECT * FROM m", {"m": metrics_sql(["lang", "time_window"], 50)}))
def _(spark, sf):
    found = evaluation.ranking_metrics(scores(spark, sf), "score", "label", ["lang", "time_window"], min_rows=50)
    order = evaluation.window_order(F.col("time_window"), ["0.5h", "1h", "2h"])
    return rounded(found).orderBy("lang", order)


@query("metric_delta", sql_with(
    ["scores"],
    "SELECT a.lang, " + ", ".join(
        f"a.{m} AS {m}_first, b.{m} AS {m}_last, round(b.{m} - a.{m}, 6) AS {m}_delta" for m in ("auroc", "auprc"))
    + " FROM m a JOIN m b ON a.lang = b.lang WHERE a.time_window = '0.5h' AND b.time_window = '2h'",
    {"m": metrics_sql(["lang", "time_window"])}))
def _(spark, sf):
    found = rounded(evaluation.ranking_metrics(scores(spark, sf), "score", "label", ["lang", "time_window"]))
    wide = evaluation.metric_delta(found, "lang", "time_window", "0.5h", "2h", ["auroc", "auprc"])
    return wide.withColumns({f"{m}_delta": F.round(f"{m}_delta", 6) for m in ("auroc", "auprc")})


@query("roc_points", sql_with(
    ["scores"],
    "SELECT time_window, score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, "
    "CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp "
    "FROM (SELECT time_window, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY 1, 2) "
    "WINDOW w AS (PARTITION BY time_window ORDER BY score DESC)"))
def _(spark, sf):
    points = evaluation.roc_points(scores(spark, sf), "score", "label", ["time_window"])
    return points.drop("tp_total", "fp_total")


@query("eligible_groups", sql_with(
    ["scores"], "SELECT lang, count(*) AS n FROM scores GROUP BY 1 HAVING count(*) >= 150 AND count(DISTINCT label) = 2"))
def _(spark, sf):
    return evaluation.eligible_groups(scores(spark, sf), "lang", "label", 150)


ENTROPY_SQL = "-((score + 1e-9) * log2(score + 1e-9) + (1.0e0 - score + 1e-9) * log2(1.0e0 - score + 1e-9))"


@query("entropy", sql_with(["scores"], f"SELECT doc_id, time_window, round({ENTROPY_SQL}, 9) AS entropy FROM scores"))
def _(spark, sf):
    return scores(spark, sf).select("doc_id", "time_window", F.round(binary_entropy(F.col("score")), 9).alias("entropy"))


@query("risk_coverage", sql_with(
    ["scores"],
    "SELECT c.coverage, round(1 - c.coverage, 6) AS deferral, m.n, m.auroc FROM cov c JOIN m ON m.coverage = c.coverage",
    {
        "ent": f"SELECT score, label, {ENTROPY_SQL} AS e FROM scores",
        "cov": "SELECT * FROM (VALUES (1.0e0), (0.9e0), (0.8e0), (0.7e0), (0.6e0)) v(coverage)",
        "lim": " UNION ALL ".join(f"SELECT {c}e0 AS coverage, quantile_cont(e, {c}) AS t FROM ent" for c in ("1.0", "0.9", "0.8", "0.7", "0.6")),
        "kept": "SELECT l.coverage, score, label FROM ent JOIN lim l ON e <= l.t",
        "m": metrics_sql(["coverage"], 0, "kept"),
    }))
def _(spark, sf):
    curve = evaluation.risk_coverage(scores(spark, sf), "score", "label")
    return curve.withColumns({"deferral": F.round("deferral", 6), "auroc": F.round("auroc", 6)})


POINTS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999}
PERCENTILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("percentiles", " UNION ALL ".join(
    f"SELECT '{c}' AS name, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}" for n, q in POINTS.items()) + " FROM lineitem"
    for c in PERCENTILE_COLUMNS))
def _(spark, sf):
    found = exact_percentiles(load(spark, sf, "lineitem"), PERCENTILE_COLUMNS, POINTS)
    return found.withColumns({n: F.round(n, 6) for n in POINTS})


YEARS_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS y FROM orders"


def dated(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END AS y")


@query("split_cutoff", f"SELECT o_orderkey, y, CASE WHEN y <= 1999 THEN 'train' ELSE 'test' END AS side FROM ({YEARS_SQL}) WHERE y IS NOT NULL")
def _(spark, sf):
    return splits.split_by_cutoff(dated(spark, sf), "y", 1999)


@query("split_fraction", f"""
    WITH d AS (SELECT * FROM ({YEARS_SQL}) WHERE y IS NOT NULL)
    SELECT o_orderkey, y, CASE WHEN row_number() OVER (ORDER BY y, o_orderkey) <= floor(0.8 * (SELECT count(*) FROM d))
                               THEN 'train' ELSE 'test' END AS side FROM d""")
def _(spark, sf):
    return splits.split_by_fraction(dated(spark, sf), "y", "o_orderkey", 0.8)


@query("stratified_split", """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
    SELECT quality, 'test' AS side, CAST(floor(0.1 * n) AS BIGINT) AS n FROM c
    UNION ALL SELECT quality, 'train', n - CAST(floor(0.1 * n) AS BIGINT) FROM c""")
def _(spark, sf):
    split = splits.stratified_split(load(spark, sf, "labels"), "quality", ["doc_id"], 0.1)
    return split.groupBy("quality", "side").agg(F.count("*").alias("n"))


@query("stratified_folds", """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
    SELECT quality, CAST(f AS INT) AS fold, CAST(n // 5 + CASE WHEN f BETWEEN 1 AND n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
    FROM c, range(5) t(f)""")
def _(spark, sf):
    folds = splits.stratified_folds(load(spark, sf, "labels"), "quality", ["doc_id"], 5)
    return folds.groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query("seeded_sample")
def _(spark, sf):
    return hash_sample(load(spark, sf, "lineitem"), 30000, 42, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


HOLES = "SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS score FROM events"
TRAIN = "ts < TIMESTAMP '2024-01-20 00:00:00'"


def holes(spark, sf):
    events = load(spark, sf, "events").selectExpr(
        "event_id", "ts", "CASE WHEN event_id % 7 <> 0 THEN value END AS value",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS score",
    )
    return events, events.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query("median_impute", f"""
    WITH h AS ({HOLES}), m AS (SELECT median(value) AS v, median(score) AS s FROM h WHERE {TRAIN})
    SELECT event_id, round(coalesce(value, m.v), 6) AS value, round(coalesce(score, m.s), 6) AS score FROM h, m""")
def _(spark, sf):
    df, train = holes(spark, sf)
    filled = preparation.impute(df, preparation.train_medians(train, ["value", "score"]))
    return filled.select("event_id", F.round("value", 6).alias("value"), F.round("score", 6).alias("score"))


@query("standardize", f"""
    WITH h AS ({HOLES}), m AS (SELECT avg(value) AS a, stddev_pop(value) AS d, avg(score) AS b, stddev_pop(score) AS e
                               FROM h WHERE {TRAIN})
    SELECT event_id, round((value - a) / d, 6) AS value, round((score - b) / e, 6) AS score FROM h, m""")
def _(spark, sf):
    df, train = holes(spark, sf)
    scaled = preparation.standardize(df, preparation.train_scales(train, ["value", "score"]))
    return scaled.select("event_id", F.round("value", 6).alias("value"), F.round("score", 6).alias("score"))


@query("category_default", sql_with(
    ["edstays"], "SELECT stay_id, coalesce(arrival_transport, 'Unknown') AS arrival_transport FROM edstays"))
def _(spark, sf):
    stays = role(spark, sf, "edstays").select("stay_id", "arrival_transport")
    return preparation.default_categories(stays, ["arrival_transport"])
