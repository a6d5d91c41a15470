"""Clustering on given coordinates, sweep metrics and ranking queries."""

from pyspark.sql import functions as F

from tidemark import clinical_values as values
from tidemark.catalog.registry import query
from tidemark.catalog.standins import load, quoted, role, sql_with
from tidemark.catalog.text_queries import DOC_RULES, DOC_RULES_SQL
from tidemark.operators import sweep
from tidemark.operators.clustering import cluster_cells, count_cells, density_clusters
from tidemark.operators.parallel import spread
from tidemark.operators.relabel import OTHER
from tidemark.operators.rules import word_label
from tidemark.plans import tuning

PHRASES = ["thatin", "the", "hehely", "nicht", "zzzz", "of the"]
MIN_HITS = 50


def metrics_sql(source: str, phrases: list[str], min_hits: int) -> str:
    """Metrics per combo_id from rows (combo_id, topic, label, text)."""
    names = ", ".join(f"('{p}', {i})" for i, p in enumerate(phrases)) or "(NULL, 0)"
    return f"""
      (WITH r AS (SELECT * FROM {source}),
      t AS (SELECT combo_id, count(*) AS n_total, count(*) FILTER (topic < 0) AS n_noise, count(*) FILTER (topic >= 0) AS n_valid,
                   count(*) FILTER (topic >= 0 AND label = '{OTHER}') AS n_other FROM r GROUP BY 1),
      s AS (SELECT combo_id, count(*) AS n_topics, avg(size) AS m, median(size) AS md, min(size) AS lo, max(size) AS hi, stddev_pop(size) AS sd
            FROM (SELECT combo_id, topic, count(*) AS size FROM r WHERE topic >= 0 GROUP BY 1, 2) GROUP BY 1),
      ph AS (SELECT * FROM (VALUES {names}) v(phrase, i)),
      pt AS (SELECT combo_id, phrase, i, topic, count(*) AS n FROM r JOIN ph ON contains(r.text, phrase) GROUP BY 1, 2, 3, 4),
      p AS (SELECT combo_id, phrase, i, sum(n) AS a, coalesce(sum(n) FILTER (topic >= 0), 0) AS b, max(n) FILTER (topic >= 0) AS c FROM pt GROUP BY 1, 2, 3),
      q AS (SELECT combo_id, count(*) FILTER (b >= {min_hits}) AS cov, count(*) FILTER (b < {min_hits}) AS mis,
                   string_agg(phrase, ',' ORDER BY i) FILTER (b < {min_hits}) AS names, avg(c / a) FILTER (b >= {min_hits}) AS coh
            FROM p WHERE a >= {min_hits} GROUP BY 1)
      SELECT t.combo_id, n_total, n_noise, n_valid, round(n_noise / n_total, 4) AS noise_ratio, coalesce(n_topics, 0) AS n_topics,
             round(CASE WHEN n_valid > 0 THEN n_other / n_valid ELSE 1 END, 4) AS other_ratio,
             round(coalesce(m, 0.0), 1) AS mean_topic_size, round(coalesce(md, 0.0), 1) AS median_topic_size,
             coalesce(lo, 0) AS min_topic_size, coalesce(hi, 0) AS max_topic_size,
             round(CASE WHEN m > 0 THEN sd / m ELSE 999.0 END, 3) AS size_cv,
             round(coalesce(cov, 0) / {max(len(phrases), 1)}, 4) AS coverage_ratio, coalesce(cov, 0) AS n_critical_covered,
             coalesce(mis, 0) AS n_critical_missing, coalesce(names, '') AS missing_ccs, round(coalesce(coh, 0.0), 4) AS mean_cohesion
      FROM t LEFT JOIN s ON s.combo_id = t.combo_id LEFT JOIN q ON q.combo_id = t.combo_id)"""


SCORE_SQL = """round(greatest(0.0e0, 100.0e0 - (n_critical_missing * 10.0e0 + greatest(noise_ratio - 0.30e0, 0) * 100 + greatest(other_ratio - 0.10e0, 0) * 70
    + greatest(30 - n_topics, 0) * 0.3e0 + greatest(n_topics - 150, 0) * 0.05e0 + greatest(size_cv - 2.0e0, 0))), 2)"""

# three assignments of all notes to topics
ASSIGNED = f"SELECT 'c' || c AS combo_id, CAST(doc_id * c % 7 - 1 AS INT) AS topic, coalesce({DOC_RULES_SQL}, '{OTHER}') AS label, text FROM documents, (VALUES (1), (2), (5)) v(c)"
NOTE_METRICS = {"assigned": ASSIGNED, "metrics": metrics_sql("assigned", PHRASES, MIN_HITS)}
# one combination per supplier, with 10 to 69 topics
FLAG_PHRASES = ["A", "N", "R"]
LINES = f"""SELECT 'mcs' || (l_suppkey // 13) || '_ms' || (l_suppkey % 13) AS combo_id, CAST(l_partkey % (10 + l_suppkey % 60) - 1 AS INT) AS topic,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN '{OTHER}' ELSE 'known' END AS label, l_returnflag AS text FROM lineitem"""
LINE_METRICS = {"rows_by_supplier": LINES, "metrics": metrics_sql("rows_by_supplier", FLAG_PHRASES, 190),
                "scored": f"SELECT *, {SCORE_SQL} AS composite_score, "
                          "CAST(regexp_extract(combo_id, 'mcs([0-9]+)', 1) AS INT) * 13 + CAST(regexp_extract(combo_id, 'ms([0-9]+)$', 1) AS INT) AS grid_order FROM metrics"}


def note_metrics(spark, sf):
    docs = spread(load(spark, sf, "documents")).withColumn("c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    rows = docs.select(
        F.concat(F.lit("c"), F.col("c").cast("string")).alias("combo_id"),
        (F.col("doc_id") * F.col("c") % 7 - 1).cast("int").alias("topic"),
        word_label(F.col("text"), DOC_RULES, OTHER).alias("label"),
        "text",
    )
    stats = sweep.topic_stats(rows, ["combo_id"], "topic", "label", "text", PHRASES)
    return sweep.combination_metrics(stats, ["combo_id"], PHRASES, MIN_HITS)


def line_metrics(spark, sf):
    lines = load(spark, sf, "lineitem")
    other = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")
    size, samples = F.floor(F.col("l_suppkey") / 13).cast("int"), (F.col("l_suppkey") % 13).cast("int")
    rows = lines.select(
        sweep.combo_name(size, samples).alias("combo_id"),
        F.col("l_suppkey").cast("int").alias("grid_order"),
        (F.col("l_partkey") % (10 + F.col("l_suppkey") % 60) - 1).cast("int").alias("topic"),
        F.when(other, OTHER).otherwise("known").alias("label"),
        F.col("l_returnflag").alias("text"),
    )
    stats = sweep.topic_stats(rows, ["combo_id", "grid_order"], "topic", "label", "text", FLAG_PHRASES)
    return sweep.scored(sweep.combination_metrics(stats, ["combo_id", "grid_order"], FLAG_PHRASES, 190))


@query("cohesion", sql_with([], "SELECT combo_id, n_critical_covered, n_critical_missing, missing_ccs, coverage_ratio, mean_cohesion FROM metrics", NOTE_METRICS))
def _(spark, sf):
    return note_metrics(spark, sf).select(
        "combo_id", "n_critical_covered", "n_critical_missing", "missing_ccs", "coverage_ratio", "mean_cohesion"
    )


@query("combination_metrics", sql_with([], "SELECT * FROM metrics", NOTE_METRICS))
def _(spark, sf):
    return note_metrics(spark, sf)


@query("topic_size_stats", sql_with([], "SELECT combo_id, n_topics, mean_topic_size, median_topic_size, min_topic_size, max_topic_size, size_cv, noise_ratio, other_ratio FROM metrics", LINE_METRICS))
def _(spark, sf):
    return line_metrics(spark, sf).select(
        "combo_id", "n_topics", "mean_topic_size", "median_topic_size", "min_topic_size", "max_topic_size", "size_cv",
        "noise_ratio", "other_ratio",
    )


@query("composite_score", sql_with([], "SELECT * FROM scored", LINE_METRICS))
def _(spark, sf):
    return line_metrics(spark, sf)


RANK_COLUMNS = ["combo_id", "noise_ratio", "n_topics", "other_ratio", "mean_cohesion", "n_critical_covered", "composite_score"]


@query("sweep_rank", sql_with([], f"SELECT {', '.join(RANK_COLUMNS)} FROM scored ORDER BY composite_score DESC, combo_id LIMIT 15", LINE_METRICS))
def _(spark, sf):
    return sweep.ranked(line_metrics(spark, sf)).select(*RANK_COLUMNS)


@query("sweep_best", sql_with([], "SELECT combo_id, composite_score FROM scored ORDER BY composite_score DESC, grid_order LIMIT 1", LINE_METRICS))
def _(spark, sf):
    return sweep.best(line_metrics(spark, sf))


@query("sweep_shortlist", sql_with(
    [], f"SELECT {', '.join(RANK_COLUMNS)} FROM scored WHERE noise_ratio < 0.4 AND n_topics BETWEEN 30 AND 200 ORDER BY composite_score DESC, combo_id LIMIT 5", LINE_METRICS))
def _(spark, sf):
    return sweep.shortlist(line_metrics(spark, sf)).select(*RANK_COLUMNS)


@query("nondominated", sql_with(
    [], "SELECT combo_id, noise_ratio, mean_cohesion FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.noise_ratio <= a.noise_ratio "
    "AND b.mean_cohesion >= a.mean_cohesion AND (b.noise_ratio < a.noise_ratio OR b.mean_cohesion > a.mean_cohesion))", LINE_METRICS))
def _(spark, sf):
    return sweep.nondominated(line_metrics(spark, sf), "noise_ratio", "mean_cohesion").select(
        "combo_id", "noise_ratio", "mean_cohesion"
    )


@query("early_stop", sql_with([], "SELECT combo_id, composite_score FROM scored WHERE composite_score >= 85 ORDER BY grid_order LIMIT 1", LINE_METRICS))
def _(spark, sf):
    return sweep.first_reaching(line_metrics(spark, sf), 85.0)


@query("combo_checklist", sql_with(
    [], "SELECT combo_id, CAST(noise_ratio < 0.3 AS INT) AS noise_below_30, CAST(noise_ratio < 0.15 AS INT) AS noise_below_15, "
    "CAST(n_topics BETWEEN 30 AND 150 AS INT) AS topics_30_to_150, CAST(other_ratio < 0.1 AS INT) AS other_below_10, "
    "CAST(n_critical_missing = 0 AS INT) AS none_missing, CAST(mean_cohesion >= 0.7 AS INT) AS cohesion_from_70 FROM metrics", LINE_METRICS))
def _(spark, sf):
    return sweep.checklist(line_metrics(spark, sf))


# customers as points: nation and balance
POINT_SAMPLES = [2, 3, 4, 6]
# the operator's own grid, and smaller settings for the few customers of a test
GRID_SIZES, GRID_SAMPLES = sorted({4, 10, 25, *values.SWEEP_SIZES}), sorted({2, 4, 6, *values.SWEEP_SAMPLES})
POINT_PHRASES, POINT_RULES = ["BUILD", "MACHINERY", "H"], [("BUILDING", "b"), ("FURNITURE", "f"), ("HOUSEHOLD", "h")]
CELLS_SQL = "SELECT c_custkey, c_mktsegment, CAST(floor(c_nationkey / 1.0e0) AS BIGINT) AS x, CAST(floor(c_acctbal / 400 / 1.0e0) AS BIGINT) AS y FROM customer"
COUNTS_SQL = "SELECT s.m, x, y, x || ',' || y AS cell, count(*) AS size FROM points, s GROUP BY ALL"
LINKS_SQL = """SELECT a.m, a.cell AS a, b.cell AS b FROM cells a JOIN cells b ON a.m = b.m AND abs(a.x - b.x) + abs(a.y - b.y) = 1
    WHERE a.size >= a.m AND b.size >= b.m"""
GROW_SQL = "SELECT m, cell, cell AS r FROM cells WHERE size >= m UNION SELECT l.m, l.b, g.r FROM grow g JOIN links l ON l.m = g.m AND l.a = g.cell"
DENSE_SQL = "SELECT m, cell, min(r) AS cluster FROM grow GROUP BY 1, 2"
NEAR_SQL = """SELECT a.m, a.cell, min(d.cluster) AS cluster FROM cells a JOIN cells b ON a.m = b.m AND abs(a.x - b.x) + abs(a.y - b.y) = 1
    JOIN dense d ON d.m = b.m AND d.cell = b.cell WHERE a.size < a.m GROUP BY 1, 2"""
CLUSTERS = {
    "points": CELLS_SQL, "s": "SELECT * FROM (VALUES " + ", ".join(f"({m})" for m in POINT_SAMPLES) + ") v(m)", "cells": COUNTS_SQL,
    "links": LINKS_SQL, "grow": GROW_SQL, "dense": DENSE_SQL, "near": NEAR_SQL,
    "named": "SELECT c.m, c.cell, c.size, coalesce(d.cluster, n.cluster) AS cluster FROM cells c LEFT JOIN dense d ON d.m = c.m AND d.cell = c.cell "
             "LEFT JOIN near n ON n.m = c.m AND n.cell = c.cell",
}


def points(spark, sf):
    at = F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 400)
    return load(spark, sf, "customer").select("c_custkey", "c_mktsegment", at.alias("at"))


@query("grid_clusters", sql_with([], "SELECT m AS min_samples, cell, size, cluster FROM named", CLUSTERS))
def _(spark, sf):
    return cluster_cells(count_cells(points(spark, sf), "at", 1.0), POINT_SAMPLES)


@query("density_clusters", sql_with(
    [], "SELECT c_custkey, CAST(coalesce(k.topic, -1) AS INT) AS topic FROM points p JOIN named n ON n.m = 4 AND n.cell = p.x || ',' || p.y LEFT JOIN k ON k.cluster = n.cluster",
    {**CLUSTERS, "k": "SELECT cluster, row_number() OVER (ORDER BY sum(size) DESC, cluster) - 1 AS topic FROM named WHERE m = 4 AND cluster IS NOT NULL GROUP BY 1 HAVING sum(size) >= 10"}))
def _(spark, sf):
    return density_clusters(points(spark, sf), "at", 1.0, 4, 10).select("c_custkey", "topic")


@query("sweep", sql_with(
    [], f"""SELECT metrics.*, {SCORE_SQL} AS composite_score, CAST(regexp_extract(combo_id, 'mcs([0-9]+)', 1) AS INT) AS min_cluster_size,
            CAST(regexp_extract(combo_id, 'ms([0-9]+)$', 1) AS INT) AS min_samples FROM metrics""",
    {
        **CLUSTERS,
        "s": "SELECT * FROM (VALUES " + ", ".join(f"({m})" for m in GRID_SAMPLES) + ") v(m)",
        "z": "SELECT * FROM (VALUES " + ", ".join(f"({m})" for m in GRID_SIZES) + ") v(z)",
        "big": "SELECT m, cluster, sum(size) AS total FROM named WHERE cluster IS NOT NULL GROUP BY 1, 2",
        "placed": f"""SELECT 'mcs' || z || '_ms' || n.m AS combo_id, CASE WHEN total >= z THEN hash(n.cluster) // 16 ELSE -1 END AS topic,
                      CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_mktsegment = 'FURNITURE' THEN 'f' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'h' ELSE '{OTHER}' END AS label,
                      c_mktsegment AS text FROM points p JOIN named n ON n.cell = p.x || ',' || p.y CROSS JOIN z LEFT JOIN big b ON b.m = n.m AND b.cluster = n.cluster""",
        "metrics": metrics_sql("placed", POINT_PHRASES, MIN_HITS),
    }))
def _(spark, sf):
    found = tuning.sweep_metrics(
        points(spark, sf), "at", "c_mktsegment", 1.0, GRID_SIZES, GRID_SAMPLES, POINT_RULES, POINT_PHRASES, MIN_HITS
    )
    return found.drop("grid_order")
