"""Sweeping the cluster settings: one clustering pass, metrics per combination, ranking."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.relabel import OTHER


def combo_name(size: Column, samples: Column) -> Column:
    return F.concat(F.lit("mcs"), size.cast("string"), F.lit("_ms"), samples.cast("string"))


def combinations(spark, sizes, samples) -> DataFrame:
    """grid_order, min_cluster_size, min_samples, combo_id in the order of a nested loop."""
    rows = [(i, s, m) for i, (s, m) in enumerate((s, m) for s in sizes for m in samples)]
    grid = spark.createDataFrame(rows, "grid_order int, min_cluster_size int, min_samples int")
    return grid.withColumn("combo_id", combo_name(F.col("min_cluster_size"), F.col("min_samples")))


def remaining(work: DataFrame, finished: DataFrame) -> DataFrame:
    """Combinations that have no result yet."""
    return work.join(finished.select("combo_id").distinct(), "combo_id", "left_anti")


def phrase_hits(text: Column, phrases: list[str]) -> list[Column]:
    """Rows that contain each phrase, as aggregates p0, p1, ..."""
    return [F.count_if(text.contains(p)).alias(f"p{i}") for i, p in enumerate(phrases)]


def topic_stats(
    df: DataFrame, keys: list[str], topic: str, label: str, text: str, phrases: list[str], other: str = OTHER
) -> DataFrame:
    """size, n_other and phrase hits per combination and topic, combined before the shuffle."""
    return df.groupBy(*keys, F.col(topic).alias("topic")).agg(
        F.count("*").alias("size"),
        F.count_if(F.col(label) == other).alias("n_other"),
        *phrase_hits(F.col(text), phrases),
    ).withColumn("is_topic", F.col("topic") >= 0)


def combination_metrics(stats: DataFrame, keys: list[str], phrases: list[str], min_hits: int = 50) -> DataFrame:
    """Quality metrics per combination from per-topic statistics.

    ``stats`` has keys, size, n_other, p0.., is_topic. A phrase counts from
    ``min_hits`` rows on; it is covered with that many rows in topics, and its
    cohesion is the share of its rows in its largest topic.
    """
    real = F.col("is_topic")

    def inside(c):
        return F.when(real, F.col(c))

    hits = [f"p{i}" for i in range(len(phrases))]
    agg = stats.groupBy(*keys).agg(
        F.sum("size").alias("n_total"),
        F.coalesce(F.sum(inside("size")), F.lit(0)).alias("n_valid"),
        F.count(inside("size")).alias("n_topics"),
        F.coalesce(F.sum(inside("n_other")), F.lit(0)).alias("__other"),
        F.coalesce(F.avg(inside("size")), F.lit(0.0)).alias("__mean"),
        F.coalesce(F.median(inside("size")), F.lit(0.0)).alias("__median"),
        F.coalesce(F.min(inside("size")), F.lit(0)).alias("min_topic_size"),
        F.coalesce(F.max(inside("size")), F.lit(0)).alias("max_topic_size"),
        F.stddev_pop(inside("size")).alias("__std"),
        *[F.sum(h).alias(f"{h}_all") for h in hits],
        *[F.coalesce(F.sum(inside(h)), F.lit(0)).alias(f"{h}_in") for h in hits],
        *[F.coalesce(F.max(inside(h)), F.lit(0)).alias(f"{h}_top") for h in hits],
    )
    known = [F.col(f"{h}_all") >= min_hits for h in hits]
    covered = [k & (F.col(f"{h}_in") >= min_hits) for k, h in zip(known, hits)]
    missing = [k & (F.col(f"{h}_in") < min_hits) for k, h in zip(known, hits)]

    def count_true(flags):
        return reduce(lambda a, b: a + b, [f.cast("long") for f in flags]) if flags else F.lit(0).cast("long")

    cohesion = [F.when(c, F.col(f"{h}_top") / F.col(f"{h}_all")).otherwise(0.0) for c, h in zip(covered, hits)]
    total = reduce(lambda a, b: a + b, cohesion) if cohesion else F.lit(0.0)
    names = F.array_compact(F.array(*[F.when(m, F.lit(p)) for m, p in zip(missing, phrases)])) if phrases else F.array()
    noise = F.col("n_total") - F.col("n_valid")
    cv = F.when(F.col("__mean") > 0, F.col("__std") / F.col("__mean")).otherwise(999.0)
    n_covered = count_true(covered)
    return agg.select(
        *keys,
        "n_total",
        noise.alias("n_noise"),
        "n_valid",
        F.round(noise / F.col("n_total"), 4).alias("noise_ratio"),
        "n_topics",
        F.round(F.when(F.col("n_valid") > 0, F.col("__other") / F.col("n_valid")).otherwise(1.0), 4).alias("other_ratio"),
        F.round("__mean", 1).alias("mean_topic_size"),
        F.round("__median", 1).alias("median_topic_size"),
        "min_topic_size",
        "max_topic_size",
        F.round(cv, 3).alias("size_cv"),
        F.round(n_covered / F.lit(max(len(phrases), 1)), 4).alias("coverage_ratio"),
        n_covered.alias("n_critical_covered"),
        count_true(missing).alias("n_critical_missing"),
        F.array_join(names, ",").alias("missing_ccs"),
        F.round(F.when(n_covered > 0, total / n_covered).otherwise(0.0), 4).alias("mean_cohesion"),
    )


def composite_score() -> Column:
    """0..100 from the rounded metrics; every excess over its target costs points."""
    def excess(value, target, weight):
        return F.greatest(value - F.lit(target), F.lit(0.0)) * F.lit(weight)

    n = F.col("n_topics")
    penalty = (
        F.col("n_critical_missing") * F.lit(10.0)
        + excess(F.col("noise_ratio"), 0.30, 100.0)
        + excess(F.col("other_ratio"), 0.10, 70.0)
        + F.greatest(F.lit(30) - n, F.lit(0)) * F.lit(0.3)
        + F.greatest(n - F.lit(150), F.lit(0)) * F.lit(0.05)
        + excess(F.col("size_cv"), 2.0, 1.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - penalty), 2)


def scored(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("composite_score", composite_score())


def ranked(metrics: DataFrame, k: int = 15) -> DataFrame:
    """The k best combinations; ties by combination id."""
    return metrics.orderBy(F.col("composite_score").desc(), "combo_id").limit(k)


def best(metrics: DataFrame) -> DataFrame:
    """One row: the best combination, the first in grid order where scores tie."""
    return metrics.agg(
        F.max_by("combo_id", F.struct("composite_score", -F.col("grid_order"))).alias("combo_id"),
        F.max("composite_score").alias("composite_score"),
    )


def shortlist(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The k best with noise below .40 and 30 to 200 topics."""
    kept = metrics.filter((F.col("noise_ratio") < 0.40) & F.col("n_topics").between(30, 200))
    return ranked(kept, k)


def nondominated(metrics: DataFrame, least: str, most: str) -> DataFrame:
    """Rows no other row beats: none has as little ``least`` and as much ``most`` with one of them better.

    One value per distinct ``least`` is enough, so no rows are paired.
    """
    peak = metrics.groupBy(F.col(least).alias("__x")).agg(F.max(most).alias("__peak"))
    # one row per distinct value within a parameter grid
    earlier = W.partitionBy().orderBy("__x").rowsBetween(W.unboundedPreceding, -1)
    front = peak.withColumn("__before", F.max("__peak").over(earlier)).filter(
        F.col("__before").isNull() | (F.col("__peak") > F.col("__before"))
    )
    match = (F.col(least) == F.col("__x")) & (F.col(most) == F.col("__peak"))
    return metrics.join(front, match).drop("__x", "__peak", "__before")


def first_reaching(metrics: DataFrame, threshold: float = 90.0) -> DataFrame:
    """The first combination in grid order whose score reaches the threshold (early stop)."""
    return (
        metrics.filter(F.col("composite_score") >= threshold)
        .agg(F.min_by(F.struct("combo_id", "composite_score"), "grid_order").alias("r"))
        .select("r.*")
        .filter(F.col("combo_id").isNotNull())
    )


def checklist(metrics: DataFrame) -> DataFrame:
    """1/0 per quality target and combination."""
    checks = {
        "noise_below_30": F.col("noise_ratio") < 0.30,
        "noise_below_15": F.col("noise_ratio") < 0.15,
        "topics_30_to_150": F.col("n_topics").between(30, 150),
        "other_below_10": F.col("other_ratio") < 0.10,
        "none_missing": F.col("n_critical_missing") == 0,
        "cohesion_from_70": F.col("mean_cohesion") >= 0.70,
    }
    return metrics.select("combo_id", *[c.cast("int").alias(n) for n, c in checks.items()])


def sweep_stats(clusters: DataFrame, cells: DataFrame, sizes: list[int], phrases: list[str]) -> DataFrame:
    """Topic statistics of all combinations from cell statistics.

    ``clusters`` comes from ``cluster_cells`` for all ``min_samples``; ``cells``
    has n_other and p0.. per cell. Rows are not read again: cell counts are
    summed per cluster, and a minimum size only decides which clusters count.
    """
    hits = [f"p{i}" for i in range(len(phrases))]
    per_cluster = (
        clusters.select("min_samples", "cell", "cluster")
        .join(cells.select("cell", "size", "n_other", *hits), "cell")
        .groupBy("min_samples", "cluster")
        .agg(*[F.sum(c).alias(c) for c in ("size", "n_other", *hits)])
    )
    wanted = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("min_cluster_size")
    spread = per_cluster.select("*", wanted)
    real = F.col("cluster").isNotNull() & (F.col("size") >= F.col("min_cluster_size"))
    return spread.withColumn("is_topic", real)
