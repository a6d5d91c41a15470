"""Diagnostic reports as tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noise_grade(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.15, "good")
        .when(ratio < 0.30, "needs improvement")
        .when(ratio < 0.60, "excessive")
        .otherwise("critical")
    )


def heterogeneity_flag(score: Column) -> Column:
    return F.when(score > 0.5, "decompose").when(score > 0.3, "review").otherwise("")


def topic_summary(df: DataFrame, topic: str) -> DataFrame:
    """Rows, noise rows, noise ratio with its grade, and number of topics."""
    sizes = df.groupBy(topic).agg(F.count("*").alias("n"))
    noise = F.col(topic) == -1
    totals = sizes.agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("n_noise"),
        F.count(F.when(~noise, 1)).alias("n_topics"),
    )
    ratio = F.col("n_noise") / F.col("n_total")
    return totals.withColumn("noise_ratio", ratio).withColumn("grade", noise_grade(ratio))


def most_heterogeneous(scores: DataFrame, topic: str, k: int = 5) -> DataFrame:
    kept = scores.filter((F.col(topic) != -1) & F.col("heterogeneity").isNotNull())
    return (
        kept.select(topic, "heterogeneity", heterogeneity_flag(F.col("heterogeneity")).alias("flag"))
        .orderBy(F.col("heterogeneity").desc(), topic)
        .limit(k)
    )


def label_distribution(df: DataFrame, topic: str, label: str) -> DataFrame:
    """Non-noise rows per label and their share of all rows."""
    counts = df.groupBy(label).agg(
        F.count_if(F.col(topic) != -1).alias("n"), F.count("*").alias("__all")
    )
    total = counts.agg(F.sum("__all").alias("t")).scalar()
    return counts.filter(F.col("n") > 0).select(label, "n", (F.col("n") / total).alias("share"))


def method_checklist(summary: DataFrame, n_merged: Column, worst: Column) -> DataFrame:
    """Four yes/no checks on a ``topic_summary`` row."""
    checks = [
        ("noise below 30 percent", F.col("noise_ratio") < 0.30),
        ("no merged topics", n_merged == 0),
        ("no topic above 0.5 heterogeneity", F.coalesce(worst, F.lit(0.0)) <= 0.5),
        ("at least 20 topics", F.col("n_topics") >= 20),
    ]
    rows = [F.struct(F.lit(name).alias("check"), ok.cast("int").alias("passed")) for name, ok in checks]
    return summary.select(F.inline(F.array(*rows)))
