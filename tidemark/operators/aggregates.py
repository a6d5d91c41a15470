"""Grouped counts and reports that combine before they shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pivot_first(df: DataFrame, key: str, category: str, names: dict[str, str], at: str, tie: str, value: str) -> DataFrame:
    """Long to wide: the earliest value per key and category, one column per category.

    An aggregate, not a ranking window: rows of a hot key are reduced where they
    are read. ``names`` maps category values to output columns.
    """
    first = df.groupBy(key, category).agg(F.min(F.struct(at, tie, value)).alias("f"))
    return first.groupBy(key).agg(
        *[F.max(F.when(F.col(category) == c, F.col(f"f.{value}"))).alias(n) for c, n in names.items()]
    )


def prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows, positives and percent of each 0/1 flag, from one aggregation."""
    wide = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags])
    long = F.inline(
        F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("long").alias("n_positive")) for f in flags])
    )
    return wide.select("n", long).withColumn("percent", F.col("n_positive") / F.col("n") * 100)


def group_counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of an order; a report size, so the limit is the feature."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows per group. The rank filter is pushed in front of the
    shuffle, so a task sends at most k rows per group."""
    return (
        df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order)))
        .filter(F.col(rank) <= k)
    )


def modal_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values per group with their counts; ties by value."""
    counts = group_counts(df.filter(F.col(value).isNotNull()), group, value)
    return top_k_per_group(counts, group, [F.col("n").desc(), F.col(value)], k)


def joined_modes(df: DataFrame, group: str, value: str, k: int, separator: str, name: str) -> DataFrame:
    """The k most frequent values per group as one string (k bounds the group)."""
    modes = modal_values(df, group, value, k)
    listed = modes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", value))).alias("l"))
    return listed.select(group, F.array_join(F.transform("l", lambda s: s[value]), separator).alias(name))


def known_fixes(df: DataFrame, text: str, label: str, expected: list[tuple[str, str]]) -> DataFrame:
    """Rows that contain a phrase and carry its expected label, all pairs in one pass."""
    wide = df.agg(
        *[
            F.count_if(F.col(text).rlike(phrase) & (F.col(label) == want)).alias(f"f{i}")
            for i, (phrase, want) in enumerate(expected)
        ]
    )
    rows = [
        F.struct(F.lit(phrase).alias("phrase"), F.lit(want).alias("label"), F.col(f"f{i}").alias("n"))
        for i, (phrase, want) in enumerate(expected)
    ]
    return wide.select(F.inline(F.array(*rows)))
