"""Equi-joins that stay balanced when a key is null or hot on one side."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_left(rows: DataFrame, table: DataFrame, key: str, spread_by: str, pieces: int = 64) -> DataFrame:
    """Left join where many ``rows`` may have a null key.

    Null keys match nothing, yet in a shuffle join they would all meet in one
    task; a salt on the row side spreads them. ``table`` has one row per key,
    so a hot key is a plain split of the row side, left to adaptive execution.
    """
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(pieces))).otherwise(F.lit(0))
    left = rows.withColumn("__salt", salt.cast("long"))
    right = table.filter(F.col(key).isNotNull()).withColumn("__salt", F.lit(0).cast("long"))
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def lookup_default(rows: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join of a small lookup table; unmatched columns get the given defaults."""
    joined = rows.join(table, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def label_shift(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows per label before and after a relabelling, 0 where a label is on one side only.

    One scan and one aggregation: every row contributes its two labels.
    """
    sides = F.array(
        F.struct(F.col(old).alias("label"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(F.col(new).alias("label"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )
    counts = df.select(F.inline(sides)).groupBy("label").agg(
        F.sum("b").alias("n_before"), F.sum("a").alias("n_after")
    )
    return counts.withColumn("delta", F.col("n_after") - F.col("n_before"))
