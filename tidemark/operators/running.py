"""Exact ranks, running sums, first-n and percentiles without a one-task window.

Rows are cut into slots: value ranges (from approximate quantiles) or hash
ranges. Slot totals are a small aggregate with map-side combine; their running
sum gives each slot its offset, and the ordered window runs inside one
(group, slot) only. A group that holds a third of the rows is thereby spread
over as many tasks as there are slots, and the results stay exact whatever the
quantiles were, because a slot is a monotone function of the sort value.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slot_count(df: DataFrame, slots: int | None = None) -> int:
    return slots or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_edges(df: DataFrame, columns: list[str], slots: int | None = None) -> list[list[float]]:
    """Strictly increasing cut points per column; the driver holds ``slots`` numbers per column."""
    n = slot_count(df, slots)
    if n < 2:
        return [[] for _ in columns]
    found = df.approxQuantile(columns, [i / n for i in range(1, n)], 1.0 / (2 * n))
    return [sorted({float(x) for x in edges if math.isfinite(x)}) for edges in found]


def with_value_slots(df: DataFrame, columns: list[str], names: list[str], slots: int | None = None) -> DataFrame:
    """Add an int slot per numeric column, non-decreasing in its value."""
    doubles = [f"__{n}_value" for n in names]
    df = df.withColumns({d: F.col(c).cast("double") for d, c in zip(doubles, columns)})
    edges = value_edges(df, doubles, slots)
    splits = [[-math.inf, *(e or [0.0]), math.inf] for e in edges]
    cutter = Bucketizer(splitsArray=splits, inputCols=doubles, outputCols=names, handleInvalid="keep")
    return cutter.transform(df).withColumns({n: F.col(n).cast("int") for n in names}).drop(*doubles)


def hash_order(seed: int, *keys: str) -> Column:
    """Repeatable pseudo-random 64-bit sort value of a row's keys."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def hash_slot(value: Column, bits: int = 10) -> Column:
    """Slot of a uniform 64-bit value: its leading bits, in the same order."""
    return F.shiftright(value, 64 - bits).cast("int")


def with_running(
    df: DataFrame,
    slot: str,
    order: list[Column],
    sums: dict[str, Column],
    groups: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums in sort order, per group, and group totals as ``<name>_total``.

    ``slot`` must follow the first sort key; ``descending`` says that it falls
    along ``order``. ``order`` must be total, else ties share no fixed order.
    """
    groups = groups or []
    keys = [*groups, slot]
    slot_order = F.col(slot).desc() if descending else F.col(slot)
    before = W.partitionBy(*groups).orderBy(slot_order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(W.partitionBy(*groups)).alias(f"{n}_total") for n in sums],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = local.join(offsets, match, "left")
    return joined.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).drop(
        *[f"__k_{k}" for k in keys], *[f"__o_{n}" for n in sums]
    )


def with_rank(df, slot, order, groups=None, name: str = "rank", descending: bool = False) -> DataFrame:
    """Exact row number 1..n per group in sort order."""
    return with_running(df, slot, order, {name: F.lit(1).cast("long")}, groups, descending).drop(f"{name}_total")


def hash_ranked(df: DataFrame, seed: int, keys: list[str], groups=None, name: str = "rank") -> DataFrame:
    """Row number in pseudo-random order, the same for every run and partitioning."""
    ordered = df.withColumn("__h", hash_order(seed, *keys)).withColumn("__slot", hash_slot(F.col("__h")))
    ranked = with_rank(ordered, "__slot", [F.col("__h"), *[F.col(k) for k in keys]], groups, name)
    return ranked.drop("__h", "__slot")


def hash_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """Seeded sample of exactly min(n, rows) rows."""
    return hash_ranked(df, seed, keys, name="__r").filter(F.col("__r") <= n).drop("__r")


def exact_percentiles(
    df: DataFrame, columns: list[str], points: dict[str, float], slots: int | None = None
) -> DataFrame:
    """One row per column: ``name`` and a linearly interpolated percentile per point.

    Equal values are counted before anything is sorted, and only the slots that
    hold a wanted rank contribute a value.
    """
    names = [f"__slot_{i}" for i in range(len(columns))]
    slotted = with_value_slots(df, columns, names, slots)
    long = slotted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.col(s).alias("slot")
                    )
                    for c, s in zip(columns, names)
                ]
            )
        )
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy("name", "slot", "value").agg(F.count("*").alias("n"))
    placed = with_running(counted, "slot", [F.col("value")], {"upto": F.col("n")}, ["name"])
    aggs, outs = [], []
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    for label, q in points.items():
        spot = F.lit(float(q)) * (F.col("upto_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        aggs += [
            F.max(F.when((first <= low) & (low <= last), F.col("value"))).alias(f"__lo_{label}"),
            F.max(F.when((first <= high) & (high <= last), F.col("value"))).alias(f"__hi_{label}"),
            F.max(spot - low).alias(f"__f_{label}"),
        ]
        lo, hi = F.col(f"__lo_{label}"), F.col(f"__hi_{label}")
        outs.append((lo + (hi - lo) * F.col(f"__f_{label}")).alias(label))
    return placed.groupBy("name").agg(*aggs).select("name", *outs)
