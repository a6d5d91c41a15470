"""Exact ranking and calibration metrics, for all groups in one job.

Scores are first counted per distinct value, then running true and false
positive counts come from slots (see ``running``), so one large group is not
one task. Points are the full ROC curve: one per distinct score.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import binary_entropy
from tidemark.operators.running import exact_percentiles, with_running, with_value_slots


def score_counts(df: DataFrame, score: str, label: str, groups: list[str]) -> DataFrame:
    """Positives and negatives per group and distinct score."""
    return df.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )


def roc_points(df: DataFrame, score: str, label: str, groups: list[str], slots: int | None = None) -> DataFrame:
    """Per group and distinct score, from the highest down: pos, neg, tp, fp, tp_total, fp_total."""
    clean = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    slotted = with_value_slots(clean, [score], ["__slot"], slots)
    counts = score_counts(slotted, score, label, [*groups, "__slot"])
    return with_running(
        counts,
        "__slot",
        [F.col("score").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        groups,
        descending=True,
    ).drop("__slot")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def ranking_metrics(
    df: DataFrame,
    score: str,
    label: str,
    groups: list[str] | None = None,
    sensitivity: float = 0.90,
    min_rows: int = 0,
    slots: int | None = None,
) -> DataFrame:
    """n, auroc, auprc (average precision), brier and specificity at a sensitivity.

    Groups with fewer than ``min_rows`` rows or one class only are left out.
    """
    groups = groups or []
    for g in groups:
        df = df.filter(F.col(g).isNotNull())
    points = roc_points(df, score, label, groups, slots).withColumnsRenamed({"tp_total": "P", "fp_total": "N"})
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    area = neg * (tp - pos / 2)
    precision = pos * tp / (tp + fp)
    squared = pos * F.pow(F.col("score") - 1, F.lit(2)) + neg * F.pow(F.col("score"), F.lit(2))
    reached = F.when(tp / F.col("P") >= sensitivity, fp)
    return (
        points.groupBy(*groups, "P", "N")
        .agg(
            F.sum(area).alias("area"),
            F.sum(precision).alias("precision_sum"),
            F.sum(squared).alias("squared"),
            F.min(reached).alias("fp_at"),
        )
        .filter((F.col("P") > 0) & (F.col("N") > 0) & (F.col("P") + F.col("N") >= min_rows))
        .select(
            *groups,
            (F.col("P") + F.col("N")).alias("n"),
            _ratio(F.col("area"), F.col("P") * F.col("N")).alias("auroc"),
            _ratio(F.col("precision_sum"), F.col("P")).alias("auprc"),
            (F.col("squared") / (F.col("P") + F.col("N"))).alias("brier"),
            (1 - F.col("fp_at") / F.col("N")).alias("spec_at_sens"),
        )
    )


def eligible_groups(df: DataFrame, group: str, label: str, min_rows: int = 50) -> DataFrame:
    """Groups with enough rows and both classes."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("n"), F.min(label).alias("__a"), F.max(label).alias("__b"))
        .filter((F.col("n") >= min_rows) & (F.col("__a") != F.col("__b")))
        .select(group, "n")
    )


def window_order(window: Column, order: list[str]) -> Column:
    """Position of a window label in its natural order, for sorting."""
    expr = F.when(window == order[0], 0)
    for i, label in enumerate(order[1:], 1):
        expr = expr.when(window == label, i)
    return expr


def metric_delta(metrics: DataFrame, group: str, window: str, first: str, last: str, names: list[str]) -> DataFrame:
    """Each metric at two windows and its change, one row per group."""
    def at(label, name):
        return F.max(F.when(F.col(window) == label, F.col(name)))

    wide = metrics.groupBy(group).agg(
        *[at(w, n).alias(f"{n}_{side}") for n in names for w, side in ((first, "first"), (last, "last"))]
    )
    return wide.withColumns({f"{n}_delta": F.col(f"{n}_last") - F.col(f"{n}_first") for n in names})


COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.6)


def risk_coverage(df: DataFrame, score: str, label: str, coverages=COVERAGES, slots: int | None = None) -> DataFrame:
    """AUROC of the rows whose entropy is at most its percentile, per coverage.

    Rows tied with the threshold stay in. Rows are counted per distinct score
    before they are repeated for every coverage they belong to.
    """
    clean = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    scored = clean.withColumn("__entropy", binary_entropy(F.col(score).cast("double")))
    names = {f"t{i}": c for i, c in enumerate(coverages)}
    limits = exact_percentiles(scored, ["__entropy"], names, slots).select(F.struct(*names).alias("t")).scalar()
    bounds = [limits[n] for n in names]
    slotted = with_value_slots(scored, [score], ["__slot"], slots)
    inside = F.array(
        *[F.when(F.col("__entropy") <= b, F.lit(c)) for b, c in zip(bounds, names.values())]
    )
    counts = score_counts(slotted, score, label, ["__slot", "__entropy"])
    per_coverage = counts.select(
        "__slot", "score", "pos", "neg", F.explode(F.array_compact(inside)).alias("coverage")
    )
    points = with_running(
        per_coverage, "__slot", [F.col("score").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")}, ["coverage"], descending=True,
    )
    points = points.withColumnsRenamed({"tp_total": "P", "fp_total": "N"})
    return (
        points.groupBy("coverage", "P", "N")
        .agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"))
        .select(
            "coverage",
            (1 - F.col("coverage")).alias("deferral"),
            (F.col("P") + F.col("N")).alias("n"),
            _ratio(F.col("area"), F.col("P") * F.col("N")).alias("auroc"),
        )
    )
