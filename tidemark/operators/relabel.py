"""Two-level relabelling: by a topic's most frequent texts, then by the row's own text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import joined_modes
from tidemark.operators.columns import require_columns
from tidemark.operators.rules import substring_label, word_label
from tidemark.session import cut_lineage

OTHER = "Other/Unclassified"


def topic_labels(df: DataFrame, topic: str, text: str, overrides, groups, k: int = 10) -> DataFrame:
    """topic, topic_label, confidence from the k most frequent texts of each topic."""
    modes = joined_modes(df.filter(F.col(topic) != -1), topic, text, k, " | ", "sample_text")
    sample = F.lower("sample_text")
    labelled = modes.select(
        topic, word_label(sample, overrides).alias("__strong"), substring_label(sample, groups).alias("__rule")
    )
    confidence = (
        F.when(F.col("__strong").isNotNull(), "high").when(F.col("__rule").isNotNull(), "medium").otherwise("low")
    )
    return labelled.select(
        topic,
        F.coalesce("__strong", "__rule", F.lit(OTHER)).alias("topic_label"),
        confidence.alias("confidence"),
    )


def relabel(df: DataFrame, topic: str, text: str, label: str, overrides, groups, k: int = 10) -> DataFrame:
    """Replace ``label``; keep the old one in ``<label>_orig`` and add ``<label>_confidence``.

    A row override beats the topic's label and leaves the confidence as it is.
    Noise keeps the default label until a row override applies.
    """
    require_columns(df, [topic, text, label])
    # stored: with a known small size it is joined where the rows are, not all rows of a topic in one task
    named = cut_lineage(topic_labels(df, topic, text, overrides, groups, k))
    joined = df.withColumnRenamed(label, f"{label}_orig").join(named, topic, "left")
    noise = F.col(topic) == -1
    base = F.coalesce(F.col("topic_label"), F.lit(OTHER))
    return (
        joined.withColumn(label, F.coalesce(word_label(F.col(text), overrides), base))
        .withColumn(
            f"{label}_confidence",
            F.when(noise, "noise").otherwise(F.coalesce(F.col("confidence"), F.lit("low"))),
        )
        .drop("topic_label", "confidence")
    )
