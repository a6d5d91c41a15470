"""Free text to labelled topics."""

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import clinical_values as values
from tidemark.functions.text import clean_deid, default_text, expand_abbreviations, prepare_text
from tidemark.operators import reports
from tidemark.operators.clustering import reduce_dimensions, weighted_words
from tidemark.operators.density import projected_clusters
from tidemark.operators.parallel import spread
from tidemark.operators.relabel import OTHER
from tidemark.operators.rules import substring_label
from tidemark.operators.topics import (
    apply_merge,
    apply_split,
    heaviest_terms,
    merge_map,
    oversized_topics,
    stop_words,
    term_counts,
    top_words,
    topic_keywords,
    topic_word_sets,
    topic_word_weights,
    word_heterogeneity,
)
from tidemark.session import cut_lineage


def expanded(triage: DataFrame, text: str = "chiefcomplaint", pairs=values.ABBREVIATIONS) -> DataFrame:
    """Rows with a text, and its expansion in ``<text>_expanded``."""
    return spread(triage.filter(F.col(text).isNotNull())).withColumn(
        f"{text}_expanded", expand_abbreviations(F.col(text), pairs)
    )


def prepared(df: DataFrame, text: str = "chiefcomplaint_expanded", output: str = "chiefcomplaint_proc") -> DataFrame:
    return df.withColumn(output, prepare_text(F.col(text)))


def preparation_counts(df: DataFrame, text: str = "chiefcomplaint_expanded") -> DataFrame:
    """How many texts were blank, changed by cleaning, or emptied by it."""
    first = default_text(F.col(text))
    cleaned = clean_deid(first)
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(blank).alias("n_blank"),
        F.count_if(cleaned != first).alias("n_changed"),
        F.count_if(cleaned == "").alias("n_emptied"),
    )


def domain_stop_words() -> list[str]:
    base = StopWordsRemover.loadDefaultStopWords("english")
    return stop_words(base, values.KEPT_STOP_WORDS, values.EXTRA_STOP_WORDS)


def assign_topics(df: DataFrame, text: str, width: float = 1.0, min_samples: int = 10, min_cluster_size: int = 600,
                  dimensions: int = 10, topic: str = "cc_topic") -> DataFrame:
    """Text vectors, reduction and clustering in one step."""
    vectors = weighted_words(spread(df), text, "__vector")
    reduced = reduce_dimensions(vectors, "__vector", "__reduced", dimensions).drop("__vector")
    return projected_clusters(reduced, "__reduced", dimensions, width, min_samples, min_cluster_size, topic).drop("__reduced")


def split_largest(df: DataFrame, text: str, key: str, topic: str = "cc_topic", share: float = 0.15, above: Column | None = None,
                  **settings) -> DataFrame:
    """Cluster the texts of oversized topics again, topic by topic (at most three); new ids lie above ``above``."""
    targets = cut_lineage(oversized_topics(df, topic, share))
    inner = {"min_samples": 5, "min_cluster_size": 200, "dimensions": 8, **settings}
    subs = None
    for row in targets.select("topic").collect():
        part = df.filter(F.col(topic) == row["topic"]).select(key, text)
        found = assign_topics(part, text, topic="sub_topic", **inner).select(key, "sub_topic")
        subs = found if subs is None else subs.unionByName(found)
    if subs is None:
        return df
    return apply_split(df.join(subs, key, "left"), topic, "sub_topic", targets, above).drop("sub_topic")


def label_topics(df: DataFrame, text: str, topic: str = "cc_topic", groups=(), stop=None, min_topics: int = 5,
                 max_share: float = 0.95, transitive: bool = True, vectors: DataFrame | None = None,
                 key: str | None = None, split: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with merged topics, keywords and label; top words per original topic).

    Merge, split, heterogeneity, keywords, label. Topics all of whose words
    fall to the limits are demoted like others without words. ``split``
    (settings of ``split_largest``, which needs ``key``) clusters oversized
    topics again; their parts have a fixed keyword. ``vectors`` (word, vector)
    adds ``cc_heterogeneity``, which is null for noise and for parts.
    """
    stop = stop if stop is not None else domain_stop_words()
    if min_topics > 1:
        counts = term_counts(df, topic, text, stop, min_topics=min_topics, max_share=max_share)
        top = cut_lineage(top_words(topic_word_weights(counts), 10))
    else:
        top = cut_lineage(heaviest_terms(df, topic, text, 10, stop, max_share=max_share))
    sizes = df.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    # tables of one row per topic are stored: a known small size lets rows stay where they are, not all of a topic in one task
    mapping = cut_lineage(merge_map(topic_word_sets(top, topics=sizes), sizes, transitive=transitive))
    merged = apply_merge(df, mapping, topic)
    if split is not None:
        merged = split_largest(cut_lineage(merged), text, key, topic, above=df.agg(F.max(topic).alias("m")).scalar(), **split)
    if vectors is not None:
        scores = word_heterogeneity(top, vectors).select(F.col("topic").alias(topic), F.col("heterogeneity").alias("cc_heterogeneity"))
        merged = merged.join(scores, topic, "left")
    return with_keywords(merged, cut_lineage(topic_keywords(top, topics=sizes)), topic, groups), top


def with_keywords(df: DataFrame, keywords: DataFrame, topic: str = "cc_topic", groups=()) -> DataFrame:
    """Keyword string and its substring label per row; split-off topics have a fixed keyword."""
    joined = df.join(keywords.withColumnRenamed("topic", topic), topic, "left")
    named = joined.withColumn(
        "cc_keywords",
        F.coalesce(
            F.when(F.col(topic) == -1, F.lit("Noise/Outlier")), F.col("keywords"), F.lit("reclustered_subtopic")
        ),
    ).drop("keywords")
    return named.withColumn(
        "cc_system", substring_label(F.col("cc_keywords"), list(groups), OTHER, fold_case=True)
    )


def topic_report(df: DataFrame, topic: str, label: str, scores: DataFrame, n_merged: int) -> dict[str, DataFrame]:
    """The diagnostic tables of a topic run."""
    summary = reports.topic_summary(df, topic)
    worst = scores.filter(F.col(topic) != -1).agg(F.max("heterogeneity").alias("w")).scalar()
    return {
        "summary": summary,
        "heterogeneous": reports.most_heterogeneous(scores, topic),
        "labels": reports.label_distribution(df, topic, label),
        "checklist": reports.method_checklist(summary, F.lit(n_merged), worst),
    }
