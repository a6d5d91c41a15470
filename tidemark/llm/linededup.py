"""Lines that several documents hold stay only in the first of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST = (1 << 63) - 1  # stands for a null id: the last document


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 10, threshold: int = 2
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` in place of equally named columns.

    A line goes if its key has at least ``min_chars`` code points, is held by
    at least ``threshold`` different ids, and the row's id is not the smallest
    of these. Other lines stay in their order, joined by line feeds.

    A null or empty text is one empty line. A null id counts as one document
    after all others. Rows that repeat an id are the same document, and each
    is cleaned by itself. Keys are compared by 128-bit hashes.
    """
    taken = [c for c in docs.columns if c not in (id, text, "kept_text", "n_lines", "n_dropped")]
    rows = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("_id"),
        F.xxhash64(F.col(text)).alias("_text_hash"),
        F.col(text).alias("_text"),
    )
    lines = rows.select("_id", "_text_hash", F.posexplode(_lines(F.col("_text"))).alias("_at", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).filter(F.char_length("_key") >= min_chars)
    lines = lines.select(
        "_id", "_text_hash", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), F.col("_key")).alias("_h2")
    )
    count = F.count_distinct("_id") if threshold > 2 else F.when(F.min("_id") < F.max("_id"), 2).otherwise(1)
    shared = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), count.alias("_docs"))
    shared = cut_lineage(shared.filter(F.col("_docs") >= threshold).drop("_docs"))
    dropped = (
        lines.join(shared, ["_h1", "_h2"])
        .filter("_id > _first")
        .groupBy("_id", "_text_hash")
        .agg(F.array_sort(F.collect_set("_at")).alias("_dropped"))
    )
    # the caller's columns are one, so that none can clash
    whole = docs.select(
        F.struct(F.col(id).alias("_0"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(taken, 1))).alias("_row"),
        F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("_id"),
        F.xxhash64(F.col(text)).alias("_text_hash"),
        F.col(text).alias("_text"),
    )
    # what lies between two dropped lines is one slice, so long texts cost no more than their length
    ends = F.concat(F.array(F.lit(-1)), F.col("_dropped"), F.array(F.size("_lines")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("_dropped")),
        lambda i: F.slice("_lines", F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1),
    )
    kept = F.when(F.col("_dropped").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.flatten(pieces), "\n"))
    told = F.struct(
        kept.alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    found = whole.join(dropped, ["_id", "_text_hash"], "left").select("_row", "_text", "_dropped", _lines(F.col("_text")).alias("_lines"))
    names = [F.col(f"_row._{i}").alias(c) for i, c in enumerate(taken, 1)]
    return found.select("_row", "_text", told.alias("_told")).select(F.col("_row._0").alias(id), F.col("_text").alias(text), *names, "_told.*")
