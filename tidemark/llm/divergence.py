"""How far the sources of a language use its vocabulary differently, on run-length columns.

Terms that occur equally often in every source are one run of all columns at
once. What is left is put in an order in which equal counts of the largest
sources lie together, every source's column is cut into runs of equal
probability, and the sum over all terms for a pair of sources is one over the
runs between the two columns' boundaries, each times its length.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import raw, slices
from tidemark.session import cut_lineage

# every byte of a term as it is counted, every other byte as a blank; code points from 0x80 on are bytes from 0x80 on
TERM = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
SCALE = 1_000_000_000
HELD = 500_000  # counts that a task holds before it sends them on
BLOCK = 20_000  # distinct runs of counts that one task lays in columns
COUNTS = "lang string, source string, term string, count long, docs long"


def group_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, count, docs): occurrences and rows that hold the term, per group.

    All rows of a language's term are in one partition, so that work per
    (lang, term) needs no further shuffle.
    """

    def tell(held: dict) -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, source), (counts, docs) in held.items():
            own = ([lang] * len(counts), [source] * len(counts), [t.decode() for t in counts], counts.values(), map(docs.__getitem__, counts))
            for column, values in zip(columns, own):
                column.extend(values)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in COUNTS.split(", ")])

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), raw(part.column("text"))):
                    counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(counts)
                    terms = text.translate(TERM).split()
                    counts.update(terms)
                    docs.update(set(terms))
                    size += len(counts)
                if size > HELD:
                    yield tell(held)
                    held, size = {}, 0
        if size:
            yield tell(held)

    none = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), none).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    return rows.mapInArrow(count, COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    scaled = (wide(count) + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, wide(total + terms)).cast("long")


def contribution(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), exactly; p is at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _runs(column: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the runs of a column, and where they end; ``ends`` are those of its rows."""
    last = np.flatnonzero(np.append(column[1:] != column[:-1], True))
    return column[last], ends[last]


def pair_sums(rows: pa.Table, sources: pa.Table) -> pa.Table:
    """(lang, number, other, value) of one block: for each ordered pair of sources, f times run length over its terms.

    ``rows``: lists of sources (by their number, ascending) and probabilities
    of runs of terms, and how many terms they are. ``sources``: number and the
    probability of a term that does not occur.
    """
    number = sources.column("number").to_numpy()
    absent = dict(zip(number.tolist(), sources.column("absent").to_pylist()))
    lists = list(zip(rows.column("numbers").to_pylist(), rows.column("ps").to_pylist()))
    # equal counts of the first (largest) sources lie together
    order = sorted(range(len(lists)), key=lambda i: list(zip(*lists[i])))
    ends = np.cumsum(rows.column("terms").to_numpy()[order])
    places, at = {n: [] for n in absent}, {n: [] for n in absent}
    for place, i in enumerate(order):
        for n, p in zip(*lists[i]):
            places[n].append(place)
            at[n].append(p)
    runs = []
    for n in number.tolist():
        column = np.full(len(order), absent[n], np.int64)
        column[places[n]] = at[n]
        runs.append(_runs(column, ends))
    out = []
    for i, (p, p_ends) in enumerate(runs):
        for j in range(i):
            q, q_ends = runs[j]
            cuts = np.union1d(p_ends, q_ends)
            length = np.diff(cuts, prepend=0)
            a, b = p[np.searchsorted(p_ends, cuts)], q[np.searchsorted(q_ends, cuts)]
            square = (a - b) * (a - b)
            out.append((number[i], number[j], int((square // b * length).sum())))
            out.append((number[j], number[i], int((square // a * length).sum())))
    mine, other, value = (np.array(x, np.int64) for x in (zip(*out) if out else ([], [], [])))
    lang = [rows.column("lang")[0].as_py()] * len(out)
    return pa.table({"lang": pa.array(lang, pa.string()), "number": mine, "other": other, "value": value})


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, top: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank): how every group (lang, source) differs from the language's other groups and from the language.

    A language keeps the terms that at least ``min_docs`` of its rows hold.
    With their V and N, the occurrences of all kept terms in a group or
    language, a term has p = 1 + floor(10^9 (count + 1) / (N + V)), and f of p
    against q is floor((p - q)^2 / q). Part ``pair`` has a row for every other
    source of the language, f summed over all kept terms; part ``term`` the
    ``top`` kept terms that the group has and uses more than the language.
    Ties rank by item, in UTF-8 order.

    Null texts, languages and sources are empty; texts without terms count as
    rows of their group only. Rows that repeat an id are rows of their own. A
    very long text is counted as one row, in a task that holds its distinct
    terms. A language without kept terms has pairs of value 0 and no terms. No
    rows give no groups. Other columns are not read.
    """
    none = F.lit("")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), none).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    per_term = Window.partitionBy("lang", "term")
    counts = group_terms(docs, lang, source, text).withColumns({"lang_count": F.sum("count").over(per_term), "docs": F.sum("docs").over(per_term)})
    counts = cut_lineage(counts.filter(F.col("docs") >= min_docs).drop("docs"))
    # every group, its N and that of its language, V, and its number: the largest is first
    of_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_lang = counts.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total"), zero("v"), zero("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source")).cast("long")
    groups = cut_lineage(groups.withColumn("number", number))
    in_group = counts.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("count"), F.col("total"), F.col("v")))

    terms = in_group.withColumn("q", probability(F.col("lang_count"), F.col("lang_total"), F.col("v"))).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), contribution(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # terms with the same counts everywhere are one run of all columns
    vectors = in_group.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("number", "p"))).alias("vector"))
    vectors = cut_lineage(vectors.groupBy("lang", "vector").agg(F.count("*").alias("terms")))
    blocks = vectors.count() // BLOCK + 1
    rows = vectors.select(
        "lang", F.pmod(F.xxhash64("vector"), F.lit(blocks)).alias("block"), F.col("vector.number").alias("numbers"), F.col("vector.p").alias("ps"), "terms"
    )
    absent = probability(F.lit(0), F.col("total"), F.col("v"))
    held = rows.select(F.col("lang").alias("of"), F.col("block").alias("at")).distinct()
    told = groups.filter("v > 0").join(held, F.col("lang") == F.col("of"))
    told = told.select(F.col("of").alias("lang"), F.col("at").alias("block"), "number", absent.alias("absent"))
    sums = rows.groupBy("lang", "block").cogroup(told.groupBy("lang", "block")).applyInArrow(pair_sums, "lang string, number long, other long, value long")
    # every pair is there, also where no term is kept
    others = groups.groupBy("lang").agg(F.collect_list("number").alias("others"))
    grid = groups.filter("v = 0").select("lang", "number").join(others, "lang").select("lang", "number", F.explode("others").alias("other"), F.lit(0).cast("long").alias("value"))
    sums = sums.unionByName(grid.filter("number <> other")).groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "number", "source")
    pairs = sums.join(names, ["lang", "number"]).join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
