"""Exact Jaccard links between word-shingle sets by parity sketches.

Every shingle flips one bit of a very wide bit sketch, so two sketches differ
in at most as many bits as the sets differ in shingles. A pair that reaches
the threshold and whose larger set has at most ``u`` shingles differs in at
most ``d = 2u(1-t)/(1+t)`` of them. The sketch of a size band is cut into
``d + 1 + 2e`` slices: at least ``2e + 1`` slices of such a pair are equal, so
each set may leave out its ``e - m`` emptiest slices and the pair still meets
in ``2m + 1``. A slice is kept as the 64-bit XOR of the shingles in it. Long
texts that merely share some runs of words meet in a few slices, more of them
the larger the table is; they are told by that number before sets are moved.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.meetings import SENT, Meetings, bit_filter, passes
from tidemark.llm.sent import sent
from tidemark.llm.words import MASK, ODD, mix, raw, shingle_set, slices
from tidemark.operators.graph import connected_components
from tidemark.session import cut_lineage, discard, release

KEYS_PER_GROUP = 400_000  # slice keys that one task compares at a time
KEYS_AT_ONCE = 2_000_000  # slice keys that a task holds before it sends them on
SKETCH_WORDS = 8  # 64-bit words of the narrow sketch that is compared before two sets are
FILTER_BITS = 1 << 24  # of the filter of wanted ids, at least; it grows with them
MOST_FILTER_BITS = 1 << 30  # beyond, more rows pass and are shingled in vain
FILTER_ROOM = 8  # bits for each wanted id
WHOLE = 256  # shingles of sets that are verified by all 64 bits
STAR = 32  # sets that are verified against one at a time, about
NEEDS = ["need", "low", "high"]  # of slices, see ``Bands.needed``
DRAWS = 2  # rounds that join what is easily joined, before all other pairs are compared


@dataclass(frozen=True)
class Bands:
    """Size bands and their slices for similarity ``num / den``.

    Band ``c`` finds the pairs whose larger set is above its predecessor's
    upper end and within its own.
    """

    num: int
    den: int
    ratio: float = 1.25
    spare: float = 0.12
    kept: float = 0.25  # of the spare slices

    def upper(self, n: int) -> tuple[int, int]:
        """Number and upper end of the band of ``n``."""
        band, end = 0, 1
        while end < n:
            band, end = band + 1, max(end + 1, int(end * self.ratio))
        return band, end

    def _cut(self, end: int) -> tuple[int, int, int]:
        """Slices, spare slices and those of them that are not left out, in the band that ends at ``end``."""
        differ = 2 * end * (self.den - self.num) // (self.den + self.num)
        spare = int(self.spare * (differ + 1))
        return differ and differ + 1 + 2 * spare, spare, math.ceil(self.kept * spare)

    def needed(self, n: int) -> tuple[int, int, int]:
        """Slices in which a set of ``n`` shingles meets each partner at least, and the sums of these numbers below its bands and with them.

        What a pair needs in all bands that it shares is the smaller of the
        second sums less the larger of the first. In a band it is one less than
        are equal, as two slices of a set may have one key.
        """
        own, last = self.upper(n)[0], self.upper(n * self.den // self.num)[0]
        each, end = [], 1
        while len(each) <= last:
            each.append(2 * self._cut(end)[2])
            end = max(end + 1, int(end * self.ratio))
        return max(1, each[own]), sum(each[:own]), sum(each)

    def of(self, n: int):
        """Bands in which a set of ``n`` shingles takes part: number, slices, slices left out."""
        band, end = self.upper(n)
        last = self.upper(n * self.den // self.num)[0]
        while band <= last:
            count, spare, kept = self._cut(end)
            if count:  # else two different sets cannot reach the threshold
                yield band, count, spare - kept
            band, end = band + 1, max(end + 1, int(end * self.ratio))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """64-bit keys of the slices of a sorted shingle set in all its bands."""
        high, out = shingles >> np.uint64(32), []
        for band, count, out_of_it in self.of(len(shingles)):
            slice_of = ((high * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
            filled, starts, sizes = np.unique(slice_of, return_index=True, return_counts=True)
            values = np.zeros(count, np.uint64)
            values[filled] = np.bitwise_xor.reduceat(shingles, starts)
            held = np.zeros(count, np.int64)
            held[filled] = sizes
            kept = np.argsort(held, kind="stable")[out_of_it:]
            salt = np.uint64((band + 1) * int(ODD) & MASK)
            out.append(mix(mix(values[kept] + salt) + kept.astype(np.uint64) * ODD))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _class(shingles: np.ndarray) -> int | None:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes())) if len(shingles) else None


def _narrow(shingles: np.ndarray) -> list[int]:
    """Parity sketch of ``64 * SKETCH_WORDS`` bits."""
    width = 64 * SKETCH_WORDS
    bits = np.bincount((mix(shingles) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def shingled(docs: DataFrame, id: str, text: str, k: int, bands: Bands) -> DataFrame:
    """(id, text_hash, n, need, low, high, class, sketch) of every row; equal sets have equal classes, a row without words has none."""

    def tell(batches):
        needed = {}
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, k) for t in raw(part.column("text"))]
                needed |= {n: bands.needed(n) for n in {len(s) for s in sets} - needed.keys()}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(x, pa.int32()) for x in zip(*(needed[len(s)] for s in sets))),
                        pa.array([_class(s) for s in sets], pa.int64()),
                        pa.array([_narrow(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "text_hash", "n", *NEEDS, "class", "sketch"],
                )

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(tell, "id long, text_hash long, n long, need int, low int, high int, class long, sketch array<long>")


def members(docs: DataFrame, text: str, k: int, bands: Bands, groups: int) -> DataFrame:
    """(key, class): the slices that at least two classes have in common."""
    meetings = Meetings(groups, narrow=True)

    def send(batches):
        keys, classes, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for t in raw(part.column("text")):
                    shingles = shingle_set(t, k)
                    own = bands.keys(shingles)
                    keys.append(own)
                    classes.append(np.full(len(own), _class(shingles) or 0, np.int64))
                    held += len(own)
                    if held >= KEYS_AT_ONCE:
                        yield from meetings.send(np.concatenate(keys), np.concatenate(classes))
                        keys, classes, held = [], [], 0
        if held:
            yield from meetings.send(np.concatenate(keys), np.concatenate(classes))

    def compare(table: pa.Table) -> pa.Table:
        key, cls = meetings.compare(table)
        return pa.table({"key": pa.array(key.view(np.int64)), "class": pa.array(cls)})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(send, SENT)
    return rows.groupBy("group").applyInArrow(compare, "key long, class long")


def _stored(shingles: np.ndarray) -> bytes:
    """A sorted set; one of more than ``WHOLE`` shingles keeps 32 bits of each."""
    return shingles.tobytes() if len(shingles) <= WHOLE else np.sort(shingles.astype(np.uint32)).tobytes()


def _common(x: tuple[int, bytes], y: tuple[int, bytes]) -> int:
    """Shingles that two stored sets have in common.

    Equal 32 bits count as often as both sets have them, so the count is never
    too small. Near the threshold it is too large about once in 10^8 pairs.
    """
    n = [m for m, _ in (x, y)]
    sets = [np.frombuffer(held, np.uint64 if len(held) == 8 * m else np.uint32) for m, held in (x, y)]
    if max(n) <= WHOLE:
        return np.intersect1d(*sets, assume_unique=True).size
    (a, times), (b, again) = (np.unique(s.astype(np.uint32), return_counts=True) for s in sets)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(times[i], again[j]).sum())


def _sets(docs: DataFrame, id: str, text: str, k: int, nodes: DataFrame) -> DataFrame:
    """(class, n, shingles) for the classes in ``nodes`` (id, class), made once for all rounds.

    Only rows whose id a bit filter lets through are shingled again; any of
    the rows of a class stands for it.
    """
    bits = FILTER_BITS
    while bits < FILTER_ROOM * nodes.count() and bits < MOST_FILTER_BITS:
        bits *= 2
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    table = sent(docs.sparkSession, bit_filter(nodes, [spot], bits))

    def cut(batches):
        bits = table()
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column("spot").to_numpy(zero_copy_only=False))))
            for part in slices(batch) if batch.num_rows else ():
                sets = [shingle_set(t, k) for t in raw(part.column("text"))]
                columns = [pa.array(map(_class, sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_stored, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["class", "n", "shingles"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("spot", spot)
    found = rows.mapInArrow(cut, "class long, n long, shingles binary").filter("class is not null")
    return found.groupBy("class").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold.

    The pairs of one ``b`` are verified together, some ``STAR`` at a time, so
    that a set moves once for each group that needs it and not for each pair.
    """
    pairs = pairs.distinct()
    many = pairs.groupBy("b").agg(F.count("*").alias("n"))
    stars = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.floor(F.col("n") / STAR) + 1).alias("star"), "a")
    stars = cut_lineage(stars)
    needed = stars.select("b", "star", F.col("a").alias("class")).union(stars.select("b", "star", "b").distinct())

    def weigh(table: pa.Table) -> pa.Table:
        hub = table.column("b")[0].as_py()
        held = dict(zip(table.column("class").to_pylist(), zip(table.column("n").to_pylist(), table.column("shingles").to_pylist())))
        y = held.pop(hub)
        linked = []
        for a, x in held.items():
            common = _common(x, y)
            if den * common >= num * (x[0] + y[0] - common):
                linked.append(a)
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([hub] * len(linked), pa.int64())})

    found = cut_lineage(needed.join(sets, "class").groupBy("b", "star").applyInArrow(weigh, "a long, b long"))
    discard(stars)
    return found


def _apart():
    """Bits in which two narrow sketches differ: at most as many as there are shingles in one set only."""
    return F.aggregate(F.zip_with("sketch", "sketch2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _possible(num: int, den: int):
    """Whether sizes and narrow sketches leave room for the threshold."""
    total = F.col("n") + F.col("n2")
    return (F.least("n", "n2") * den >= F.greatest("n", "n2") * num) & (_apart() * (den + num) <= total * (den - num))


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Rows link when ``den * |A & B| >= num * |A | B|`` for their sets of
    ``k``-word shingles (A-Z lower-cased); ``component_id`` is the smallest id
    that links reach. Every pair of different sets that may link is either
    verified or already known to be in one component.

    Null and empty texts and texts without words have no shingles and stay
    alone; a text of fewer than ``k`` words is one shingle. A very long text
    is one set, which a task holds whole. Repeated rows are links of
    similarity 1. A row with a null id takes part; its component is the
    smallest id that is not null, or null. Other columns are not read. Sets
    are compared as hashes (see ``_common``). An empty table gives no rows.
    """
    found = keyed_components(docs, id, text, k, num, den)
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def first_of_components(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the only one of their group of near copies, or its one with the smallest id.

    Different texts with one id are told apart: of those in one group the one
    with the smallest hash stays, those in other groups stay beside it. Rows
    that repeat id and text are one; rows without an id all stay, and so do
    rows without words. All columns come back, whatever their names.
    """
    found = keyed_components(docs, id, text, k, num, den).filter("id is not null")
    key = F.struct("id", "text_hash").alias("key")
    first = found.filter("root is not null").groupBy("root").agg(F.min(key).alias("key")).select("key.*")
    first = first.union(found.filter("root is null").select("id", "text_hash").distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash"))
    kept = rows.filter("id is not null").join(cut_lineage(first), ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    return kept.select("row.*").unionByName(docs.filter(F.col(id).isNull()))


def keyed_components(docs: DataFrame, id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(id, text_hash, n, root, component_id) for every row; root names the component and is null without words."""
    bands = Bands(num, den)
    rows = cut_lineage(shingled(docs, id, text, k, bands))
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("n", *NEEDS, "sketch"))
    )
    # about one slice for each six shingles, in about two bands
    total = rows.agg(F.sum("n")).first()[0] or 0
    groups = int(total * 2.5 * (den - num) / (den + num)) // KEYS_PER_GROUP + 1
    found = cut_lineage(members(docs, text, k, bands, groups))
    # a class that meets others in fewer slices than it must share with a partner has none
    held = found.groupBy("class").agg(F.count("*").alias("held"))
    nodes = cut_lineage(classes.join(held, "class").filter("held >= need").drop("held", "need"))
    met = cut_lineage(found.join(nodes.select("class"), "class").select("key", "class"))
    discard(found)

    sets = cut_lineage(_sets(docs, id, text, k, nodes.select("id", "class")))
    release(docs.sparkSession)

    def verified(pairs):
        found = _verified(pairs, sets, num, den)
        release(docs.sparkSession)
        return found

    sizes = nodes.select("class", "n", "low", "high", "sketch")
    own = sizes.drop("low", "high").withColumnRenamed("class", "a")
    other = sizes.select(F.col("class").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    able = lambda pairs: pairs.join(own, "a").join(other, "b").filter(_possible(num, den))

    # each class with the smallest one that it meets anywhere
    least = met.groupBy("key").agg(F.min("class").alias("b"))
    best = met.join(least, "key").groupBy(F.col("class").alias("a")).agg(F.min("b").alias("b")).filter("a <> b")
    links = verified(able(best).select("a", "b"))
    # in slices that hold several components, each class with the nearest of the random ones that slices put forward
    for turn in range(DRAWS):
        known = _labelled(met, _roots(links))
        drawn = F.min(F.struct(F.xxhash64("key", "class", F.lit(turn)).alias("draw"), "class", "root")).alias("drawn")
        drawn = known.groupBy("key").agg(drawn, F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        near = known.join(drawn, "key").filter("root <> drawn.root").select(F.col("class").alias("a"), F.col("drawn.class").alias("b"))
        near = able(near.distinct()).groupBy("a").agg(F.min(F.struct(_apart().alias("apart"), "b")).alias("near"))
        links = cut_lineage(links.union(verified(near.select("a", "near.b"))))
        discard(known)
    # in slices that still hold several components: all that are outside the first one's, with all others. Such a slice
    # gives a pair of two components once, so that the count tells in how many slices it meets
    known = _labelled(met, _roots(links))
    ends = known.groupBy("key").agg(F.min(F.struct("class", "root")).alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = known.join(ends.filter("low <> high"), "key")
    mixed = mixed.select("key", "class", "root", (F.col("root") == F.col("least.root")).alias("main"))
    mixed = cut_lineage(mixed.join(sizes, "class"))
    discard(known, met)
    release(docs.sparkSession)
    right = mixed.select("key", *(F.col(c).alias(f"{c}2") for c in ("class", "root", "n", "low", "high", "sketch", "main")))
    rest = mixed.filter("not main").join(right, "key").filter("root <> root2 and (main2 or class < class2)").filter(_possible(num, den))
    ends = [F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")]
    need = F.least("high", "high2") - F.greatest("low", "low2")
    rest = rest.groupBy(*ends, need.alias("need")).agg(F.count("*").alias("common")).filter("common >= need")
    links = links.union(verified(rest.select("a", "b")))
    discard(mixed, sets)

    roots = _roots(links)
    named = classes.select("class", "id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "root").select("class", "root", "component_id")
    return rows.join(named, "class", "left").select(
        "id", "text_hash", "n", "root", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _roots(links: DataFrame) -> DataFrame:
    """(class, root): smallest class of the component, for all classes that have links."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    return connected_components(ends, links).withColumnRenamed("node", "class")


def _labelled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, class, root); a class without links is its own root."""
    rows = met.join(roots, "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    return cut_lineage(rows)
