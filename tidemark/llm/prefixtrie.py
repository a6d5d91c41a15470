"""A trie over the turns of conversations: what conversations with a common beginning share.

A node is a distinct sequence of first turns. It is named by two 64-bit sums
over its turns' hashes and places, so that every task names it alike. Nodes
whose subtree holds more turns than a shard should are the upper nodes; they
and their totals are few and are merged globally. Below them hang the prefix
shards: whole subtrees, dealt out by their top. A task packs its shard into a
double array: the child of node ``s`` by turn ``t`` is ``BASE[s] + t``, and it
is there if ``CHECK`` of that place is ``s``.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import ODD, mix
from tidemark.session import cut_lineage

SHARD_TURNS = 200_000  # turns of distinct conversations in a shard, about
SPACE_BITS = 12  # members whose ids differ in these bits only are written into one text before hashing
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
PLACE = (np.uint64(ODD), np.uint64(0xA0761D6478BD642F))
FREE = 1024  # places that are tried at a time
TRIED = 16  # children for which all of them are tried at once
PATH = "conv_id long, first long, second long, depth int, h1 array<long>, h2 array<long>, words array<long>"


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of every conversation in order, as (h1, h2, words) without their texts.

    Order is by ``turn``, null first; rows that tie, by hash. Null roles and
    texts are empty. Rows without a conversation id belong to none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("told"),
            F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            F.xxhash64(role, text).alias("h1"),
            F.xxhash64(F.lit("turn"), text, role).alias("h2"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("turn"),
    )
    path = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(path.alias("path"))


def rebuilt(paths: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, path) in which every conversation begins as that of its group does.

    The first ``crc32(id) % most`` turns come from conversation
    ``id - id % group``, as far as it has so many; the others are its own.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = paths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most - 1).alias("head"))
    own = paths.select("conv_id", "path", base.alias("base"), h.alias("h"))
    none = F.slice("path", 1, 0)
    rest = F.when(F.size("path") > F.col("h"), F.slice("path", F.col("h") + 1, F.size("path"))).otherwise(none)
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, F.col("h")), rest).alias("path"))


def _names(h1: np.ndarray, h2: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the node behind each turn, for paths that lie one behind the other and begin at ``starts``."""
    n = len(h1)
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64) + np.uint64(1)
    out = []
    for h, salt in zip((h1, h2), PLACE):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(h.view(np.uint64)) + place * salt))])
        out.append((sums[1:] - np.repeat(sums[starts], sizes)).view(np.int64))
    return out[0], out[1]


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each list begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes


def named_paths(paths: DataFrame) -> DataFrame:
    """Paths with the name of their last node; the root's name is (0, 0)."""

    def name(batches):
        for batch in batches:
            h1, starts = _flat(batch.column("h1"))
            h2, _ = _flat(batch.column("h2"))
            sizes = np.diff(np.append(starts, len(h1)))
            last = np.where(sizes > 0, starts + sizes - 1, 0)
            ends = [np.where(sizes > 0, x[last], 0) if len(x) else np.zeros(len(sizes), np.int64) for x in _names(h1, h2, starts)]
            columns = [batch.column("conv_id"), pa.array(ends[0]), pa.array(ends[1]), pa.array(sizes.astype(np.int32)), *(batch.column(c) for c in ("h1", "h2", "words"))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PATH.split(", ")])

    return paths.select("conv_id", *(F.col(f"path.{c}").alias(c) for c in ("h1", "h2", "words"))).mapInArrow(name, PATH)


def _upper(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes with more than ``shard_turns`` turns of distinct paths in their subtree, and always the root.

    Their totals are sums over all shards.
    """

    def prefixes(batches):
        for batch in batches:
            h1, starts = _flat(batch.column("h1"))
            h2, _ = _flat(batch.column("h2"))
            words, _ = _flat(batch.column("words"))
            sizes = np.diff(np.append(starts, len(h1)))
            k1, k2 = _names(h1, h2, starts)
            begun = np.zeros(len(h1), bool)
            begun[starts[sizes > 0]] = True
            depth = np.arange(len(h1)) - np.repeat(starts, sizes) + 1
            back = [np.where(begun, 0, np.roll(k, 1)) for k in (k1, k2)]
            per = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (k1, k2, *back, depth, words, np.repeat(sizes, sizes) - depth + 1, per("copies"), per("least"))],
                ["k1", "k2", "b1", "b2", "depth", "words", "turns", "n_convs", "conv_id"],
            )

    kinds = "k1 long, k2 long, b1 long, b2 long, depth long, words long, turns long, n_convs long, conv_id long"
    first = [F.first(c).alias(c) for c in ("b1", "b2", "depth", "words")]
    sums = [F.sum("turns").alias("turns"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    below = distinct.select("h1", "h2", "words", "copies", "least").mapInArrow(prefixes, kinds).groupBy("k1", "k2").agg(*first, *sums)
    below = below.filter(F.col("turns") > shard_turns).drop("turns")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = distinct.agg(F.sum("copies").alias("n_convs"), F.min("least").alias("conv_id")).filter("n_convs is not null")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("b1"), none.alias("b2"), zero.alias("depth"), zero.alias("words"), "n_convs", "conv_id")
    return below.unionByName(root)


class DoubleArray:
    """BASE and CHECK over dense turn ids from 1; node 1 is the top."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.check[:2] = -1
        self.low = 2  # no place below is free

    def _grow(self, size: int):
        if size > len(self.check):
            more = np.zeros(max(size, 2 * len(self.check)) - len(self.check), np.int64)
            self.base, self.check = np.concatenate([self.base, more]), np.concatenate([self.check, more])

    def put(self, node: int, children: np.ndarray):
        """Gives ``node`` its children, sorted turn ids, at the lowest base that has room for all."""
        at, first, wide = self.low, int(children[0]), int(children[-1] - children[0])
        while True:
            self._grow(at + FREE + wide + 1)
            bases = at + np.flatnonzero(self.check[at : at + FREE] == 0) - first
            for turn in children[1:TRIED]:
                bases = bases[self.check[bases + turn] == 0]
            if len(children) > TRIED:
                rest = children[TRIED:]
                bases = [b for b in bases.tolist() if not self.check[b + rest].any()][:1]
            if len(bases):
                break
            at += FREE
        self.base[node] = bases[0]
        self.check[bases[0] + children] = node
        while self.check[self.low]:
            taken = self.check[self.low : self.low + FREE] != 0
            self.low += FREE if taken.all() else int(np.argmin(taken))
            self._grow(self.low + 1)

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Where ``turns`` lead from ``nodes``; 0 where there is no such child."""
        to = self.base[nodes] + turns
        to = np.where((to > 0) & (to < len(self.check)), to, 0)
        return np.where(self.check[to] == nodes, to, 0)


def build(paths: list[np.ndarray]) -> DoubleArray:
    """The double array of sorted distinct paths of turn ids."""
    trie = DoubleArray(2 * sum(map(len, paths)) + 64)
    level = [(1, 0, len(paths), 0)]
    while level:
        below = []
        for node, low, high, depth in level:
            while low < high and len(paths[low]) == depth:  # paths that end here come first
                low += 1
            if low == high:
                continue
            turns = np.array([p[depth] for p in paths[low:high]])
            starts = np.flatnonzero(np.append(True, turns[1:] != turns[:-1]))
            trie.put(node, turns[starts])
            ends = np.append(starts[1:], high - low)
            below += [(int(trie.base[node] + t), low + int(a), low + int(b), depth + 1) for t, a, b in zip(turns[starts], starts, ends)]
        level = below
    return trie


NODES = (
    "k1 long, k2 long, b1 long, b2 long, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long"
)


def _shard(table: pa.Table) -> pa.Table:
    """All nodes of the subtrees of one shard with their totals."""
    h1, starts = _flat(table.column("h1"))
    h2, _ = _flat(table.column("h2"))
    words, _ = _flat(table.column("words"))
    sizes = np.diff(np.append(starts, len(h1)))
    k1, k2 = _names(h1, h2, starts)
    copies, least = table.column("copies").to_numpy(), table.column("least").to_numpy()
    above = table.column("above").to_numpy().astype(np.int64)  # upper nodes below the root on the path
    # dense ids: the name of a subtree's top, then turns
    tops = starts + above
    pair = np.empty((len(h1), 2), np.int64)
    pair[:, 0], pair[:, 1] = h1, h2
    pair[tops, 0], pair[tops, 1] = k1[tops], k2[tops]
    kind = np.zeros(len(h1), np.int64)
    kind[tops] = 1
    order = np.lexsort((pair[:, 1], pair[:, 0], kind))
    same = (np.diff(pair[order], axis=0) == 0).all(axis=1) & (np.diff(kind[order]) == 0)
    dense = np.empty(len(h1), np.int64)
    dense[order] = 1 + np.concatenate([[0], np.cumsum(~same)])
    paths = [dense[a:b] for a, b in zip(tops, starts + sizes)]
    trie = build([paths[i] for i in sorted(range(len(paths)), key=lambda i: paths[i].astype(">i8").tobytes())])
    n = len(trie.check)
    convs, low, at = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    now, place = np.ones(len(paths), np.int64), tops.copy()
    active, levels = np.flatnonzero(sizes > above), []
    while len(active):
        now[active] = trie.step(now[active], dense[place[active]])
        seen = now[active]
        np.add.at(convs, seen, copies[active])
        np.minimum.at(low, seen, least[active])
        at[seen] = place[active]
        levels.append(np.unique(seen))
        place[active] += 1
        active = active[place[active] < (starts + sizes)[active]]
    children = np.bincount(trie.check[trie.check > 0], minlength=n)
    leaves = np.where((at >= 0) & (children == 0), 1, 0)
    saved = np.where(at >= 0, (convs - 1) * words[at], 0)
    for nodes in reversed(levels[1:]):
        np.add.at(leaves, trie.check[nodes], leaves[nodes])
        np.add.at(saved, trie.check[nodes], saved[nodes])
    nodes = np.concatenate(levels) if levels else np.empty(0, np.int64)
    own, up = at[nodes], trie.check[nodes]
    depth = own - np.repeat(starts, sizes)[own] + 1
    top = up == 1
    before = lambda k: np.where(depth > 1, k[own - 1], 0)
    columns = [k1[own], k2[own], before(k1), before(k2), top, depth, low[nodes], pa.array(low[up], mask=top), convs[nodes], children[nodes], leaves[nodes], saved[nodes]]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in NODES.split(", ")])


def _merged(upper: DataFrame, tops: DataFrame) -> DataFrame:
    """Upper nodes with totals over their subtrees.

    A round doubles the distance over which totals have been handed up.
    """
    key, back = ["k1", "k2"], ["b1", "b2"]
    hung = tops.groupBy("b1", "b2").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    inner = upper.filter("b1 is not null").groupBy("b1", "b2").agg(
        F.count("*").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")
    )
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    hung = hung.unionByName(inner).groupBy("b1", "b2").agg(*sums).toDF("k1", "k2", "n_children", "n_leaves", "saved_tokens")
    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = upper.join(hung, key, "left")
    nodes = nodes.withColumns(
        {
            "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(zero("n_leaves")),
            "n_children": zero("n_children"),
            "saved_tokens": zero("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
            "a1": F.col("b1"),
            "a2": F.col("b2"),
        }
    )
    nodes = cut_lineage(nodes)
    while not nodes.filter("a1 is not null").isEmpty():
        handed = nodes.filter("a1 is not null").groupBy("a1", "a2").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).toDF("k1", "k2", "l", "s")
        further = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("f1"), F.col("a2").alias("f2"))
        nodes = nodes.join(handed, key, "left").join(further, ["a1", "a2"], "left")
        nodes = nodes.withColumns(
            {"n_leaves": F.col("n_leaves") + zero("l"), "saved_tokens": F.col("saved_tokens") + zero("s"), "a1": F.col("f1"), "a2": F.col("f2")}
        ).drop("l", "s", "f1", "f2")
        nodes = cut_lineage(nodes)
    parents = nodes.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.drop("a1", "a2", "words").join(parents, back, "left")


def _ends(paths: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end.

    Members are written into texts for a range of ids each; only these texts
    of a node follow each other through one task, which keeps no more than the
    state of the hash.
    """

    def digest(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "members"))):
                if (k1, k2) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["k1", "k2", "ends_sha256"]), preserve_index=False)
        if now is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(*now, state.hexdigest())], columns=["k1", "k2", "ends_sha256"]), preserve_index=False)

    part = F.shiftright("conv_id", SPACE_BITS)
    texts = paths.groupBy(F.col("first").alias("k1"), F.col("second").alias("k2"), part.alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("members")
    )
    texts = texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part")
    return texts.select("k1", "k2", "members").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie_nodes(conversations: DataFrame, group: int = 20, most: int = 4, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie over the rebuilt conversations (see ``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256 as of ``NODES`` and ``_ends``.

    Null turn numbers come first, null roles and texts are empty, rows without
    a conversation id belong to no conversation. A repeated row is a further
    turn. Very long texts are hashed and counted where they are read and go no
    further. A conversation's hashes are one row. Other columns are not read.
    No conversations give no nodes. Equal turns are told by 128-bit hashes.
    """
    paths = cut_lineage(named_paths(rebuilt(turn_paths(conversations), group, most)))
    key = ["first", "second", "depth"]
    one = [F.first(c).alias(c) for c in ("h1", "h2", "words")]
    distinct = cut_lineage(paths.groupBy(*key).agg(F.count("*").alias("copies"), F.min("conv_id").alias("least"), *one))
    upper = cut_lineage(_upper(distinct, shard_turns))
    turns = distinct.agg(F.sum("depth")).first()[0] or 0
    shards = turns // shard_turns + 1
    cut = _cut(distinct, upper, shards)
    light = cut_lineage(cut.groupBy("shard").applyInArrow(_shard, NODES))
    tops = light.filter("top")
    merged = _merged(upper, tops)
    above = merged.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("conv_id").alias("above"))
    out = [F.col(c) for c in ("k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    tops = tops.drop("parent_conv_id").join(above, ["b1", "b2"]).withColumnRenamed("above", "parent_conv_id")
    nodes = light.filter("not top").select(*out).unionByName(tops.select(*out)).unionByName(merged.select(*out))
    nodes = nodes.join(_ends(paths), ["k1", "k2"], "left")
    return nodes.drop("k1", "k2").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def _cut(distinct: DataFrame, upper: DataFrame, shards: int) -> DataFrame:
    """Distinct paths that leave the upper nodes, with the number of those on them and the shard of what hangs below."""

    def prefixes(batches):
        for batch in batches:
            h1, starts = _flat(batch.column("h1"))
            h2, _ = _flat(batch.column("h2"))
            sizes = np.diff(np.append(starts, len(h1)))
            per = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
            columns = [*_names(h1, h2, starts), per("first"), per("second"), per("depth")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k1", "k2", "first", "second", "depth"])

    key = ["first", "second", "depth"]
    on = distinct.select("h1", "h2", *key).mapInArrow(prefixes, "k1 long, k2 long, first long, second long, depth int")
    # upper nodes of a path are its first ones, so their number is where it leaves them
    on = on.join(upper.filter("depth > 0").select("k1", "k2"), ["k1", "k2"]).groupBy(*key).agg(F.count("*").alias("above"))
    rows = distinct.join(on, key, "left").withColumn("above", F.coalesce("above", F.lit(0))).filter("depth > above")

    def deal(batches):
        for batch in batches:
            h1, starts = _flat(batch.column("h1"))
            h2, _ = _flat(batch.column("h2"))
            tops = starts + batch.column("above").to_numpy()
            k1, k2 = _names(h1, h2, starts)
            shard = mix(mix(k1[tops].view(np.uint64)) ^ k2[tops].view(np.uint64)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *batch.columns], ["shard", *batch.schema.names])

    rows = rows.select("above", "copies", "least", "h1", "h2", "words")
    return rows.mapInArrow(deal, "shard long, above long, copies long, least long, h1 array<long>, h2 array<long>, words array<long>")
