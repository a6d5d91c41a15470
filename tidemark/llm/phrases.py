"""Passages that recur in a corpus, located by Aho-Corasick automata and removed.

1. Every window of ``size`` words has one anchor, its run of ``ANCHOR`` words
   with the smallest hash. A window that recurs has an anchor that does, so a
   bit filter of the recurring anchors leaves few windows to be compared.
2. Windows whose anchor passes are compared over the whole corpus by hash;
   what meets is told to the blocks of documents that hold it.
3. In each block, neighbouring recurring windows join into passages, an
   automaton is compiled of the block's passages, and all documents of the
   block stream through it. Blocks are the shards: an automaton is no larger
   than the text of its block.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.meetings import SENT, Meetings, bit_filter, passes
from tidemark.llm.sent import sent
from tidemark.llm.words import gram_hashes, raw, rolling_hashes, slices, word_hashes
from tidemark.session import cut_lineage

ANCHOR = 8
BLOCK_CHARS = 4_000_000  # characters of a block of documents
HASHES_PER_GROUP = 400_000
HASHES_AT_ONCE = 1_000_000
FILTER_BITS = 1 << 26
RANGES = pa.list_(pa.struct([("begin_word", pa.int64()), ("end_word", pa.int64())]))
LETTERS = 1_000_000  # code points that stand for words


def anchor_places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word runs of anchor length, and for each window the place of its anchor (the first smallest)."""
    length = min(ANCHOR, size)
    grams = gram_hashes(hashes, length)
    span = size - length + 1
    if len(grams) < span:
        return grams, np.empty(0, np.int64)
    # running minima over spans, by doubling
    best, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        width += step
    return grams, best


def _anchors(rows: DataFrame, size: int, groups: int) -> DataFrame:
    """(anchor): hashes of the anchors that occur at two places or more."""
    meetings = Meetings(groups, counted=True)

    def send(batches):
        held, count = [], 0
        for batch in batches:
            for part in slices(batch):
                for text in raw(part.column("text")):
                    grams, best = anchor_places(word_hashes(text.split()), size)
                    held.append(grams[np.unique(best)])
                    count += len(held[-1])
                    if count >= HASHES_AT_ONCE:
                        yield from meetings.send(np.concatenate(held), np.zeros(count, np.int64))
                        held, count = [], 0
        if count:
            yield from meetings.send(np.concatenate(held), np.zeros(count, np.int64))

    def compare(table):
        key, _ = meetings.compare(table)
        return pa.table({"anchor": pa.array(np.unique(key).view(np.int64))})

    return rows.mapInArrow(send, SENT).groupBy("group").applyInArrow(compare, "anchor long")


def _spots(anchors: np.ndarray) -> list[np.ndarray]:
    return [(anchors >> np.uint64(s)) % np.uint64(FILTER_BITS) for s in (0, 32)]


def _recurring(rows: DataFrame, size: int, groups: int, table) -> DataFrame:
    """(block, hashes): in packed rows, the windows of each block that occur at two places or more."""
    meetings = Meetings(groups, counted=True)

    def send(batches):
        bits = table()
        held, blocks, count = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for block, text in zip(part.column("block").to_pylist(), raw(part.column("text"))):
                    hashes = word_hashes(text.split())
                    grams, best = anchor_places(hashes, size)
                    first, second = _spots(grams)
                    passed = passes(bits, first) & passes(bits, second)
                    held.append(rolling_hashes(hashes, size)[passed[best]])
                    blocks.append(np.full(len(held[-1]), block, np.int64))
                    count += len(held[-1])
                    if count >= HASHES_AT_ONCE:
                        yield from meetings.send(np.concatenate(held), np.concatenate(blocks))
                        held, blocks, count = [], [], 0
        if count:
            yield from meetings.send(np.concatenate(held), np.concatenate(blocks))

    def compare(table):
        key, block = meetings.compare(table)
        order = np.lexsort((key, block))
        key, block = key[order], block[order]
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
        parts = [p.tobytes() for p in np.split(key, starts[1:])] if len(block) else []
        return pa.table({"block": pa.array(block[starts], pa.int64()), "hashes": pa.array(parts, pa.binary())})

    return rows.mapInArrow(send, SENT).groupBy("group").applyInArrow(compare, "block long, hashes binary")


def _ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def passages(hashes: np.ndarray, recurring: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word ranges of one text that neighbouring recurring windows cover."""
    windows = rolling_hashes(hashes, size)
    at = np.minimum(np.searchsorted(recurring, windows), max(0, len(recurring) - 1))
    found = recurring[at] == windows if len(recurring) else np.zeros(len(windows), bool)
    return [(a, b + size - 1) for a, b in _ranges(found)]


class Automaton:
    """An automaton over words: each word that a passage has is a letter, any other word is none of them."""

    def __init__(self, texts: list[list[bytes]]):
        number: dict[bytes, int] = {}
        for words in texts:
            for w in words:
                number.setdefault(w, len(number))
        # words beyond the code points are two letters, of which the first is never a second
        self.letter = {w: _letter(i) if i < LETTERS else _letter(LETTERS + i // 1000) + _letter(LETTERS + 50_000 + i % 1000) for w, i in number.items()}
        self.none = _letter(LETTERS + 60_000)
        self.wide = len(number) > LETTERS
        self.trie = ahocorasick.Automaton()
        for words in texts:
            spelled = "".join(map(self.letter.__getitem__, words))
            self.trie.add_word(spelled, len(spelled))
        if texts:
            self.trie.make_automaton()
        self.empty = not texts

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words of a text are in some occurrence of a passage."""
        if self.empty or not words:
            return np.zeros(len(words), bool)
        letters = [self.letter.get(w, self.none) for w in words]
        change = np.zeros(sum(map(len, letters)) + 1 if self.wide else len(letters) + 1, np.int64)
        for end, length in self.trie.iter("".join(letters)):
            change[end + 1 - length] += 1
            change[end + 1] -= 1
        inside = np.cumsum(change[:-1]) > 0
        return inside[np.cumsum([0, *map(len, letters[:-1])])] if self.wide else inside


def _letter(i: int) -> str:
    """The ``i``-th code point that a text may have."""
    return chr(i if i < 0xD800 else i + 0x800)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 35) -> DataFrame:
    """(id, n_words, removed, kept_text) of every row, without the words of passages that recur.

    A word goes if it is in a window of ``size`` words of its text whose word
    sequence begins anywhere else too, in the same text or another. ``removed``
    has the word ranges that went, ``kept_text`` the other words joined by
    single spaces.

    Null and empty texts and texts under ``size`` words lose nothing; null has
    no words. Rows that repeat are copies of each other and lose what windows
    cover; ids, null or repeated, only name the rows. Other columns are not
    read. Windows are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    chars = whole.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    rows = whole.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    # about seven characters a word, of which an anchor is one in fifteen, and maybe a third recur
    groups = [int(chars / 7 / per) // HASHES_PER_GROUP + 1 for per in (15, 3)]
    anchors = cut_lineage(_anchors(rows.select("text"), size, groups[0]))
    low = F.pmod("anchor", F.lit(FILTER_BITS))
    high = F.pmod(F.shiftrightunsigned("anchor", 32), F.lit(FILTER_BITS))
    table = sent(spark, bit_filter(anchors, [low, high], FILTER_BITS))
    recurring = cut_lineage(_recurring(rows.select("block", "text"), size, groups[1], table))
    kind = rows.schema["id"].dataType.simpleString()

    def clean(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = [np.frombuffer(h, np.uint64) for h in found.column("hashes").to_pylist()]
        known = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint64)
        split = [t.split() for t in raw(texts.column("text").combine_chunks())] if texts.num_rows else []
        patterns = {}
        for words in split:
            for a, b in passages(word_hashes(words), known, size):
                patterns[b"\n".join(words[a:b])] = None
        automaton = Automaton([p.split(b"\n") for p in patterns])
        gone = [automaton.covered(words) for words in split]
        return pa.table(
            {
                "id": texts.column("id"),
                "n_words": pa.array([len(w) for w in split], pa.int64()),
                "removed": pa.array([[{"begin_word": a, "end_word": b} for a, b in _ranges(g)] for g in gone], RANGES),
                "kept_text": pa.array([b" ".join(_kept(w, g)) for w, g in zip(split, gone)], pa.binary()).cast(pa.string()),
            }
        )

    cleaned = (
        rows.select("id", "text", "block")
        .groupBy("block")
        .cogroup(recurring.groupBy("block"))
        .applyInArrow(clean, f"id {kind}, n_words long, removed array<struct<begin_word:long,end_word:long>>, kept_text string")
    )
    return cleaned.withColumnRenamed("id", id)


def _kept(words: list[bytes], gone: np.ndarray) -> list[bytes]:
    return [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
