"""Benchmark passages in texts, up to word edits.

A random walk (CGK) turns a word sequence into a longer one in which few
edits become few differing places. Windows of an item's size are embedded by
several walks; of each walk a few places are sampled, and a window that agrees
with an item in all sampled places of one walk is compared with it exactly.
The number of walks follows from the recall wanted. A window is embedded only
where the text has one of the item's rarest words and, around it, as many of
its words as any passage within the allowed edits must have. For items so long
that more than MOST_WALKS walks would be needed, all such places are compared
exactly, without walks, which misses nothing.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.llm.sent import sent
from tidemark.llm.words import mix, raw, slices, word_hashes
from tidemark.session import cut_lineage

# scripts written without blanks, as ranges that Python and Java read alike: Thai and Lao, Tibetan, Myanmar, Khmer, Tai Le
# to Tai Tham, Balinese, kana, Han with its marks of repetition and zero, Javanese, Cham, half-width kana
UNSPACED = (
    "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3021-\u3029"
    "\u3031-\u3035\u3040-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uaa00-\uaa7f"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
ONE = re.compile(f"[{UNSPACED}]")
WIDE_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
MARKS = b".,;:!?\"'()[]{}<>|%&$#*-_/`~^+=@\\"
PLACES = 3  # sampled of each walk
MOST_WALKS = 64  # of an item; one that needs more is compared without walks
BLOCK_WORDS = 1_000_000  # benchmark words that tasks hold at once
NOTHING = np.uint64(0)  # what a walk reads behind the end


def plain_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation taken out.

    Each character of a script without blanks is a word; in texts that have
    such, full-width punctuation ends words and is taken out as well.
    """
    if not text.isascii():
        own = text.decode(errors="surrogateescape")
        if ONE.search(own):
            text = ONE.sub(r" \g<0> ", WIDE_MARKS.sub(" ", own)).encode(errors="surrogateescape")
    return text.lower().translate(None, MARKS).split()


@dataclass
class Item:
    id: int | None
    hashes: np.ndarray
    edits: int  # allowed
    words: frozenset
    own: list[bytes]

    @property
    def size(self) -> int:
        return len(self.hashes)


def walk_signatures(data: np.ndarray, starts: np.ndarray, size: int, walks: int) -> np.ndarray:
    """(window, walk): hash of the sampled places of each walk over ``data[start:start + size]``.

    A walk goes on by one word in every other step, so it is sampled in its
    first ``1.6 * size`` steps: later ones would soon read behind the end.
    """
    steps = max(1, 8 * size // 5)
    padded = np.append(data, np.full(size + 1, NOTHING))
    rng = np.random.default_rng(size)
    seeds = rng.integers(1, 1 << 63, (steps, walks), dtype=np.uint64)
    sampled = rng.random((steps, walks)).argsort(0).argsort(0) < PLACES
    at = np.zeros((len(starts), walks), np.int64)
    out = np.zeros((len(starts), walks), np.uint64)
    for j in range(steps):
        read = np.where(at < size, padded[np.minimum(starts[:, None] + at, len(padded) - 1)], NOTHING)
        h = mix(read ^ seeds[j])
        out = np.where(sampled[j], mix(out * np.uint64(31) + h), out)
        at += (h >> np.uint64(63)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits between ``item`` and any part of ``text``: edits, begin and end of the first best part."""
    n, m = len(item), len(text)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(n):
        old, old_origin = row, origin
        step = old[:-1] + (text != item[i])
        cost = np.append(i + 1, np.minimum(step, old[1:] + 1))
        origin = np.append(0, np.where(step <= old[1:] + 1, old_origin[:-1], old_origin[1:]))
        # insertions: the least of all places before, plus the way from there
        offset = cost - np.arange(m + 1)
        best = np.minimum.accumulate(offset)
        first = np.maximum.accumulate(np.where(offset == best, np.arange(m + 1), 0))
        row, origin = best + np.arange(m + 1), origin[first]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


def _stretches(starts: list[int], gap: int):
    """First and last of each run of starts that are at most ``gap`` apart."""
    first = last = starts[0]
    for s in starts[1:]:
        if s > last + gap:
            yield first, last
            first = s
        last = s
    yield first, last


def _joined(ranges: list[tuple[int, int]]):
    """Sorted ranges with those that overlap made one."""
    low, high = ranges[0]
    for begin, end in ranges:
        if begin > high:
            yield low, high
            low, high = begin, end
        high = max(high, end)
    yield low, high


class Index:
    """Anchor words and walk tables of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], similarity: float, recall: float, min_words: int):
        self.items = []
        words = [plain_words(t) for _, t in items]
        common: dict[bytes, int] = {}
        for own in words:
            for w in set(own):
                common[w] = common.get(w, 0) + 1
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for (id, _), own in zip(items, words):
            if len(own) < max(1, min_words):
                continue
            # a little more, so that 0.8 of 15 words are 3 edits in binary fractions too
            edits = int((1 - similarity) * len(own) + 1e-9)
            number = len(self.items)
            self.items.append(Item(id, word_hashes(own), edits, frozenset(own), own))
            # of so many different words, any passage within the edits keeps one
            rarest = set(sorted(set(own), key=lambda w: (common[w], -len(w), w))[: edits + 1])
            for place, w in enumerate(own):
                if w in rarest:
                    self.anchors.setdefault(w, []).append((number, place))
        self.walks, self.tables = {}, {}  # walks: none for sizes that are compared without
        of_size: dict[int, list[int]] = {}
        for number, i in enumerate(self.items):
            if not i.edits:
                continue  # compared word by word
            of_size.setdefault(i.size, []).append(number)
        walks: int | None = 0
        for size, numbers in sorted(of_size.items()):
            # longer items need more walks: behind the first size that needs too many none is tried
            if walks is not None:
                walks = self.walks_for(size, self.items[numbers[0]].edits, recall)
            self.walks[size] = walks
            if walks is None:
                continue
            data = np.concatenate([self.items[k].hashes for k in numbers])
            # each item must be read as if it stood alone
            for k, number in enumerate(numbers):
                own = walk_signatures(data[k * size : (k + 1) * size], np.zeros(1, np.int64), size, walks)[0]
                for w, s in enumerate(own.tolist()):
                    self.tables.setdefault((size, w, s), []).append(number)

    @staticmethod
    def walks_for(size: int, edits: int, recall: float, trials: int = 400) -> int | None:
        """Walks that find a passage with all allowed edits with probability ``recall``, by trial on random words.

        None if ``MOST_WALKS`` walks are too few.
        """
        rng = np.random.default_rng(size)
        first, second = [], []
        for _ in range(trials):
            word = rng.integers(1, 1 << 62, size).tolist()
            other = list(word)
            for _ in range(edits):
                kind, at = rng.integers(3), int(rng.integers(len(other)))
                if kind:
                    other[at : at + 1] = [int(rng.integers(1, 1 << 62))] if kind == 1 else []
                else:
                    other.insert(at, int(rng.integers(1, 1 << 62)))
            first += word
            second += (other + [0] * size)[:size]
        starts = np.arange(trials) * size
        pairs = [walk_signatures(np.array(x, np.uint64), starts, size, MOST_WALKS) for x in (first, second)]
        met = (pairs[0] == pairs[1]).sum(1)
        missed = np.ones(trials)  # chance that none of so many of the tried walks meets, by pair
        for walks in range(MOST_WALKS):
            missed *= np.maximum(0, MOST_WALKS - walks - met) / (MOST_WALKS - walks)
            if walks >= 3 and missed.mean() <= 1 - recall:
                return walks + 1
        return None

    def find(self, text: bytes) -> list[dict]:
        """Items in one text, each with its fewest edits and the first place that has them."""
        words = plain_words(text)
        starts: dict[int, set[int]] = {}
        ranges: dict[int, set[tuple[int, int]]] = {}  # of items without walks
        held: dict[int, np.ndarray] = {}
        found: dict[int, tuple[int, int, int]] = {}
        for place, hits in [(p, self.anchors[w]) for p, w in enumerate(words) if w in self.anchors]:
            for number, offset in hits:
                item = self.items[number]
                begin, slack = place - offset, item.edits
                if not slack:
                    if number not in found and begin >= 0 and words[begin : begin + item.size] == item.own:
                        found[number] = (0, begin, begin + item.size)
                    continue
                if self.walks[item.size] is None:
                    if number not in held:
                        own = np.fromiter(map(item.words.__contains__, words), bool, len(words))
                        held[number] = np.append(0, np.cumsum(own))
                    low, high = max(0, begin - slack), min(len(words), max(0, begin + item.size + slack))
                    if held[number][high] - held[number][low] >= item.size - slack:
                        ranges.setdefault(number, set()).add((low, high))
                    continue
                around = words[max(0, begin - slack) : max(0, begin + item.size + slack)]
                if sum(map(item.words.__contains__, around)) >= item.size - slack:
                    last = max(0, len(words) - 1)
                    starts.setdefault(item.size, set()).update(range(min(max(0, begin - slack), last), min(max(0, begin + slack), last) + 1))
        data = word_hashes(words) if starts or ranges else None
        for number, places in sorted(ranges.items()):
            item, best = self.items[number], None
            for low, high in _joined(sorted(places)):
                edits, begin, end = edit_distance(item.hashes, data[low:high])
                best = min(best or (edits, low + begin, low + end), (edits, low + begin, low + end))
            if best[0] <= item.edits:
                found[number] = best
        for size, places in sorted(starts.items()):
            places = np.array(sorted(places))
            candidates: dict[int, set[int]] = {}
            for start, own in zip(places.tolist(), walk_signatures(data, places, size, self.walks[size]).tolist()):
                for w, s in enumerate(own):
                    for number in self.tables.get((size, w, s), ()):
                        candidates.setdefault(number, set()).add(start)
            for number, own in sorted(candidates.items()):
                item, best = self.items[number], None
                for low, high in _stretches(sorted(own), size):
                    low = max(0, low - item.edits)
                    edits, begin, end = edit_distance(item.hashes, data[low : high + size + item.edits])
                    best = min(best or (edits, low + begin, low + end), (edits, low + begin, low + end))
                if best[0] <= item.edits:
                    found[number] = best
        return [
            {"item_id": self.items[n].id, "edits": e, "begin_word": b, "end_word": t} for n, (e, b, t) in sorted(found.items())
        ]


LEAKS = ArrayType(StructType([StructField(n, LongType()) for n in ("item_id", "edits", "begin_word", "end_word")]))


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = 0.8,
    recall: float = 0.99,
    min_words: int = 5,
) -> DataFrame:
    """``docs`` with ``leaks`` in place of an equally named column: the benchmark items that the text holds.

    An item is held if some part of the text is at most ``(1 - similarity)``
    of the item's words away from it in word edits; under five words 0.8 allows
    none, so only an exact copy is told. Words are lower-cased (A-Z) and lose
    ASCII punctuation; in scripts without blanks each character is a word.
    Each leak has the item, its fewest edits and
    the first word range (in words that are left) that has so few.

    Items are searched in blocks of about ``BLOCK_WORDS`` words, which bounds
    what a task holds; each block reads the texts once more. Null and empty
    texts hold nothing; null items, items without a word (only blanks or
    punctuation) and items under ``min_words`` words are in no text; with
    ``min_words`` of 1 all others are searched. Items with equal texts are all told. Repeated rows of ``docs`` are
    searched each by itself. An empty table gives its counterpart empty lists.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    single = F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")) + single)).first()[0] or 0
    blocks = words // BLOCK_WORDS + 1
    # the caller's columns are one, so that none can clash
    taken = [F.col(f"`{c}`") for c in docs.columns if c != "leaks"]
    out = docs.select(F.struct(*taken).alias("row"), F.col(text).alias("text"), F.array().cast(LEAKS).alias("leaks"))
    kinds = StructType([*out.schema.fields, StructField("more", LEAKS)])
    for k in range(blocks):
        if k:  # a task holds the index of one block only
            out = cut_lineage(out)
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        index = sent(spark, Index([(r[0], r[1].encode()) for r in own], similarity, recall, min_words))
        out = out.mapInArrow(_search(index), kinds).withColumn("leaks", F.concat("leaks", "more")).drop("more")
    return out.select("row.*", "leaks")


def _search(index):
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "edits", "begin_word", "end_word")]))

    def run(batches):
        own = index()
        for batch in batches:
            for part in slices(batch):
                found = [own.find(t) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "more"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, item_id, edits, begin_word, end_word): one row for each text and item that it holds."""
    found = with_leaks(docs.select(id, text), benchmark, text, **how)
    return found.select(id, F.explode("leaks").alias("leak")).select(id, "leak.*")
