"""Token ids as shards of fixed-width bits, with block offsets, and their readers.

A shard is a file of consecutive documents in ascending order of their ids.
Every token id takes the fewest bits that hold the vocabulary's largest id;
blocks of equally many ids begin on whole bytes. The layout of a shard:

    block 0, line feed, block 1, line feed, ..., index, line feed, footer, line feed

The index holds the byte offsets of the blocks, then per document its id,
whether that is null, and the place of its first token id in the shard. The
footer has ``FOOTER`` bytes. Spark's text writer puts the line feeds behind
the rows; readers go by offsets and never look for them. The manifest beside
the shards says how many ids come before each shard, so that any place in the
whole stream leads to one block.
"""

import json
import os
import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.sent import sent
from tidemark.llm.words import slices

# Fixed values of the format: magic, then width, ids a block, documents, ids, blocks, place of the index, shard
MAGIC = b"TMBITS01"
LAYOUT = "<8sIIQQQQQ"
FOOTER = struct.calcsize(LAYOUT)
BLOCK_IDS = 1 << 16
SHARD_BYTES = 32 << 20  # of text in a shard, about
REMEMBERED = 200_000  # words in each of two generations that a worker process keeps
LONG = 48  # characters of a stretch that is not kept
OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
PAIRS = ("  ", " \n", "\n ", "\n\n")
# letters, then other marks than the apostrophe: the byte-level split makes a piece of each
WORD = re.compile("\n?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# how byte-level vocabularies write the bytes: visible characters as they are, the others from U+0100 on
_HIDDEN = [*range(33), *range(0x7F, 0xA1), 0xAD]
SPELLED = "".join(chr(0x100 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))


def even(text: str) -> bool:
    """Whether all white space of a text are single blanks and line feeds between other characters.

    Each of them then begins a piece in the byte-level split.
    """
    if not text or any(p in text for p in PAIRS) or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(c in text for c in OTHER)


def width_of(vocabulary: int) -> int:
    """Bits of the largest of ``vocabulary`` ids."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits for each id, the lowest bit first, filled up to whole bytes."""
    held = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    held.ravel()[: len(ids)] = ids
    out = np.zeros((len(held), width + 1), np.uint64)
    for k in range(64):  # 64 ids are as many words as an id has bits
        word, bit = divmod(k * width, 64)
        out[:, word] |= held[:, k] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= held[:, k] >> np.uint64(64 - bit)
    return out[:, :width].astype("<u8").tobytes()[: -(-len(ids) * width // 8)]


def unpack(block: np.ndarray, width: int, begin: int, count: int) -> np.ndarray:
    """``count`` ids from the ``begin``-th on of a block, given as bytes; reads only the bytes they lie in."""
    skipped = begin % 64
    first, rows = begin // 64, -(-(skipped + count) // 64)
    held = np.zeros(rows * width * 8, np.uint8)
    own = block[first * width * 8 : -(-(begin + count) * width // 8)]
    held[: len(own)] = own
    words = np.concatenate([held.view("<u8").reshape(rows, width), np.zeros((rows, 1), np.uint64)], axis=1)
    out = np.empty((rows, 64), np.uint32)
    most = np.uint64((1 << width) - 1)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        value = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            value |= words[:, word + 1] << np.uint64(64 - bit)
        out[:, k] = value & most
    return out.ravel()[skipped : skipped + count]


def piece_ids(model, piece: str) -> bytes:
    """Ids of one piece of the byte-level split, given as vocabularies write it."""
    return array("I", [t.id for t in model.tokenize(piece)]).tobytes()


class Tokens:
    """Ids as the library gives them; for byte-level vocabularies stretches of text are encoded once and remembered."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        told = json.loads(model)
        split = told["pre_tokenizer"] or {}
        # only where nothing is changed before the byte-level split do stretches mean the same in any place
        self.remember = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        # no added token lies within a word and its marks
        words = [t["content"].strip().rstrip(MARKS) for t in told["added_tokens"]]
        self.plain = self.remember and all(x and not WORD.fullmatch(x) for x in words)
        self.line = array("I", self._library(["\n"])[0]).tobytes()
        # these do not refer to this object, which is to be freed with its task
        self.word = partial(piece_ids, self.library.model)
        self.marks = lru_cache(10_000)(self.word)
        self.young, self.old = {}, {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of stretches that are not remembered.

        A word and the marks behind it are two pieces for the model, so only
        the word is remembered; other stretches are the library's.
        """
        young, old = self.young, self.old
        words = [x.rstrip(MARKS) for x in new]  # plain strings: objects that Python's collector tracks cost more than they save
        plain = set(filter(WORD.fullmatch, set(words))) if self.plain else set()
        asked = plain.difference(young)
        asked.update(x for x, word in zip(new, words) if word not in plain)
        known = {x: old[x] for x in asked if x in old}
        asked.difference_update(known)
        other = list(asked.difference(plain))
        asked = list(asked.intersection(plain))
        # a blank is in no word
        spelled = charmap_decode(" ".join(asked).encode(), "strict", SPELLED)[0].split(SPELLED[32]) if asked else []
        for x, word in zip(asked, spelled):
            known[x] = self.line + self.word(word[1:]) if x[0] == "\n" else self.word(SPELLED[32] + word)
        whole = self._library([x if x[0] == "\n" else " " + x for x in other])
        known.update((x, array("I", own).tobytes()) for x, own in zip(other, whole))
        young.update((x, v) for x, v in known.items() if len(x) <= LONG)
        for x, word in zip(new, words):
            if x not in known:
                known[x] = (known[word] if word in known else young[word]) + self.marks(x[len(word) :])
        return known

    def _stretches(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are ``even``."""
        if not texts:
            return []
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        # what stands behind a blank goes without it, what stands behind a line feed with it
        cut = [x.replace("\n", " \n").partition(" ") for x in texts]
        firsts = [np.array(x, np.uint32) for x in self._library([x for x, _, _ in cut])]
        split = pc.split_pattern(pa.array([x if blank else None for _, blank, x in cut], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        stretches, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        held = list(map(self.young.get, stretches))
        gaps = [i for i, x in enumerate(held) if x is None]
        here = self._learn([stretches[i] for i in gaps])
        for i in gaps:
            held[i] = here[stretches[i]]
        # the ids of all stretches behind each other, then those of each place taken out of them
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        flat, begins = np.frombuffer(b"".join(held), np.uint32), np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = flat[np.repeat(begins[at] - ends[:-1], n) + np.arange(ends[-1])]
        words = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
        last = ends[words].tolist()
        return [np.concatenate([first, ids[a:b]]) for first, a, b in zip(firsts, [0, *last], last)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        short = [self.remember and even(x) for x in texts]
        held = iter(self._stretches([x for x, own in zip(texts, short) if own]))
        rest = iter(self._library([x for x, own in zip(texts, short) if not own]))
        return [next(held) if own else np.array(next(rest), np.uint32) for own in short]


@lru_cache(1)
def tokens_of(model: str) -> Tokens:
    """The encoder of a worker process, which its next tasks use with all that it remembers."""
    return Tokens(model)


class _Shard:
    """Rows of one shard; holds a block of ids and the index, not the documents."""

    def __init__(self, number: int, width: int, end: int, block_ids: int):
        self.number, self.width, self.end, self.block_ids = number, width, end, block_ids
        self.waiting, self.held, self.ids, self.at = [], 0, 0, 0
        self.offsets, self.docs, self.nulls, self.starts = [], [], [], []

    def _block(self, ids: np.ndarray) -> bytes:
        block = pack(ids, self.width)
        self.offsets.append(self.at)
        self.at += len(block) + 1
        return block

    def add(self, doc: int | None, ids: np.ndarray):
        """Takes a document; gives the blocks that it fills."""
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"a token id needs more than {self.width} bits")
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.starts.append(self.ids)
        self.waiting += [ids, np.array([self.end], np.uint32)]
        self.ids += len(ids) + 1
        self.held += len(ids) + 1
        if self.held >= self.block_ids:
            whole = np.concatenate(self.waiting)
            full = len(whole) // self.block_ids * self.block_ids
            for begin in range(0, full, self.block_ids):
                yield self._block(whole[begin : begin + self.block_ids])
            self.waiting, self.held = [whole[full:]], len(whole) - full

    def close(self):
        if self.held:
            yield self._block(np.concatenate(self.waiting))
        if self.docs:
            parts = [(self.offsets, np.int64), (self.docs, np.int64), (self.nulls, np.uint8), (self.starts, np.int64)]
            yield b"".join(np.array(x, kind).tobytes() for x, kind in parts)
            yield struct.pack(LAYOUT, MAGIC, self.width, self.block_ids, len(self.docs), self.ids, len(self.offsets), self.at, self.number)


class Reader:
    """One shard's content."""

    def __init__(self, content: bytes):
        footer = content[-FOOTER - 1 : -1]
        magic, self.width, self.block_ids, n, self.n_ids, blocks, at, self.number = struct.unpack(LAYOUT, footer)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.content = np.frombuffer(content, np.uint8)
        columns = []
        for count, kind in ((blocks, np.int64), (n, np.int64), (n, np.uint8), (n, np.int64)):
            columns.append(np.frombuffer(content, kind, count, at))
            at += count * np.dtype(kind).itemsize
        self.offsets, self.docs, self.nulls, self.starts = columns
        self.ends = np.append(self.starts[1:], self.n_ids)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` up to ``end`` of the shard; touches the blocks they lie in only."""
        out, b = [np.empty(0, np.uint32)], begin // self.block_ids
        while b * self.block_ids < end:
            low, high = max(begin - b * self.block_ids, 0), min(end - b * self.block_ids, self.block_ids)
            out.append(unpack(self.content[self.offsets[b] :], self.width, low, high - low))
            b += 1
        return np.concatenate(out)


def write_packed(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id: str = "doc_id",
    text: str = "text",
    end: int = 0,
    block_ids: int = BLOCK_IDS,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Writes the token ids of ``docs`` as packed shards and their manifest into ``folder``.

    ``tokenizer`` is a file of the tokenizers library; special tokens are not
    added, and ``end`` follows every document. Documents stand in ascending
    order of ``id``: null ids first, rows that repeat an id by a hash of their
    texts. A null or empty text has only the end id. A very long text fills
    blocks of its own and is in memory once, as one row. Other columns are not
    read. Rows are dealt to shards by ranges of (id, hash, place), so repeated
    ids and repeated rows may lie in several shards. No rows give no shards.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    from tokenizers import Tokenizer

    width = width_of(max([end, *Tokenizer.from_str(model).get_vocab(with_added_tokens=True).values()]) + 1)
    given = sent(spark, model)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ("id", "hash", "place")
    rows = rows.repartitionByRange(size // shard_bytes + 1, *order).sortWithinPartitions(*order).select("id", "text")

    def shard(batches):
        from pyspark import TaskContext

        encode = tokens_of(given())
        out = _Shard(TaskContext.get().partitionId(), width, end, block_ids)
        row = lambda block: pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])
        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part.column("id").to_pylist(), encode(part.column("text").to_pylist())):
                    for block in out.add(doc, ids):
                        yield row(block)
        for block in out.close():
            yield row(block)

    blocks = rows.mapInArrow(shard, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(f"{folder}/shards")
    footers = _files(spark, folder).select("path", _footer().alias("footer"))
    told = footers.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        _long("footer", FOOTER - 7).alias("shard"),
        _long("footer", 17).alias("n_docs"),
        _long("footer", 25).alias("n_ids"),
    )
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each shard
    told.withColumn("first_id", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")


def _footer():
    return F.expr(f"substring(content, cast(length - {FOOTER} as int), {FOOTER})")


def _long(column: str, at: int):
    """The 64-bit integer, lowest byte first, at byte ``at`` (from 1) of a binary column."""
    lowest_last = F.concat(*[F.substring(column, at + k, 1) for k in range(7, -1, -1)])
    return F.conv(F.hex(lowest_last), 16, 10).cast("long")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Shards that hold documents."""
    return spark.read.format("binaryFile").load(f"{folder}/shards").filter(F.col("length") > FOOTER)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, shard, n_docs, n_ids, first_id): one row for each shard, first_id being the ids before it."""
    return spark.read.parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards; with its ids unless ``ids`` is false.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is that
    of its ids as little-endian unsigned 32-bit integers.
    """

    def told(batches):
        for batch in batches:
            for content in batch.column("content"):
                reader = Reader(content.as_py())
                n = len(reader.docs)
                step = max(1, n * BLOCK_IDS // max(1, reader.n_ids))
                for low in range(0, n, step):
                    high = min(n, low + step)
                    starts, ends = reader.starts[low:high], reader.ends[low:high]
                    held = reader.ids(int(starts[0]), int(ends[-1]))
                    own = [held[a:b] for a, b in zip(starts - starts[0], ends - starts[0])]
                    columns = [
                        pa.array(reader.docs[low:high], mask=reader.nulls[low:high].astype(bool)),
                        pa.array(np.full(high - low, reader.number, np.int64)),
                        pa.array(starts),
                        pa.array(ends - starts),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id long, shard long, begin long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    names = [x.split()[0] for x in kinds.split(", ")]
    found = _files(spark, folder).select("content").mapInArrow(told, kinds)
    found = found.join(manifest(spark, folder).select("shard", "first_id"), "shard")
    start = (F.col("first_id") + F.col("begin")).alias("start")
    return found.select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * ids)


def read_range(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """(start, ids): the stretch from ``begin`` up to ``end`` of the whole stream, a row for each shard it lies in.

    Only these shards are opened, and only the blocks of the stretch unpacked.
    """
    last = F.col("first_id") + F.col("n_ids")
    wanted = manifest(spark, folder).filter((F.col("first_id") < end) & (last > begin))
    places = wanted.select("shard", F.greatest(F.lit(begin) - F.col("first_id"), F.lit(0)).alias("low"), (F.least(last, F.lit(end)) - F.col("first_id")).alias("high"), "first_id")
    names = [r["file"] for r in wanted.select("file").collect()]  # as many as the stretch has shards

    def cut(batches):
        for batch in batches:
            for content, low, high, first in zip(*(batch.column(c).to_pylist() for c in ("content", "low", "high", "first_id"))):
                ids = Reader(content).ids(low, high).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([first + low]), pa.array([ids], pa.list_(pa.int32()))], ["start", "ids"])

    paths = [f"{folder}/shards/{n}" for n in names]
    if not paths:
        return spark.createDataFrame([], "start long, ids array<int>")
    files = spark.read.format("binaryFile").load(paths)
    files = files.withColumn("footer", _footer()).withColumn("shard", _long("footer", FOOTER - 7))
    return files.join(places, "shard").select("content", "low", "high", "first_id").mapInArrow(cut, "start long, ids array<int>")
