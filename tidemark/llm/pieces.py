"""SentencePiece encoding with the original byte span of every piece, and decoding.

A text is first normalised with the model's compiled character map: at every
place the longest prefix that the map holds is replaced, and for every byte of
the result it is noted where in the text it comes from. The pieces are then
cut out of the normalised text, so adding up their lengths and looking up both
ends gives the span of each in the text as it was.
"""

import hashlib
import re
import struct
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sent import sent
from tidemark.llm.words import raw, slices

SPACE = "▁"
BLANK = SPACE.encode()
CACHED = 300_000  # distinct stretches whose pieces a task remembers

# Kinds of a piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6

KINDS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "begins": pa.list_(pa.int32()),
    "ends": pa.list_(pa.int32()),
    "decoded": pa.large_string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
    "covered_bytes": pa.int64(),
}
SPARK_KINDS = {
    "n_tokens": "long", "ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string",
    "ids_sha256": "string", "decoded_sha256": "string", "covered_bytes": "long",
}


class CharacterMap:
    """A compiled map: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.replacements = compiled[4 + size :]
        starts = [b for b in range(256) if self.units and self._step(self._children(0), b) is not None]
        # the next place where any entry could begin
        self.begin = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in starts) + b"]") if starts else None

    def _children(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that the text has at ``start``, and its replacement."""
        base, found = self._children(0), None
        for k in range(start, len(text)):
            at = self._step(base, text[k])
            if at is None:
                break
            base = self._children(at)
            if self.units[at] >> 8 & 1:
                place = self.units[base] & 0x7FFFFFFF
                found = k + 1 - start, place
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(0, found[1])]

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text with its entries replaced, and for each byte where its source begins."""
        source = np.arange(len(text), dtype=np.int32)
        data = np.frombuffer(text, np.uint8)
        source = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, source)) if len(text) else source
        if self.begin is None:
            return text, source
        out, places, at = [], [], 0
        while (m := self.begin.search(text, at)) is not None:
            start = m.start()
            hit = self.longest(text, start)
            length, value = hit or (1, None)
            if hit is None:  # a whole character stays
                while start + length < len(text) and text[start + length] & 0xC0 == 0x80:
                    length += 1
                value = text[start : start + length]
            out += [text[at:start], value]
            places += [source[at:start], np.full(len(value), start)]
            at = start + length
        return b"".join([*out, text[at:]]), np.concatenate([*places, source[at:]])


@dataclass
class Model:
    """What a task needs of a model file."""

    plain: bytes  # the model with its normaliser taken out
    compiled: bytes
    dummy_prefix: bool
    trim: bool  # white space at the ends goes, runs of it become one
    escape: bool
    unknown: str  # what an unknown piece decodes to
    pieces: list[str]
    kinds: list[int]
    cut: bool  # no piece goes on past a stretch of blanks, so stretches can be encoded one by one


def read_model(content: bytes) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(content)
    spec = proto.normalizer_spec
    if proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("models with blanks at the end of pieces are not supported")
    kept = spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
    spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
    pieces = [p.piece for p in proto.pieces]
    return Model(
        proto.SerializeToString(), *kept, proto.trainer_spec.unk_surface, pieces, [p.type for p in proto.pieces],
        not any(SPACE in p.lstrip(SPACE) for p in pieces),
    )


def normalise(text: bytes, model: Model, table: CharacterMap) -> tuple[bytes, np.ndarray]:
    """Normalised text, and the place in ``text`` of each of its bytes and of its end."""
    out, source = table.apply(text)
    if model.trim:
        blank = np.frombuffer(out, np.uint8) == 32
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        if blank.any():
            filled = np.flatnonzero(~blank)
            keep[: filled[0] if len(filled) else None] = False
            keep[filled[-1] + 1 if len(filled) else 0 :] = False
        out, end = np.frombuffer(out, np.uint8)[keep].tobytes(), source[keep][-1:] if keep.any() else source[:0]
        # what was trimmed at the end belongs to no piece
        end = len(text) if keep.size == 0 or not keep.any() or keep[-1] else int(source[np.flatnonzero(keep)[-1] + 1])
        source = source[keep]
    else:
        end = len(text)
    if not out:
        return b"", np.zeros(1, np.int64)
    blank = BLANK if model.escape else b" "
    if model.escape:
        source = np.repeat(source, np.where(np.frombuffer(out, np.uint8) == 32, len(blank), 1))
        out = out.replace(b" ", blank)
    if model.dummy_prefix:
        source = np.concatenate([np.full(len(blank), source[0]), source])
        out = blank + out
    return out, np.append(source, end)


class Encoder:
    """Encodes texts within one task."""

    def __init__(self, model: Model):
        import sentencepiece

        self.model, self.table = model, CharacterMap(model.compiled)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.plain)
        spelled = [_spelled(p, k, model.unknown) for p, k in zip(model.pieces, model.kinds)]
        self.sizes = np.array([len(p.encode()) if k in (NORMAL, USER) else 1 for p, k in zip(model.pieces, model.kinds)], np.int64)
        self.lengths = np.array([len(p) for p in spelled], np.int64)
        widest = max(map(len, spelled))
        self.letters = np.frombuffer(b"".join(p.ljust(widest) for p in spelled), np.uint8).reshape(-1, widest)
        self.numbers = np.array([f"{i},".encode() for i in range(len(spelled))])
        self.cache: dict[bytes, bytes] = {}

    def stretches(self, normal: bytes) -> list[bytes]:
        """Cuts before each run of blanks; the first blank of every stretch is left out."""
        if not normal:
            return []
        if not self.model.cut or not normal.startswith(BLANK):
            return [normal.removeprefix(BLANK)]
        words = normal.split(BLANK)[1:]
        if b"" not in words:
            return words
        out, run = [], 0
        for w in words:
            if w:
                out.append(BLANK * run + w)
                run = 0
            else:
                run += 1
        return [*out, BLANK * (run - 1)] if run else out

    def learn(self, texts: list[list[bytes]], lead: str) -> None:
        asked = set().union(*texts)
        new = list(asked.difference(self.cache))
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = list(asked)
        found = self.processor.encode([lead + s.decode("utf-8", "replace") for s in new], num_threads=1) if new else ()
        for s, ids in zip(new, found):
            self.cache[s] = array("i", ids).tobytes()

    def encode(self, texts: list[bytes]):
        """(ids, begins, ends) of each text."""
        normal = [normalise(t, self.model, self.table) for t in texts]
        cut = [self.stretches(n) if self.model.cut and n.startswith(BLANK) else [] for n, _ in normal]
        self.learn(cut, SPACE)
        for own, (text, source) in zip(cut, normal):
            if own or not text:
                ids = np.frombuffer(b"".join(map(self.cache.__getitem__, own)), np.int32)
            else:  # begins without a blank, or pieces may reach over blanks
                ids = np.array(self.processor.encode(text.decode("utf-8", "replace")), np.int32)
            sizes = self.sizes[ids]
            if UNKNOWN in self.model.kinds and (ids == self.model.kinds.index(UNKNOWN)).any():
                sizes = self.unknown_sizes(ids, sizes, text)
            ends = np.cumsum(sizes)
            yield ids, source[ends - sizes], source[ends]

    def unknown_sizes(self, ids, sizes, text):
        """An unknown piece is as long as the library says, which joins unknown characters."""
        proto = self.processor.encode(text.decode("utf-8", "replace"), return_type="proto")
        return np.array([p.end - p.begin for p in proto.pieces], np.int64)

    def text_of_numbers(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        flat = np.frombuffer(self.numbers[ids].tobytes(), np.uint8)
        return flat[flat != 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text that pieces spell, without the blank that encoding put in front."""
        letters = self.letters[ids]
        spelled = letters[np.arange(letters.shape[1]) < self.lengths[ids][:, None]].tobytes()
        spelled = spelled.replace(BLANK, b" ").decode("utf-8", "replace")
        return spelled.removeprefix(" ") if self.model.dummy_prefix else spelled


def _spelled(piece: str, kind: int, unknown: str) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    return b"" if kind == CONTROL else unknown.encode() if kind == UNKNOWN else piece.encode()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_texts(
    docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends")
) -> DataFrame:
    """(id, *outputs) for every row: pieces of the whole text, as the model's own library cuts it.

    ``outputs``: n_tokens; ids; begins and ends (byte spans in the UTF-8 text,
    begin included, end not; of the bytes of one character that became several
    pieces, the last has the span and the others are empty); decoded; ids_sha256
    (of the decimal ids joined by commas); decoded_sha256; covered_bytes (sum
    of the spans). No begin or end ids are added.

    Null and empty texts have no pieces and decode to the empty text. Repeated
    rows and ids are encoded each by itself; other columns are not read. The
    model file is read on the driver and sent to the tasks.
    """
    with open(model_path, "rb") as file:
        model = sent(docs.sparkSession, read_model(file.read()))

    def run(batches):
        encoder = Encoder(model())
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns(encoder, raw(part.column("text")))], ["id", *outputs])

    def columns(encoder, texts):
        done = list(encoder.encode(texts))
        spelled = [encoder.decode(d[0]) for d in done] if {"decoded", "decoded_sha256"} & {*outputs} else ()
        make = {
            "n_tokens": lambda: [len(d[0]) for d in done],
            "decoded": lambda: spelled,
            "ids_sha256": lambda: [hashlib.sha256(encoder.text_of_numbers(d[0])).hexdigest() for d in done],
            "decoded_sha256": lambda: [hashlib.sha256(x.encode()).hexdigest() for x in spelled],
            "covered_bytes": lambda: [int((d[2] - d[1]).sum()) for d in done],
        }
        for name in outputs:
            if name in make:
                yield pa.array(make[name](), KINDS[name])
            else:
                yield _lists([d[("ids", "begins", "ends").index(name)] for d in done])

    kinds = ", ".join(f"{n} {SPARK_KINDS[n]}" for n in outputs)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {kinds}").withColumnRenamed("id", id)
