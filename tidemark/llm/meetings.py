"""Keys that several owners have or that occur several times, found with few rows in the shuffle.

Tasks send their keys packed, a row for each group of keys; a group is
compared in one task. Where many owners of one task share a key, one of them
is sent for comparing and marked, and the rest go to groups of their own, so
that a key which a third of all owners have is no large group anywhere.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import mix

LOCALLY_MANY = 8
KINDS = pa.schema([("group", pa.int32()), ("whole", pa.bool_()), ("keys", pa.binary()), ("owners", pa.binary()), ("met", pa.binary())])
SENT = "group int, whole boolean, keys binary, owners binary, met binary"
FILTER_PAGE = 32768  # bits of a row of Spark's bitmaps


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


@dataclass(frozen=True)
class Meetings:
    groups: int
    narrow: bool = False  # keys are told apart by their group and 32 more bits only; half the size
    counted: bool = False  # a key and owner that come twice are two occurrences, which meet

    def _group(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> np.uint64(32)) * np.uint64(self.groups)) >> np.uint64(32)).astype(np.int64)

    def send(self, keys: np.ndarray, owners: np.ndarray):
        """Batches of the rows ``SENT`` for what one task holds; keys must be evenly spread 64-bit hashes."""
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new_key = _first_of_runs(keys)
        fresh = new_key | _first_of_runs(owners)
        first = np.flatnonzero(new_key)
        twice = np.diff(np.append(first, len(keys))) > 1
        keys, owners = keys[fresh], owners[fresh]
        lead = new_key[fresh]
        first = np.flatnonzero(lead)
        count = np.diff(np.append(first, len(keys)))
        many = np.repeat(count >= LOCALLY_MANY, count)
        known = many | np.repeat(twice & self.counted, count)
        rows = []
        for whole, chosen in ((not self.narrow, ~many | lead), (True, many & ~lead)):
            mine, whose, met = keys[chosen], owners[chosen], known[chosen]
            group = self._group(mix(mix(whose.view(np.uint64)) ^ mine) if len(rows) else mine)
            if self.narrow:
                mine = (self._group(mine).astype(np.uint64) << np.uint64(32)) | (mine & np.uint64(0xFFFFFFFF))
            order = np.argsort(group, kind="stable")
            mine, whose, met = mine[order], whose[order], met[order]
            sizes = np.bincount(group, minlength=self.groups)
            ends = np.cumsum(sizes)
            own = []
            for g in np.flatnonzero(sizes):
                at = slice(ends[g] - sizes[g], ends[g])
                held = mine[at] if whole else mine[at].astype(np.uint32)
                own.append((g, whole, held.tobytes(), whose[at].tobytes(), met[at].tobytes()))
            rows.append(own)
        rows = rows[0] + rows[1]
        for start in range(0, len(rows), 200):
            columns = zip(*rows[start : start + 200])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KINDS)], schema=KINDS)

    def compare(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Keys and owners of a group, for the keys that have several owners (or occurrences)."""
        key, owner, met = [], [], []
        for g, whole, held, whose, known in zip(*(table.column(n).to_pylist() for n in KINDS.names)):
            own = np.frombuffer(held, np.uint64 if whole else np.uint32).astype(np.uint64)
            key.append(own if whole else own | (np.uint64(g) << np.uint64(32)))
            owner.append(np.frombuffer(whose, np.int64))
            met.append(np.frombuffer(known, bool))
        key, owner, met = np.concatenate(key), np.concatenate(owner), np.concatenate(met)
        order = np.lexsort((owner, key))
        key, owner, met = key[order], owner[order], met[order]
        new_key = _first_of_runs(key)
        fresh = new_key | _first_of_runs(owner)
        run = np.cumsum(new_key) - 1
        shared = np.bincount(run, weights=None if self.counted else fresh) >= 2
        shared |= np.bincount(run, weights=met) > 0
        chosen = fresh & shared[run]
        return key[chosen], owner[chosen]


def bit_filter(rows: DataFrame, spots: list, bits: int) -> np.ndarray:
    """(page, byte) table in which the bits at all ``spots`` (columns, below ``bits``) of all rows are set."""
    # Spark numbers pages from 1 for positive numbers
    at = rows.select(F.explode(F.array(*[x + 1 for x in spots])).alias("spot"))
    pages = at.groupBy(F.bitmap_bucket_number("spot").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("held")
    )
    out = np.zeros((bits // FILTER_PAGE + 2, FILTER_PAGE // 8), np.uint8)
    for page, held in pages.collect():  # ``bits`` at most, whatever the table has
        out[page, : len(held)] = np.frombuffer(held, np.uint8)
    return out


def passes(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which spots are set."""
    spots = spots.astype(np.int64)
    page, bit = 1 + spots // FILTER_PAGE, spots % FILTER_PAGE
    return ((table[page, bit >> 3] >> (bit & 7)) & 1).astype(bool)
