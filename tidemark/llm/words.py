"""Words, their hashes and hashes of word windows, for use inside tasks.

Words are what is left between space, tab, line feed, vertical tab, form feed
and carriage return, in UTF-8. ``bytes.split()`` cuts at exactly these.
"""

import numpy as np
import pyarrow as pa
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
FOLD = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * ODD + hashes[j : j + n])
    return out


def rolling_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``gram_hashes``, in time that does not depend on ``k`` (another hash)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    back = np.cumprod(np.full(n, pow(FOLD, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * np.cumprod(np.full(len(hashes), FOLD, np.uint64)))])
    return mix((sums[k:] - sums[:n]) * back)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of lower-cased (A-Z) words.

    A text with fewer words is one shingle, a text without words has none.
    """
    hashes = word_hashes(text.lower().split())
    if len(hashes) >= k:
        return np.unique(gram_hashes(hashes, k))
    return gram_hashes(hashes, len(hashes)) if len(hashes) else hashes


def slices(batch: pa.RecordBatch, most_bytes: int = 1 << 20):
    """Cuts a batch into runs of rows with about ``most_bytes`` in memory."""
    step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
