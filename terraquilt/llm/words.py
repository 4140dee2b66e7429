"""Words and word shingles of whole Arrow batches of text, as 64-bit hashes in numpy.

A word is a longest run of ASCII letters and digits and of characters outside ASCII,
after lower-casing. A shingle is a run of `k` words; a text of fewer words, but at
least one, has one shingle of all of them, and an empty text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terraquilt.llm.common import kept

SHINGLE_WORDS = 5
#: Bytes of text hashed at once; batches are cut at document bounds.
CHUNK_BYTES = 1 << 20

_M = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | _M(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = _M(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = (x ^ (x >> _M(32))) * _STEP
    x = (x ^ (x >> _M(29))) * _STEP
    return x ^ (x >> _M(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@kept
def _tables() -> dict[str, np.ndarray]:
    return {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    tables = _tables()
    if len(tables.get("up", ())) < n:
        size = max(n, CHUNK_BYTES)
        tables["up"], tables["down"] = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
    return tables["up"], tables["down"]


def text_column(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of plain strings, null as the empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(values.cast(pa.large_string()), "")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry
    more than texts)."""
    lower = pc.utf8_lower(texts)
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    first = int(offsets[0]) if len(offsets) else 0
    size = int(offsets[-1]) - first if len(offsets) else 0
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8)[first : first + size]
    bounds = offsets - first
    inside = _IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < size)]  # a word never runs on into the next text
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:size], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in order, and where each text's begin."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    if not len(words):
        return np.zeros(0, np.uint64), out_bounds
    up = powers(_BASE, max(k, 2))
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    rolling = np.zeros(len(words), np.uint64)
    for j in range(k):
        rolling += padded[j : j + len(words)] * up[j]
    short = np.flatnonzero((n > 0) & (n < k))
    for i in short:
        own = words[bounds[i] : bounds[i + 1]]
        rolling[bounds[i]] = (own * up[: len(own)]).sum(dtype=np.uint64)
    places = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    return mix(rolling[places]), out_bounds


def chunks(*columns: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes over all columns; a longer row is a range of its own."""
    sizes = np.cumsum(sum(pc.binary_length(c).to_numpy(zero_copy_only=False) for c in columns))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield at, to
        at = to
