"""Vectorised words, word hashes and shingles of Arrow text columns (numpy, whole batches at a time)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tessera.llm.lean import trim

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64); one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Parts of a batch whose texts hold about ``most_bytes`` at most (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
        if hi > lo:
            yield batch.slice(int(lo), int(hi - lo))
            trim(collect=False)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, end offsets per text with a leading 0, distinct words). A null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        flat, counts = flat.filter(pa.array(full)), np.bincount(owner[full], minlength=len(counts))
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), np.r_[0, np.cumsum(counts)].astype(np.int64), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word's bytes."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(distinct))


def shingles(hashes: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, in order, and their end offsets per text.

    A text with fewer words has one window of all of them; a text without words has none.
    """
    counts = np.diff(ends)
    n = len(hashes)
    short = (counts > 0) & (counts < width)
    out_counts = np.where(counts >= width, counts - width + 1, short.astype(np.int64))
    rolled = np.full(max(n - width + 1, 0), width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = mix(rolled * _STEP + hashes[k : k + len(rolled)])
        out = np.empty(int(out_counts.sum()), dtype=np.uint64)
        to = np.r_[0, np.cumsum(out_counts)]
        owner = np.repeat(np.arange(len(counts)), out_counts)
        whole = ~short[owner]
        place = np.arange(len(out)) - to[:-1][owner] + ends[:-1][owner]
        out[whole] = rolled[place[whole]]
        for d in np.flatnonzero(short):
            h = np.array([counts[d]], dtype=np.uint64)
            for x in hashes[ends[d] : ends[d + 1]]:
                h = mix(h * _STEP + x)
            out[to[d]] = h[0]
    return out, to
