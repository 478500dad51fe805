"""Vectorised word and n-gram hashing over Arrow string batches.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. All hashes are Rabin-Karp polynomials modulo
2**64 with an odd base: prefix sums give the hash of any slice, and the base's inverse shifts it to position 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 21
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(U)


#: Entries of the tables of powers that stay in a worker; longer ones are made for one call and dropped.
TABLE = 1 << 18


def _make(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below size."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size, b, U)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(2)
def _table(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _make(base, TABLE)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(base) if size <= TABLE else _make(base, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler, so that minima and sums of hashes behave as random."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    p, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Scrambled hashes of the slices [lo, hi) of what ``pre`` was built from."""
    _, inv = powers(base, len(pre))
    return mix((pre[hi] - pre[lo]) * inv[lo] + (hi - lo).astype(U))


class Words:
    """The words of a slice of documents: byte spans, hashes, and per document the range of its words."""

    def __init__(self, texts: pa.Array, blank: np.ndarray = _WS, fold: np.ndarray | None = None):
        """``blank``: which bytes separate words; ``fold``: what bytes are replaced with before hashing."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        if texts.null_count:
            texts = texts.fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[off[0] : off[-1]] if fold is None else fold[data[off[0] : off[-1]]]
        self.off = off - off[0]
        size = len(self.data)
        word = np.zeros(size + 1, bool)
        np.logical_not(blank[self.data], out=word[:size])
        first = np.zeros(size + 1, bool)
        first[self.off] = True
        before = np.zeros(size + 1, bool)
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (first | ~before))
        self.starts = starts
        self.ends = np.flatnonzero(before & (first | ~word))
        self.lo = np.searchsorted(starts, self.off[:-1])
        self.hi = np.searchsorted(starts, self.off[1:])
        self.count = self.hi - self.lo

    def hashes(self) -> np.ndarray:
        """A hash a word: words are taken in runs of under TABLE bytes, so memory beside the result does not grow."""
        out = np.empty(len(self.starts), U)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + TABLE, "left")))
            lo, hi = int(self.starts[at]), int(self.ends[to - 1])
            if hi - lo < TABLE:
                out[at:to] = spans(prefix(_BYTES[self.data[lo:hi]], _BYTE_BASE), self.starts[at:to] - lo, self.ends[at:to] - lo, _BYTE_BASE)
            else:
                out[at] = self._long(lo, hi)
            at = to
        return out

    def _long(self, lo: int, hi: int) -> np.uint64:
        """The hash of one word that is longer than the table, piece by piece."""
        p, _ = powers(_BYTE_BASE, TABLE)
        total, shift, step = 0, 1, pow(_BYTE_BASE, TABLE, 2**64)
        for a in range(lo, hi, TABLE):
            part = _BYTES[self.data[a : min(hi, a + TABLE)]]
            total = (total + int((part * p[: len(part)]).sum(dtype=U)) * shift) % 2**64
            shift = shift * step % 2**64
        return mix(np.array([(total + hi - lo) % 2**64], U))[0]

    def grams(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the k-word grams of all documents, and per document the range of its grams. A document of
        1 to k-1 words has one gram, of all its words."""
        h = self.hashes() if hashes is None else hashes
        n = np.where(self.count >= k, self.count - k + 1, np.minimum(self.count, 1))
        hi = np.cumsum(n)
        lo = hi - n
        whole = word_grams(h, k)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if not len(short):
            at = np.arange(hi[-1] if len(hi) else 0) - np.repeat(lo - self.lo, n)
            return whole[at], lo, hi
        out = np.empty(int(hi[-1]), U)
        full = np.ones(len(out), bool)
        full[lo[short]] = False
        out[full] = whole[(np.arange(len(out)) - np.repeat(lo - self.lo, n))[full]]
        p, _ = powers(_WORD_BASE, k)
        total = np.zeros(len(short), U)
        for r in range(k - 1):
            there = self.count[short] > r
            total[there] += h[self.lo[short][there] + r] * p[r]
        out[lo[short]] = mix(total + self.count[short].astype(U))
        return out, lo, hi


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words (of the whole slice, documents run together), as ``word_spans`` gives it."""
    p, _ = powers(_WORD_BASE, k)
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, k, U)
    for r in range(k):
        total += hashes[r : r + n] * p[r]
    return mix(total)


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    return prefix(hashes, _WORD_BASE)


def word_spans(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return spans(pre, lo, hi, _WORD_BASE)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then lo[1], ..."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(lo - (end - n), n)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold about ``limit`` bytes; one row at least, always a whole text."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def strings(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.string())
