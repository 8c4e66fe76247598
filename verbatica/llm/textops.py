"""Array kernels over text shared by the operators that work inside Arrow batches.

A kernel takes a list of whole texts, lays them end to end as one code point array and
works on all of them at once.  Batches are cut by characters, so memory is bounded by
``MAX_CHARS`` or by the longest single text, whichever is larger.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

MAX_CHARS = 1_000_000
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93 | 1
_Q_INV = pow(_Q, -1, 1 << 64)
_SEGMENT = 1 << 20
_CODES = sys.maxunicode + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=None)
def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=None)
def code_table(test: Callable[[str], bool]) -> np.ndarray:
    """test of every code point, as a lookup table."""
    return np.fromiter((test(chr(c)) for c in range(_CODES)), dtype=bool, count=_CODES)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of every code point that has a single one; lengths never change."""
    out = np.arange(_CODES, dtype=np.uint32)
    for c in range(0x20000):
        s = chr(c).lower()
        if len(s) == 1:
            out[c] = ord(s)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line feed after each, and where each text begins (and a last end)."""
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return cps, starts


def ascii_lower(cps: np.ndarray) -> np.ndarray:
    upper = (cps >= 65) & (cps <= 90)
    return cps + (upper.astype(np.uint32) << np.uint32(5))


def not_blank(cps: np.ndarray) -> np.ndarray:
    """Everything but space and U+0009 to U+000D."""
    return ~((cps == 32) | ((cps >= 9) & (cps <= 13)))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of True; the last element must be False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int, inv: int) -> np.ndarray:
    """sum(values[i] * p**(i - start)) modulo 2**64 of each window, from running sums; exact as p is odd."""
    out = np.empty(len(starts), dtype=np.uint64)
    power, inverse, k = _powers(p), _powers(inv), 0
    while k < len(starts):
        lo = int(starts[k])
        if int(ends[k]) - lo > _SEGMENT:  # one window longer than a segment
            total = 0
            for at in range(lo, int(ends[k]), _SEGMENT):
                part = values[at : min(at + _SEGMENT, int(ends[k]))].astype(np.uint64)
                total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(p, at - lo, 1 << 64)
            out[k] = total & _M64
            k += 1
            continue
        to = k + int(np.searchsorted(ends[k:], lo + _SEGMENT, side="right"))
        part = values[lo : int(ends[to - 1])].astype(np.uint64)
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=running[1:])
        s = starts[k:to] - lo
        out[k:to] = (running[ends[k:to] - lo] - running[s]) * inverse[s]
        k = to
    return out


def token_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's code points."""
    return mix(_sums(cps + np.uint32(1), starts, ends, _P, _P_INV) + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each start; a start needs k words after it."""
    return mix(_sums(words, starts, starts + k, _Q, _Q_INV) + np.uint64(k))


class Words:
    """Words of a list of texts: hashes, and the number of the first word of each text (and a last end)."""

    def __init__(self, texts: list[str], inside: Callable[[np.ndarray], np.ndarray], fold: Callable[[np.ndarray], np.ndarray] | None = ascii_lower):
        cps, self.text_start = code_points(texts)
        if fold is not None:
            cps = fold(cps)
        self.start, self.end = runs(inside(cps))
        self.first = np.searchsorted(self.start, self.text_start)
        self.hash = token_hashes(cps, self.start, self.end)
        self.n = np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of k words that stay in one text, and the number of windows of each text."""
        count = np.maximum(self.n - k + 1, 0)
        return expand(self.first[:-1], count), count


def expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)


def portions(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = MAX_CHARS, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about ``most`` characters and at most so many rows, with their texts (null as empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        at = 0
        while at < batch.num_rows:
            texts, chars = [], 0
            while at + len(texts) < batch.num_rows and len(texts) < rows and (chars < most or not texts):
                value = column[at + len(texts)].as_py() or ""
                texts.append(value)
                chars += len(value)
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
