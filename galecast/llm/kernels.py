"""Numpy kernels over Arrow text columns, for use inside tasks.

Texts are handled as their UTF-8 bytes, a bounded slice of rows at a time, so
that a worker's memory follows the slice (or the longest single text) and not
the batch.  Hashes of any run of bytes or words come from one running sum
modulo 2**64: ``sum(x[i] * P**i)`` over the run, divided by ``P**start``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _table(pattern_low: set[int]) -> np.ndarray:
    """Word bytes: every byte that is not in ``pattern_low``."""
    out = np.ones(256, dtype=bool)
    out[sorted(pattern_low)] = False
    return out


#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; bytes of multi-byte characters are word bytes in both.
SPACED = _table({0x20, *range(0x09, 0x0E)})
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``
LETTERS = _table({*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def row_slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of consecutive slices of at most ``limit`` bytes, one row at least."""
    if not len(text):
        return
    ends = _offsets(text)
    at = 0
    while at < len(text):
        n = max(1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1 - at)
        yield at, n
        at += n


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset:text.offset + len(text) + 1]


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end, and where each begins (one more than rows); null is empty."""
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if text.null_count:
        text = text.fill_null("")
    at = _offsets(text).astype(np.int64)
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n."""
    for key, b in ((base, base), (-base, pow(base, -1, 1 << 64))):
        have = _powers.get(key, np.ones(1, np.uint64))
        while len(have) < n:
            step = np.uint64(pow(b, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _powers[key] = have
    return _powers[base][:n], _powers[-base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a murmur-style finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``, one more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs ``start..end`` that depend on their content only."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start])


class Words:
    """Words of consecutive texts: ``start``, ``end`` (bytes), ``first`` (the first word of each text, and the end)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.norm = LOWER[buf] if lower else buf
        inside = kind[self.norm]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def of_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        sums = running(self.norm.astype(np.uint64) + np.uint64(1), BYTE_BASE)
        return run_hash(sums, self.start, self.end, BYTE_BASE)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of ``n`` words inside one text, and the text of each."""
        of = self.of_text()
        at = np.arange(max(0, len(of) - n + 1))
        same = of[at] == of[at + n - 1] if len(at) else np.zeros(0, bool)
        at = at[same]
        return at, of[at]

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b, with one space between them."""
        return b" ".join(self.norm[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def word_run_sums(hashes: np.ndarray) -> np.ndarray:
    return running(hashes, _WORD_BASE)


def word_run_hash(sums: np.ndarray, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return run_hash(sums, at, at + n, _WORD_BASE)


def byte_run_sums(buf: np.ndarray) -> np.ndarray:
    return running(buf.astype(np.uint64) + np.uint64(1), BYTE_BASE)


def byte_run_hash(sums: np.ndarray, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return run_hash(sums, at, at + n, BYTE_BASE)


def gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the strings of ``n`` bytes at every position, spread enough to be compared."""
    x = (sums[n:] - sums[:-n]) * powers(BYTE_BASE, len(sums))[1][:len(sums) - n] if len(sums) > n else sums[:0]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of ``starts[i] + 0 .. counts[i] - 1``, and the i of each."""
    own = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[own] + at, own


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True in ``mask``; a run ends at each of ``offsets``."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    stops[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the given ranges."""
    steps = np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def sums_by(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
