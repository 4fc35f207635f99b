"""Words, word hashes and shingles over the raw bytes of an Arrow string column, in numpy.

A batch is worked on in slices of about ``SLICE_BYTES``, so memory does not grow with the
batch; a single longer text is a slice of its own. Word bytes are folded (A-Z) by table, and
a word's hash comes from prefix sums of ``table[byte] * p**position`` modulo 2**64, so that
no step handles one word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_WHITE = (0x20, *range(0x09, 0x0E))
#: Every byte but white space, upper case A-Z counts as lower case.
NOT_WHITE = np.array([b not in _WHITE for b in range(256)])
#: Digits, ASCII letters and everything beyond ASCII.
ALPHANUMERIC = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64 bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, p in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Slice:
    """Some consecutive texts: their bytes and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def prefix_hashes(self, fold: bool = True) -> np.ndarray:
        """Running sums from which ``hash_spans`` takes the hash of any span."""
        powers, _ = _powers_to(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTES)[self.data] * powers[: len(self.data)], out=sums[1:])
        return sums

    def hash_spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = _powers_to(len(self.data))
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def spans(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of the first word of each text
        (one more entry than texts)."""
        inside = is_word[self.data]
        n = len(inside)
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        starts = np.flatnonzero(after & (~before | begins))
        ends = np.flatnonzero(before & (~after | begins))
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self, is_word: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of the first word of each text."""
        starts, ends, first = self.spans(is_word)
        return self.hash_spans(self.prefix_hashes(), starts, ends), first


def slices(column: pa.Array, limit: int | None = None) -> Iterator[Slice]:
    """Consecutive texts of about ``limit`` bytes together; null counts as empty."""
    limit = SLICE_BYTES if limit is None else limit
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one text, and the number of the first
    run of each text."""
    counts = np.diff(first)
    runs = np.maximum(counts - k + 1, 0)
    at = np.concatenate([[0], np.cumsum(runs)])
    total = len(hashes) - k + 1
    if total <= 0:
        return np.zeros(0, np.uint64), at
    out = np.zeros(total, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[j : j + total]
    keep = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    return mix(out[keep]), at


def crc32_mod(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of the number's text, modulo; -1 for null."""
    import zlib

    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids.to_pylist()])
