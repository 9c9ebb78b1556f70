"""Words and word windows of whole Arrow text columns as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D.  Words are never cut out as
Python strings: a word is known by a 64-bit fingerprint of its bytes, a window of words
by a fingerprint of theirs, both computed for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text handled at once inside a task.  A longer single text is still one piece for its word
#: positions, but fingerprints are made for so many bytes at once.
PIECE_BYTES, PRINT_BYTES = 4 << 20, 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True


def _odd_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, dtype=np.uint64)
        if n:
            steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class _Tables:
    """Random byte codes and powers, made once per Python worker and grown on demand."""

    def __init__(self) -> None:
        self.codes = {}
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of_bytes(self, lower: bool) -> np.ndarray:
        if lower not in self.codes:
            codes = np.random.default_rng(20231).integers(1, 1 << 63, 256, dtype=np.uint64)
            if lower:
                codes[65:91] = codes[97:123]
            self.codes[lower] = codes
        return self.codes[lower]

    def of_base(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.powers.get(base)
        if have is None or len(have[0]) < n:
            self.powers[base] = have = _odd_powers(base, max(n, 1 << 16))
        return have[0][:n], have[1][:n]


_TABLES: list[_Tables] = []
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93


def _tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts: byte spans and how many words each text has."""

    data: np.ndarray  # bytes of all texts
    text_ends: np.ndarray  # byte offsets, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # word offsets, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def fingerprints(self, lower: bool = False) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        codes = _tables().of_bytes(lower)
        first = 0
        while first < len(out):
            begin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + PRINT_BYTES, side="right")))
            stop = int(self.ends[last - 1] - begin)
            up, down = _tables().of_base(BYTE_BASE, stop + 1)
            sums = np.zeros(stop + 1, dtype=np.uint64)
            np.cumsum(codes[self.data[begin : begin + stop]] * up[:stop], out=sums[1:])
            s, e = self.starts[first:last] - begin, self.ends[first:last] - begin
            out[first:last] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            first = last
        return out


def words_of(column: pa.Array, bare: bool = False) -> Words:
    """Words of every text of the column; NULL is an empty text.  ``bare`` words end at ASCII punctuation too."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[2] is None:
        nothing = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), np.zeros(n + 1, np.int64), nothing, nothing, np.zeros(n + 1, np.int64))
    bounds = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~(_PUNCTUATION if bare else _SPACE)[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins or ends here
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words, across text bounds too; shorter input has none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables().of_base(WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n])


def within(offsets: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a run of ``size`` words stays inside its text."""
    n = int(offsets[-1])
    ok = np.ones(max(0, n - size + 1), dtype=bool)
    for back in range(1, size):
        at = offsets[1:] - back
        at = at[(at >= offsets[:-1]) & (at < len(ok))]
        ok[at] = False
    return ok


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0).cast(pa.int64()))
        groups = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
