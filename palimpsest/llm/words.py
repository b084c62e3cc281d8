"""Words of whole text columns as flat numpy arrays.

A batch of texts is one UTF-8 buffer; words are runs of bytes of a class, found and hashed with array
operations over the buffer. No Python object is made per word, and a text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def _give_back() -> None:
    """Arrays beyond some MB, those of Arrow too, come from the system and go back to it when they are freed: a Python worker, which
    serves one task after another, does not keep the memory of the longest text that it has met."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        of_c = ctypes.CDLL(None)
        for option, value in ((-3, 4 << 20), (-1, 4 << 20), (-8, 2)):  # of the GNU C library: mapped from this size on, trimmed beyond it, arenas
            of_c.mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


_give_back()
#: Bytes of text handled at once, so few that the arrays over them stay in the cache; a longer text is a piece
#: of its own.
PIECE_BYTES = 1 << 17
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_INDEX = np.arange(256, dtype=np.uint64)
_EXACT = mix(_INDEX + U64(0x51ED2701))
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters and all beyond ASCII
LETTERED = np.zeros(256, dtype=bool)
LETTERED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            steps = np.full(size, _MULTIPLIER, dtype=np.uint64)
            steps[0] = 1
            _powers = np.multiply.accumulate(steps)
            steps = np.full(size, _INVERSE, dtype=np.uint64)
            steps[0] = 1
            _inverses = np.multiply.accumulate(steps)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for ascending, disjoint spans; ``fold`` takes A-Z as a-z."""
    out = np.empty(len(start), dtype=np.uint64)
    table, i = _FOLDED if fold else _EXACT, 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE_BYTES)))
            a, b = int(start[i]), int(end[j - 1])
            _tables(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(table[buf[a:b]] * _powers[: b - a], out=sums[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _inverses[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


@dataclass
class Texts:
    """Texts of rows ``low`` to ``high`` of a batch in one buffer; ``at`` has their bounds."""

    low: int
    high: int
    buf: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.high - self.low

    def text(self, row: int) -> bytes:
        return self.buf[self.at[row] : self.at[row + 1]].tobytes()


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[Texts]:
    """The texts of a string column (null: empty) in runs of about ``size`` bytes, whole texts each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, side="right")) - 1)
        yield Texts(low, high, whole[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


@dataclass
class Words:
    """Words of ``Texts``: byte spans, and ``first[r]`` to ``first[r + 1]`` are the words of row ``r``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: Texts, kind: np.ndarray) -> Words:
    """Runs of bytes of one class; ``kind`` has the class of each byte value, 0 (False) between words."""
    of = kind[texts.buf]
    turn = of[1:] != of[:-1]
    start, end = of > 0, of > 0
    start[1:] &= turn
    end[:-1] &= turn
    edges = texts.at[1:-1]
    edges = edges[(edges > 0) & (edges < len(of))]
    start[edges] = of[edges] > 0  # texts stand side by side: a word ends where its text does
    end[edges - 1] = of[edges - 1] > 0
    first = np.flatnonzero(start)
    return Words(first, np.flatnonzero(end) + 1, np.searchsorted(first, texts.at))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a row, and the windows' bounds by row.

    Window ``i`` of a row starts at its word ``i``. ``short``: a row with fewer words, but not none, is
    one window of all its words.
    """
    counts = np.diff(first)
    n = np.maximum(counts - size + 1, 0)
    if short:
        n = np.where((counts > 0) & (counts < size), 1, n)
    bounds = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n)
    with np.errstate(over="ignore"):
        out = np.zeros(len(begin), dtype=np.uint64)
        padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
        full = np.repeat(counts >= size, n)
        # factors without pattern: sums of them must not agree when words of a window change places
        factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | U64(1)
        for j in range(size):
            part = padded[begin + j] * factors[j]
            if short and not full.all():
                part = np.where(full | (j < np.repeat(counts, n)), part, U64(0))
            out += part
        if short:
            out = out + np.repeat(np.minimum(counts, size), n).astype(np.uint64)
        return mix(out), bounds


def runs_to_mask(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True at positions inside any of the spans."""
    step = np.zeros(length + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows that ``first`` bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of ``rows``, for work that makes Python objects of its rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
