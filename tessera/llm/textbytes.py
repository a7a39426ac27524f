"""Vectorised work on UTF-8 bytes of Arrow string columns: spans, hashes and ragged gathers.

Texts of a batch are handled in pieces of a few megabytes, whole texts at a time, so memory is
bounded by the piece size or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
PIECE_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for i, step in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, step, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


class SpanHasher:
    """Hashes of any byte spans of one buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _tables(len(data) + 1)
        self.sums = np.empty(len(data) + 1, _U)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * up[: len(data)], dtype=_U, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h += (end - start).astype(_U) * _U(0xA24BAED4963EE407)
        return mix(h)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offset of each row; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows: first row, end row, their bytes, their offsets in those bytes."""
    raw, at = strings(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


#: Bytes that part words: space, and 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, at: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the number of words before each row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~outside[data]
    change = np.diff(inside)
    starts, ends = change[:-1] == 1, change[1:] == -1  # ends[i]: byte i is the last of a word
    # a row border inside a run of word bytes parts two words
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    starts[both] = True
    ends[both - 1] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, at)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def slices(batch: pa.RecordBatch, column: int | pa.Array, limit: int = 4 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts hold about ``limit`` bytes, one row at least."""
    _, at = strings(batch.column(column) if isinstance(column, int) else column)
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(batch.num_rows, max(end, row + 1))
        yield batch.slice(row, end - row)
        row = end
