"""NumPy kernels over Arrow text columns, shared by the operators of this subpackage.

All of them take whole texts, work slice by slice so that memory is bounded by
the slice (or by one text, where a text is longer than a slice), and hold no
state between rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


#: What operators keep in a Python worker from task to task: for each operator, how to let go of it, which tells whether there was anything.
KEPT: dict[str, Callable[[], bool]] = {}


def enter(operator: str) -> None:
    """Called as an operator's function begins in a worker, which may have worked for others before: what they have kept goes, back to the system."""
    if any([drop() for name, drop in KEPT.items() if name != operator]):
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # the GNU C library keeps what is freed unless asked
            trim(0)


def forget(kept: dict) -> bool:
    """Empty a dictionary of things kept; whether there were any."""
    some = bool(kept)
    kept.clear()
    return some


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA24BAED4963EE407)
    x ^= x >> _U(32)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(mix64(np.arange(1, n + 1, dtype=_U) * _U(_P) + _U(seed)) + _U(seed))


_BYTE_CODE = random64(256, 11)


class _Powers:
    """Powers of an odd constant and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, p, _U)])) for p in (_P, _PINV))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each span; the same codes give the same hash wherever they stand."""
    up, down = _POWERS.get(len(codes))
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * up, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def text_slices(column: pa.Array | pa.ChunkedArray, ending: bytes = b"\n", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, bounds): the rows' UTF-8 texts, each followed by ``ending``.

    Null texts are empty. Text k of the slice is bytes[bounds[k]:bounds[k + 1]],
    ``ending`` included. A slice has one text at least and about ``most`` bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths + len(ending))
    first = 0
    while first < len(column):
        base = run[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(run, base + most, "right")))
        part = pc.binary_join_element_wise(column.slice(first, end - first), pa.scalar(ending, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield first, end, data, bounds - bounds[0]
        first = end


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER_CODE = _BYTE_CODE[LOWER]


def spaced_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice (runs of bytes but ASCII white space, A-Z lowered) and each text's first word number."""
    apart = _SPACE[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if len(data) and not apart[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # a slice ends with white space
    return span_hashes(_LOWER_CODE[data], starts, ends), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and each text's first run number; a text of fewer words, but not none, has one run of all its words."""
    lengths = np.diff(first)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    coefficients = random64(width, 29) | _U(1)
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    short = np.repeat((lengths < width) & (lengths > 0), counts)
    padded = np.concatenate([words, np.zeros(width, _U)])
    left = np.repeat(np.minimum(lengths, width), counts) if short.any() else None
    total = np.zeros(len(at), _U)
    for j in range(width):
        term = padded[at + j] * coefficients[j]
        total += term if left is None else np.where(left > j, term, _U(0))
    if left is not None:
        total += _U(width) - left.astype(_U)
    return mix64(total), begin


def batches_of(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the named columns, cast to the schema."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in schema for x in [rows[f.name]]], schema=schema)
