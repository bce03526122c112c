"""Hashes of words and of runs of words in whole batches of texts, with NumPy.

A text is a row of bytes; ``sum(byte[i] * base**i)`` over a stretch, shifted
back by the inverse power, depends on the stretch only. Prefix sums give it for
every word at once, in numbers modulo 2**64; a final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: The bytes that separate words.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all of a 64-bit number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each; one table per base is kept."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < size:
        size = max(size, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        known = _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return known


def forget_powers() -> None:
    _POWERS.clear()


def stretches(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins])


def runs(hashes: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hash of each run of ``length`` neighbouring hashes; empty where there are fewer."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, U)
    up, down = powers(n + 1, base)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins and ends in them; null counts as empty."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_SEPARATES = np.isin(np.arange(256), SEPARATORS)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and how many words come before each text (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATES[data]
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    starts[first], stops[last] = inside[first], inside[last]
    begins = np.flatnonzero(starts)
    return begins, np.flatnonzero(stops) + 1, np.searchsorted(begins, offsets)


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000):
    """Slices of a batch with a bounded number of bytes of text; a longer single text stays whole."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch[column].cast(pa.large_binary())], np.int64)
    reached, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = reached[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reached, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
