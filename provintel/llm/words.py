"""Vectorized word and byte views of Arrow text batches, for tasks that score or fingerprint whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PRIME = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20
_BYTE_VALUES, _OTHER_VALUES = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240601, 20240602))


class Words(NamedTuple):
    """Words of a slice of rows: each word's row, first and last byte (exclusive) in data, and 64-bit hash."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of PRIME modulo 2**64, and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
        _powers, _inverses = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, p, dtype=np.uint64))]) for p in (PRIME, inverse))
    return _powers[:n], _inverses[:n]


def byte_prefix(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Prefix sums of byte values times powers: any slice's hash is a difference times an inverse power."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up, out=out[1:])
    return out


def other_hashes(w: Words) -> np.ndarray:
    """Hashes of the words' bytes that come from other byte values than w.hash."""
    prefix, (_, down) = byte_prefix(w.data, _OTHER_VALUES), powers(len(w.data) + 1)
    return mix((prefix[w.end] - prefix[w.start]) * down[w.start])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their text bytes end to end, n+1 offsets), of about ``most`` bytes or one row; null text is empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        _, raw, values = text.buffers()
        offsets = np.frombuffer(raw, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        del text, raw, values, data
        pa.default_memory_pool().release_unused()  # workers stay, and several share an executor


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of words: runs of bytes that aren't outside (ASCII white space), never across rows."""
    inside = ~outside[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[(edges > 0) & (edges <= len(data))] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def word_slices(batches: Iterator[pa.RecordBatch], column: str = "text", fold: bool = False, most: int = SLICE_BYTES, outside: np.ndarray = SPACES) -> Iterator[Words]:
    for batch, data, offsets in slices(batches, column, most):
        data = FOLD[data] if fold else data
        row, start, end = word_spans(data, offsets, outside)
        prefix, (_, down) = byte_prefix(data), powers(len(data) + 1)
        yield Words(batch, data, offsets, row, start, end, mix((prefix[end] - prefix[start]) * down[start]))


def runs(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and the place of each window's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = out * PRIME + hashes[k : k + size]
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    return mix(out[at]), at


def column(words: Words, name: str) -> pa.Array:
    return words.batch.column(words.batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
