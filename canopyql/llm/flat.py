"""Texts of an Arrow batch as one byte array, and whole-array hashing of what is in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_STEP), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of texts with about most bytes, at least one text each."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield first, last - first
        first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and their n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, which: str) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, _STEP if which == "up" else _INVERSE, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 << 20:
            _POWERS[which] = have
    return have


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word, a run of bytes outside SPACE; no word crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, none of them empty."""
    if not len(start):
        return np.zeros(0, U)
    n = len(data)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * _powers(n, "up")[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(n, "down")[start] + (end - start).astype(U) * _ODD)


def find(sorted_keys: np.ndarray, wanted: np.ndarray, table: tuple | None = None) -> np.ndarray:
    """The position of each wanted key in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    if table is not None:
        slots, shift = table
        at = slots[(wanted * _ODD) >> shift].astype(np.int64)
        missed = np.flatnonzero(sorted_keys[np.maximum(at, 0)] != wanted)
        if len(missed):
            at[missed] = find(sorted_keys, wanted[missed])
        return at
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


def slots(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A table for ``find``: most keys are then found by one look instead of a search."""
    bits = max(10, int(len(sorted_keys)).bit_length() + 2)
    shift = U(64 - bits)
    made = np.zeros(1 << bits, dtype=np.int32)
    made[(sorted_keys * _ODD) >> shift] = np.arange(len(sorted_keys), dtype=np.int32)
    return made, shift
