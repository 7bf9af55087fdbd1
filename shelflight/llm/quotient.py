"""Counting quotient filters of packed word numbers, in whole arrays.

A phrase of two or three word numbers of ``bits`` bits each (0 for no first word) is
packed in two halves of ``half_bits(bits)`` bits. A Feistel network permutes the packed
numbers, so the keys of any text are spread evenly; it is invertible, and the filter
keeps the whole remainder, so nothing is lost: equal keys are equal phrases, and the
phrases come back from the filter.

A filter holds, for the keys of one prefix (their first ``prefix`` bits):

* ``occupied``, a bit for each quotient (the next bits of the key) that has an entry;
* ``closes``, a bit for each entry that is the last one of its quotient;
* the rest of each entry's key, packed in whole bytes;
* a bit that is set if its count is above one; such counts, a byte each, or 255 and
  then eight bytes.

Entries stand in the order of their keys, so filters are merged like sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

ROUNDS = 4
_HEAD = struct.Struct("<QBBBI")
_KEYS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def half_bits(bits: int) -> int:
    return (3 * bits + 1) // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(words: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) halves of word numbers below 2^bits; bits <= 32."""
    first, second, third = words
    half, step = half_bits(bits), np.uint64(bits)
    tail = (second << step) | third
    high = (first << np.uint64(2 * bits - half)) | (tail >> np.uint64(half))
    return high, tail & _mask(half)


def unpack(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    half, step = half_bits(bits), np.uint64(bits)
    tail = ((high << np.uint64(half)) | low) & _mask(2 * bits)
    return high >> np.uint64(2 * bits - half), tail >> step, tail & _mask(bits)


def _noise(half: np.ndarray, turn: int, bits: int) -> np.ndarray:
    mixed = (half + np.uint64(turn)) * np.uint64(_KEYS[turn % len(_KEYS)])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_KEYS[0])
    return mixed >> np.uint64(64 - bits)


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves below 2^half to halves below 2^half, one to one."""
    for turn in range(ROUNDS):
        high, low = low, high ^ _noise(low, turn, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``permute`` gave these halves for."""
    for turn in reversed(range(ROUNDS)):
        high, low = low ^ _noise(high, turn, half), high
    return high, low


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int):
    """(high, low, counts) of the distinct keys, in order. No counts: each is one."""
    if not len(high):
        return high, low, np.zeros(0, np.int64)
    if 2 * half <= 64:
        key = (high << np.uint64(half)) | low
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        high, low = key[first] >> np.uint64(half), key[first] & _mask(half)
        total = len(key)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        counts = None if counts is None else counts[order]
        first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        total = len(high)
        high, low = high[first], low[first]
    if counts is None:
        return high, low, np.diff(np.append(first, total))
    return high, low, np.add.reduceat(counts, first)


def _quotient_bits(n: int, half: int, prefix: int) -> int:
    """The quotient that makes the smallest filter of ``n`` keys."""
    room = range(0, min(half - prefix, max(n, 1).bit_length() + 5) + 1)
    return min(room, key=lambda q: (1 << q) / 8 + n * ((2 * half - prefix - q + 7) // 8))


def write(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, prefix: int) -> bytes:
    """A filter of sorted distinct keys that share their first ``prefix`` bits."""
    n = len(high)
    q = _quotient_bits(n, half, prefix)
    rest = half - prefix - q
    start = int(high[0]) >> (half - prefix) if n and prefix else 0
    high = high & _mask(half - prefix)
    quotient = (high >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    closes = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    high = high & _mask(rest)
    size = (half + rest + 7) // 8
    bytes_low = (low | (high << np.uint64(half))).astype("<u8").view(np.uint8).reshape(-1, 8)
    bytes_high = (high >> np.uint64(64 - half)).astype("<u8").view(np.uint8).reshape(-1, 8)
    remainder = np.concatenate([bytes_low, bytes_high], axis=1)[:, :size]
    more = counts > 1
    some = counts[more]
    return b"".join([
        _HEAD.pack(n, q, half, prefix, start), np.packbits(occupied).tobytes(), np.packbits(closes).tobytes(),
        np.ascontiguousarray(remainder).tobytes(), np.packbits(more).tobytes(),
        np.minimum(some, 255).astype(np.uint8).tobytes(), some[some >= 255].astype("<u8").tobytes(),
    ])


def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, counts) of a filter."""
    n, q, half, prefix, start = _HEAD.unpack_from(data)
    at, rest = _HEAD.size, half - prefix - q

    def take(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, np.uint8, size, at)
        at += size
        return part

    occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
    closes = np.unpackbits(take((n + 7) // 8), count=n)
    size = (half + rest + 7) // 8
    padded = np.zeros((n, 16), np.uint8)
    padded[:, :size] = take(n * size).reshape(n, size)
    more = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
    some = take(int(more.sum())).astype(np.int64)
    some[some == 255] = np.frombuffer(data, "<u8", -1, at).astype(np.int64)
    counts = np.ones(n, np.int64)
    counts[more] = some
    words = padded.view("<u8")
    quotient = occupied[np.cumsum(closes) - closes].astype(np.uint64)
    low = words[:, 0] & _mask(half)
    high = (words[:, 0] >> np.uint64(half)) | (words[:, 1] << np.uint64(64 - half))
    high = (high & _mask(rest)) | (quotient << np.uint64(rest)) | np.uint64(start << (half - prefix))
    return high, low, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray, np.ndarray]], half: int):
    """(high, low, counts) of sorted lists together; the stable sort merges their runs."""
    return counted(*(np.concatenate(side) for side in zip(*filters)), half)


def cut(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, prefix: int):
    """(prefix value, high, low, counts) of sorted keys, for each prefix that occurs."""
    values = (high >> np.uint64(half - prefix)).astype(np.int64) if prefix else np.zeros(len(high), np.int64)
    edges = np.append(0, np.flatnonzero(np.diff(values)) + 1)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(high)]):
        if b > a:
            yield int(values[a]), high[a:b], low[a:b], counts[a:b]
