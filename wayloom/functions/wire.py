"""Fields of protocol buffers: whole numbers of varying length, one by one and as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def varint(n: int) -> bytes:
    """A whole number; a negative one counts as 64 bits."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def number_field(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def zigzag(n: np.ndarray) -> np.ndarray:
    """Signed numbers so that small ones of both signs are small."""
    n = n.astype(np.int64)
    return ((n << 1) ^ (n >> 63)).view(np.uint64)


def unzigzag(n: np.ndarray) -> np.ndarray:
    return (n >> np.uint64(1)).view(np.int64) ^ -(n & np.uint64(1)).view(np.int64)


def sizes(n: np.ndarray) -> np.ndarray:
    """Bytes that each number takes."""
    return 1 + sum((n >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))


def varints(n: np.ndarray) -> bytes:
    """Numbers (uint64) one after the other."""
    size = sizes(n)
    shift = np.arange(10, dtype=np.uint64) * np.uint64(7)
    place = np.arange(10)
    groups = ((n[:, None] >> shift) & np.uint64(127)).astype(np.uint8) | np.where(place < size[:, None] - 1, 128, 0).astype(np.uint8)
    return groups[place < size[:, None]].tobytes()


def numbers(data: bytes) -> np.ndarray:
    """The numbers (uint64) that varints() wrote."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    if b[-1] > 127:
        raise ValueError("the last number is cut off")
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (place * 7).astype(np.uint64), starts)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field: bytes, or a number."""
    at = 0

    def whole() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = whole()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, whole()
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind) or whole()
            if at + size > len(data):
                raise ValueError("a field is cut off")
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"no such kind of field: {kind}")
