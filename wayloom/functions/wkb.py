"""Well-known binary of lines, whole batches at a time: headers are read for all rows at once, a part a turn.

Read are LineString and MultiLineString of either byte order, with heights, measures or a reference system, which are
passed over. Anything else, and bytes that end too early, is null; bytes after the geometry are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

PARTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])))
#: The codes of the types, and the bits that add a height, a measure or a reference system to one.
TYPES = {1: "point", 2: "line", 3: "polygon", 4: "multipoint", 5: "multiline", 6: "multipolygon", 7: "collection"}
HEIGHT, MEASURE, SYSTEM = 0x80000000, 0x40000000, 0x20000000
LINE, MULTILINE = 2, 5
#: Positions whose bytes are gathered at once.
TOGETHER = 1 << 16

_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_PARTS = pa.list_(pa.list_(_POINT))


def geometry_type(geometry: Column) -> Column:
    """The name of a geometry's type by its header; null where there is none or it is not known."""
    code = F.hex(F.substring(geometry, 2, 4))
    turned = F.concat(*(F.substring(code, i, 2) for i in (7, 5, 3, 1)))
    order = F.hex(F.substring(geometry, 1, 1))
    number = F.conv(F.when(order == "01", turned).when(order == "00", code), 16, 10).cast("long").bitwiseAND(F.lit(0x1FFFFFFF))
    names = F.create_map(*(F.lit(v) for k in TYPES.items() for v in k))
    return F.when(F.octet_length(geometry) >= 5, F.try_element_at(names, F.when(number < 4000, number % 1000).cast("int")))


class _Reader:
    """The bytes of a batch and a place in each row."""

    def __init__(self, batch: pa.Array):
        whole = batch.cast(pa.large_binary())
        if not len(whole):
            whole = pa.array([None], pa.large_binary())
        _, ends, data = whole.buffers()
        ends = np.frombuffer(ends, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.at, self.end = ends[:-1].copy(), ends[1:]
        self.good = np.asarray(whole.is_valid())

    def holds(self, rows: np.ndarray, size) -> np.ndarray:
        """The rows that hold so many more bytes; the others are not good."""
        fits = size <= self.end[rows] - self.at[rows]
        self.good[rows[~fits]] = False
        return fits

    def numbers(self, rows: np.ndarray, little: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (with their byte order) that hold a whole number of four bytes, and it."""
        fits = self.holds(rows, 4)
        rows, little = rows[fits], little[fits]
        four = self.data[self.at[rows, None] + np.arange(4)]
        self.at[rows] += 4
        return fits, np.where(little, four.view("<u4")[:, 0] if len(rows) else 0, four.view(">u4")[:, 0] if len(rows) else 0).astype(np.int64)

    def headers(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """rows, byte order, type, numbers a position and the count that follows, of the rows that have all that."""
        rows = rows[self.holds(rows, 1)]
        order = self.data[self.at[rows]]
        self.good[rows[order > 1]] = False
        rows, little = rows[order <= 1], order[order <= 1] == 1
        self.at[rows] += 1
        fits, code = self.numbers(rows, little)
        rows, little = rows[fits], little[fits]
        marked = code & SYSTEM > 0
        kept = np.ones(len(rows), bool)
        kept[marked] = self.holds(rows[marked], 4)
        self.at[rows[marked]] += 4
        rows, little, code = rows[kept], little[kept], code[kept]
        plain = code & 0x1FFFFFFF
        kind, more = plain % 1000, plain // 1000
        self.good[rows[more > 3]] = False
        dims = 2 + ((code & HEIGHT > 0) | np.isin(more, (1, 3))) + ((code & MEASURE > 0) | np.isin(more, (2, 3)))
        fits, count = self.numbers(rows, little)
        return rows[fits], little[fits], kind[fits], dims[fits], count


def decoded(batch: pa.Array) -> pa.Array:
    """The parts of each geometry, each a list of positions."""
    r = _Reader(batch)
    start = r.at.copy()
    left = np.zeros(len(r.good), np.int64)
    rows, _, kind, _, count = r.headers(np.flatnonzero(r.good))
    r.good[rows[(kind != LINE) & (kind != MULTILINE)]] = False
    single = rows[kind == LINE]
    r.at[single], left[single] = start[single], 1
    left[rows[kind == MULTILINE]] = count[kind == MULTILINE]
    found = []
    while len(active := np.flatnonzero(r.good & (left > 0))):
        rows, little, kind, dims, count = r.headers(active)
        r.good[rows[kind != LINE]] = False
        size = count * dims * 8
        fits = r.holds(rows, size) & (kind == LINE)
        found.append(np.stack([rows, r.at[rows], count, little, dims])[:, fits])
        r.at[rows[fits]] += size[fits]
        left[rows] -= 1
    rows, at, count, little, dims = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    kept = np.flatnonzero(r.good[rows])
    kept = kept[np.argsort(rows[kept], kind="stable")]  # parts stay in order
    rows, at, count, little, dims = rows[kept], at[kept], count[kept], little[kept], dims[kept]
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.empty((ends[-1], 2))
    for low in range(0, len(out), TOGETHER):
        n = np.arange(low, min(low + TOGETHER, len(out)))
        part = np.searchsorted(ends, n, side="right") - 1
        where = at[part] + (n - ends[part]) * dims[part] * 8
        sixteen = r.data[where[:, None] + np.arange(16)]
        out[n] = np.where(little[part, None] > 0, sixteen.view("<f8"), sixteen.view(">f8"))
    points = pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], fields=list(_POINT))
    parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points)
    held = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=len(r.good)))])
    lists = pa.ListArray.from_arrays(pa.array(held, pa.int32()), parts, mask=pa.array(~r.good))
    return lists.slice(0, len(batch)).cast(_PARTS)


def encoded(batch: pa.Array) -> pa.Array:
    """Parts as little-endian binary: one part is a LineString, more or none a MultiLineString; null stays null."""
    parts = batch.flatten()
    points = parts.flatten()
    xy = np.stack([points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)], axis=1).astype("<f8")
    n = np.asarray(parts.value_lengths().fill_null(0), np.int64)
    k = np.asarray(batch.value_lengths().fill_null(0), np.int64)
    there = np.asarray(batch.is_valid())
    row = np.repeat(np.arange(len(k)), k)
    lead = np.where(there & (k != 1), 9, 0)
    size = lead + np.bincount(row, 9 + 16 * n, minlength=len(k)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    before = np.concatenate([[0], np.cumsum(9 + 16 * n)])[:-1]
    at = before + np.cumsum(lead)[row]
    data = np.zeros(ends[-1], np.uint8)

    def head(where: np.ndarray, kind: int, count: np.ndarray) -> None:
        data[where], data[where + 1] = 1, kind
        data[where[:, None] + np.arange(5, 9)] = count.astype("<u4")[:, None].view(np.uint8)

    head(ends[:-1][lead > 0], MULTILINE, k[lead > 0])
    head(at, LINE, n)
    first = np.concatenate([[0], np.cumsum(n)])
    for low in range(0, len(xy), TOGETHER):
        i = np.arange(low, min(low + TOGETHER, len(xy)))
        part = np.searchsorted(first, i, side="right") - 1
        data[(at[part] + 9 + (i - first[part]) * 16)[:, None] + np.arange(16)] = xy[i].view(np.uint8)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return pa.compute.if_else(pa.array(there), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


@F.arrow_udf(PARTS)
def to_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from map(decoded, batches)


@F.arrow_udf(T.BinaryType())
def from_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from map(encoded, batches)
