"""Geometry on columns: positions, distances, projections, lines as arrays of points, polylines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

EARTH_KM = 6371.0
LINE = "array<struct<lon:double,lat:double>>"
_LINE_TYPE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def e7(degrees: Column) -> Column:
    """Degrees as whole 1e-7 degrees, halves up: equal positions have equal keys on every engine."""
    return F.floor(degrees * F.lit(1e7) + F.lit(0.5)).cast("long")


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def projection_t(px, py, ax, ay, bx, by) -> Column:
    """Where on a..b (0..1) the foot of p lies; null on a segment without length."""
    dx, dy = bx - ax, by - ay
    return F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)


def length(line: Column) -> Column:
    """Planar length of a line in its own units."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(a["lon"] - b["lon"], 2) + F.pow(a["lat"] - b["lat"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def repaired(line: Column) -> Column:
    """The line without points that are not finite and without repeats; null if fewer than two points are left."""
    finite = F.filter(line, lambda p: (F.abs(p["lon"]) < math.inf) & (F.abs(p["lat"]) < math.inf))  # NaN is above all
    before = F.concat(F.array(F.lit(None).cast("struct<lon:double,lat:double>")), finite)  # one longer, so the last pair has no point
    pairs = F.zip_with(finite, before, lambda p, q: F.struct(p.alias("p"), (p.isNotNull() & ~p.eqNullSafe(q)).alias("new")))
    kept = F.transform(F.filter(pairs, lambda x: x["new"]), lambda x: x["p"])
    return F.when(F.size(kept) >= 2, kept)


def linestring_json(line: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


def encode_polyline(points, digits: int = 6) -> str:
    """(lon, lat) pairs as an encoded polyline, latitude first, differences in zig-zag base 32."""
    out, last = [], [0, 0]
    for lon, lat in points:
        for i, v in enumerate((lat, lon)):
            n = round(v * 10**digits)
            d = n - last[i]
            last[i] = n
            d = ~(d << 1) if d < 0 else d << 1
            while d >= 0x20:
                out.append(chr((0x20 | (d & 0x1F)) + 63))
                d >>= 5
            out.append(chr(d + 63))
    return "".join(out)


def decode_polyline(text: str | None, digits: int = 6) -> list[tuple[float, float]] | None:
    if text is None:
        return None
    values, n, shift = [], 0, 0
    for c in text:
        b = ord(c) - 63
        n |= (b & 0x1F) << shift
        shift += 5
        if b < 0x20:
            values.append(~(n >> 1) if n & 1 else n >> 1)
            n, shift = 0, 0
    lat, lon = ([v / 10**digits for v in accumulate(values[i::2])] for i in (0, 1))
    return list(zip(lon, lat, strict=False))


def decoded_polylines(batch: pa.Array, digits: int = 6) -> pa.Array:
    """decode_polyline of a whole batch; texts with other characters, or numbers of over twelve of them, are null."""
    n = len(batch)
    text = batch.cast(pa.large_string()) if n else pa.array([None], pa.large_string())
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    code = (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[ends[0] : ends[-1]].astype(np.int64) - 63
    row = np.repeat(np.arange(len(text)), np.diff(ends))
    bad = np.bincount(row, (code < 0) | (code > 63), minlength=len(text)) > 0
    last = code & 32 == 0
    start = np.flatnonzero(np.concatenate([[True], last[:-1] | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(code)))
    bad |= np.bincount(row[start], size > 12, minlength=len(text)) > 0
    shift = np.minimum(np.arange(len(code)) - np.repeat(start, size), 11) * 5
    number = np.add.reduceat((code & 31) << shift, start) if len(start) else start
    whole = last[start + size - 1]  # the last number of a text may be torn off
    number, at = number[whole], row[start][whole]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(text)))])
    paired = np.arange(len(at)) - first[at] < (np.diff(first) // 2 * 2)[at]
    step, at = np.where(number & 1, ~(number >> 1), number >> 1)[paired], at[paired][0::2]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(text)))])

    def degrees(d: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(d)])
        return pa.array((sums[1:] - sums[first[at]]) / 10**digits)

    points = pa.StructArray.from_arrays([degrees(step[1::2]), degrees(step[0::2])], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), points, mask=pa.array(bad | ~np.asarray(text.is_valid()))).slice(0, n)


@F.arrow_udf(_LINE_TYPE)
def polyline_to_line(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from map(decoded_polylines, batches)


def line_to_polyline(line: Column, digits: int = 6) -> Column:
    """encode_polyline in columns; null for a null line, and no text for a line without points."""
    whole = F.flatten(F.transform(line, lambda p: F.array(*(F.round(p[c] * F.lit(10.0**digits)).cast("long") for c in ("lat", "lon")))))
    step = F.zip_with(whole, F.concat(F.array(F.lit(0), F.lit(0)).cast("array<bigint>"), whole), lambda v, w: v - w)  # two longer
    step = F.filter(step, lambda d: d.isNotNull())
    turned = F.transform(step, lambda d: F.when(d < 0, -2 * d - 1).otherwise(2 * d))
    places = F.array(*(F.lit(k) for k in range(0, 60, 5)))

    def text(v: Column) -> Column:
        rest = F.transform(F.filter(places, lambda k: (k == 0) | (F.call_function("shiftright", v, k) > 0)), lambda k: F.call_function("shiftright", v, k))
        return F.array_join(F.transform(rest, lambda r: F.chr(r % 32 + F.when(r >= 32, 95).otherwise(63))), "")

    return F.array_join(F.transform(turned, text), "")
