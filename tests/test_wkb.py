"""Well-known binary in batches against the same written and read one by one; cleaning of its lines."""

import math
import random
import struct
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from wayloom.functions import geo, wkb
from wayloom.operators import geometries

SIDE = st.floats(allow_nan=False)
LINES = st.lists(st.lists(st.tuples(SIDE, SIDE), max_size=4), max_size=3)


def written(parts, order="<", dims=2, marks=0, multi=None) -> bytes:
    """One geometry with struct: marks are added to the type's code, further numbers of a position are 7."""

    def head(kind, n):
        system = struct.pack(f"{order}I", 4326) if marks & wkb.SYSTEM else b""
        return bytes([order == "<"]) + struct.pack(f"{order}I", kind + marks) + system + struct.pack(f"{order}I", n)

    lines = [head(2, len(p)) + b"".join(struct.pack(f"{order}{dims}d", *xy, *[7.0] * (dims - 2)) for xy in p) for p in parts]
    return lines[0] if (len(parts) == 1 if multi is None else not multi) else head(5, len(parts)) + b"".join(lines)


def plain(column) -> list:
    return [None if g is None else [[(p["lon"], p["lat"]) for p in part] for part in g] for g in column.to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | LINES, max_size=6), st.sampled_from("<>"), st.sampled_from([(2, 0), (3, 1000), (3, wkb.HEIGHT), (3, wkb.MEASURE), (4, 3000), (2, wkb.SYSTEM)]))
def test_lines_in_batches(rows, order, shape):
    data = pa.array([None if g is None else written(g, order, *shape) for g in rows], pa.binary())
    assert plain(wkb.decoded(data)) == rows
    assert plain(wkb.decoded(data.slice(1))) == rows[1:]
    again = wkb.encoded(wkb.decoded(data))
    assert again.to_pylist() == [None if g is None else written(g) for g in rows]


@settings(max_examples=60, deadline=None)
@given(LINES, st.integers(0, 200))
def test_bytes_that_end_early_are_null(parts, size):
    whole = written(parts)
    good = written([[(1.0, 2.0)], [(3.0, 4.0)]])
    got = plain(wkb.decoded(pa.array([good, whole[:size], good], pa.binary())))
    assert got[0] == got[2] == [[(1.0, 2.0)], [(3.0, 4.0)]]
    assert got[1] == (parts if size >= len(whole) else None)


def test_what_is_no_line_is_null():
    point, odd = struct.pack("<BIdd", 1, 1, 1.0, 2.0), b"\x02" + written([[(1.0, 2.0)]])[1:]
    nested = written([[(1.0, 2.0)]], multi=True)[:9] + point
    assert plain(wkb.decoded(pa.array([point, odd, nested, b"", b"\x01\x02", None, written([])], pa.binary()))) == [None] * 6 + [[]]
    assert len(wkb.decoded(pa.array([], pa.binary()))) == 0
    many = [[(float(i), float(j)) for j in range(40)] for i in range(3000)]  # more positions than are gathered at once
    assert plain(wkb.decoded(pa.array([written(many)], pa.binary()))) == [many]
    assert wkb.encoded(wkb.decoded(pa.array([written(many)], pa.binary()))).to_pylist() == [written(many)]


def test_types_and_cleaning(spark):
    nan, inf = math.nan, math.inf
    line = [(1.0, 2.0), (1.0, 2.0), (nan, 3.0), (3.0, 4.0), (3.0, inf), (3.0, 4.0)]
    rows = [
        (1, written([line])),
        (2, written([[(0.0, 0.0)], line, [(5.0, 5.0), (5.0, 5.0)]], ">")),
        (3, written([line])[:-3]),
        (4, None),
        (5, struct.pack("<BIdd", 1, 1, 1.0, 2.0)),
        (6, written([line], ">", 3, 1000)),
        (6, written([])),
        (7, b"\x01"),
        (8, b"\x07" + written([line])[1:]),
    ]
    df = spark.createDataFrame([(i, None if g is None else bytearray(g), "x") for i, g in rows], "id long, geometry binary, part string").drop("part")
    got = {(r.id, r.part): [(p.lon, p.lat) for p in r.line] for r in geometries.clean_parts(df, "geometry").collect()}
    kept = [(1.0, 2.0), (3.0, 4.0)]
    assert got == {(1, 0): kept, (2, 1): kept, (6, 0): kept}
    assert geometries.losses(df, "geometry").first().asDict() == {"n_rows": 9, "n_null": 1, "n_unread": 4, "n_parts": 5, "n_short": 2, "n_kept": 3}
    kinds = {r.geometry_type: r.n for r in geometries.type_counts(df, "geometry").collect()}
    assert kinds == {"line": 3, "multiline": 2, "point": 1, None: 3}
    empty = df.limit(0)
    assert geometries.clean_parts(empty, "geometry").count() == 0 and geometries.losses(empty, "geometry").first().n_rows == 0
    with pytest.raises(ValueError):
        geometries.clean_parts(df.withColumnRenamed("id", "line"), "geometry")
    assert Counter(r[0] for r in df.select(wkb.from_parts(wkb.to_parts("geometry")) == df["geometry"]).collect()) == {True: 2, False: 2, None: 5}


POLYLINES = st.lists(st.none() | st.lists(st.tuples(st.integers(-180_000_000, 180_000_000), st.integers(-90_000_000, 90_000_000)), max_size=5), max_size=6)


@settings(max_examples=60, deadline=None)
@given(POLYLINES, st.integers(0, 3))
def test_polylines_in_batches(rows, torn):
    texts = [None if r is None else geo.encode_polyline([(x / 1e6, y / 1e6) for x, y in r]) for r in rows]
    texts = [t if t is None else t[: max(0, len(t) - torn)] for t in texts]
    want = [geo.decode_polyline(t) for t in texts]
    for low in (0, 1):
        got = geo.decoded_polylines(pa.array(texts, pa.string()).slice(low)).to_pylist()
        assert [None if g is None else [(p["lon"], p["lat"]) for p in g] for g in got] == want[low:]


def test_polylines_in_columns(spark):
    rng = random.Random(4)
    rows = [[], [(0.0, 0.0)], [(-180.0, -90.0), (180.0, 90.0)], None] + [[(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(rng.randrange(40))] for _ in range(50)]
    rows = [r and [(round(x, 6), round(y, 6)) for x, y in r] for r in rows]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, line {geo.LINE}")
    got = {r.id: (r.text, r.line) for r in df.withColumn("text", geo.line_to_polyline(df["line"])).withColumn("line", geo.polyline_to_line("text")).collect()}
    for i, r in enumerate(rows):
        text, line = got[i]
        assert text == (None if r is None else geo.encode_polyline(r))
        assert line == r if r is None else [(p.lon, p.lat) for p in line] == r
    bad = geo.decoded_polylines(pa.array(["_p~iF ", "\x7f" * 30, "é", "~" * 20 + "?", ""], pa.string())).to_pylist()
    assert bad == [None, None, None, None, []]
