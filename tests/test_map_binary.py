"""The binary map format: arrays of numbers, blocks, files cut anywhere, and tables there and back."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from wayloom.functions import wire
from wayloom.sources import map_binary as mb


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_numbers_there_and_back(n):
    a = np.array(n, np.int64)
    z = wire.zigzag(a)
    assert wire.unzigzag(z).tolist() == n
    data = wire.varints(z)
    assert data == b"".join(wire.varint(int(v)) for v in z) and wire.numbers(data).tolist() == z.tolist()


def test_a_node_block_by_hand():
    # One block of two nodes, (id 1, 0, 0) and (id 3, lat 1e-6 degrees south, lon 2e-7 east), the second with a tag.
    batch = mb._batch("node", np.array([1, 3]), np.array([0, -10]), np.array([0, 2]), None, [[], [("a", "b")]])
    data = mb.node_block(batch)
    length = int.from_bytes(data[:4], "big")
    assert data[4 : 4 + length].startswith(b"\x0a\x07OSMData\x18")
    body = mb.content(data[4 + length :])
    assert body == b"\x0a\x08\x0a\x00\x0a\x01a\x0a\x01b" + b"\x12\x14\x12\x12" + b"\x0a\x02\x02\x04" + b"\x42\x02\x00\x13" + b"\x4a\x02\x00\x04" + b"\x52\x04\x00\x01\x02\x00"
    (back,) = mb.elements(body)
    assert back.equals(batch)


def test_nodes_of_their_own_and_another_scale():
    node = wire.field(1, wire.number_field(1, 14) + wire.field(2, b"\x01") + wire.field(3, b"\x02") + wire.number_field(8, 6) + wire.number_field(9, 5))
    block = wire.field(1, b"".join(wire.field(1, w) for w in (b"", b"k", b"v"))) + wire.field(2, node) + wire.number_field(17, 1000) + wire.number_field(19, 500) + wire.number_field(20, -1000)
    (b,) = mb.elements(block)
    assert b.to_pylist() == [{"kind": "node", "id": 7, "lat_e7": 35, "lon_e7": -40, "refs": None, "tags": [("k", "v")]}]
    assert list(mb.elements(block, "way")) == []


def tables(spark, n):
    at = [(i * 7 - 40, 466000000 + i * 13 % 997 - 500000000, 246000000 - i * 11 % 499) for i in range(n)]
    ways = [(w, s, at[(w * 31 + s * s) % n][0]) for w in range(-3, n // 4) for s in range(1, 2 + w % 5)]
    tags = [(w, {"name": f"wég & {w}", "highway": "road"}) for w in range(0, n // 4, 3)]
    return at, ways, tags, spark.createDataFrame(at, "node_id long, x_e7 long, y_e7 long"), spark.createDataFrame(ways, "way_id long, seq long, node_id long"), spark.createDataFrame(tags, "way_id long, tags map<string,string>")


def test_tables_there_and_back_in_any_split(spark, tmp_path):
    at, ways, tags, n, w, t = tables(spark, 9000)
    path = str(tmp_path / "map")
    mb.write(n, w, path, t)
    for split in (mb.SPLIT_BYTES, 4001, 700):
        assert sorted(tuple(r) for r in mb.read_nodes(spark, path, split).collect()) == sorted(at)
        assert sorted(tuple(r) for r in mb.read_ways(spark, path, split).collect()) == sorted(ways)
    # Every file is whole and, in the manifest's order, so are all: nodes before ways, each by id.
    found = {(r["way_id"], r["key"]): r["value"] for r in mb.read_tags(spark, path).collect()}
    assert found == {(i, k): v for i, kv in tags for k, v in kv.items()}
    spark.dataSource.register(mb.MapBinary)
    rows = [(r["kind"], r["id"]) for r in spark.read.format("map_binary").load(path).select("kind", "id").collect()]
    assert rows == sorted(rows)
    one = next((tmp_path / "map").glob("*.pbf"))
    assert spark.read.format("map_binary").load(str(one)).count() > 0


def test_a_split_may_start_anywhere(tmp_path):
    ids = np.arange(1, 40)
    blocks = [mb.node_block(mb._batch("node", ids + 100 * i, ids, ids, None, [[("OSMData", "\n\x07OSMData\x18\x05")]] * len(ids))) for i in range(5)]
    # A block that is not compressed and whose strings look like a head.
    raw = mb.content(blocks[0][4 + int.from_bytes(blocks[0][:4], "big") :])
    body = wire.field(1, raw)
    head = wire.field(1, b"OSMData") + wire.number_field(3, len(body))
    data = mb.header(False) + len(head).to_bytes(4, "big") + head + body + b"".join(blocks[1:])
    (tmp_path / "a.pbf").write_bytes(data)
    for split in range(1, len(data), 37):
        reader = mb._Reader(str(tmp_path / "a.pbf"), None, split)
        got = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("id").to_pylist()]
        assert got == [i + 100 * k for k in range(5) for i in ids.tolist()]


def test_long_ways_and_many_references_fill_blocks(monkeypatch):
    monkeypatch.setattr(mb, "BLOCK_REFS", 100)
    refs = [np.arange(n) * (-1) ** n for n in (60, 50, 500, 0, 1)]
    batch = mb._batch("way", np.array([-9, 2, 3, 4, 5]), None, None, refs, [[], [("k", "v"), ("l", "v")], [], [], []])
    runs = list(mb._runs(batch))
    assert [r.num_rows for r in runs] == [1, 1, 1, 2]
    body = lambda d: mb.content(d[4 + int.from_bytes(d[:4], "big") :])
    back = pa.Table.from_batches([b for r in runs for b in mb.elements(body(mb.way_block(r)))])
    assert back.to_pylist() == pa.Table.from_batches([batch]).to_pylist()


def test_nulls_empty_tables_and_broken_files(spark, tmp_path):
    nodes, ways = "node_id long, x_e7 long, y_e7 long, kind string", "way_id long, seq long, node_id long, tags string"
    n = spark.createDataFrame([(1, 5, 6, "x"), (None, 1, 1, "x"), (2, None, 1, None), (1, 5, 6, "y")], nodes)
    w = spark.createDataFrame([(7, 1, 1, None), (7, 2, None, None), (7, 3, 1, None), (None, 1, 1, None), (8, 1, None, None)], ways)
    t = spark.createDataFrame([(7, {"a": None, "b": "c"}), (9, {"a": "b"}), (None, {"a": "b"})], "way_id long, tags map<string,string>")
    mb.write(n, w, str(tmp_path / "a"), t)
    assert [tuple(r) for r in mb.read_nodes(spark, str(tmp_path / "a")).collect()] == [(1, 5, 6), (1, 5, 6)]
    assert sorted(tuple(r) for r in mb.read_ways(spark, str(tmp_path / "a")).collect()) == [(7, 1, 1), (7, 2, 1)]
    assert [tuple(r) for r in mb.read_tags(spark, str(tmp_path / "a")).collect()] == [(7, "b", "c")]
    with pytest.raises(Exception, match="holds a map already"):
        mb.write(n, w, str(tmp_path / "a"))
    mb.write(n.where("false"), w.where("false"), str(tmp_path / "b"))
    assert mb.read_nodes(spark, str(tmp_path / "b")).count() == 0 == mb.read_ways(spark, str(tmp_path / "b")).count()
    (tmp_path / "c.pbf").write_bytes(mb.header(True) + b"\x00\x00\x00\x09nonsense!")
    with pytest.raises(Exception, match="no binary map at byte"):
        mb.read_nodes(spark, str(tmp_path / "c.pbf")).count()
    (tmp_path / "d.pbf").write_bytes(mb.blob(b"OSMHeader", wire.field(4, b"Other")))
    with pytest.raises(Exception, match="needs what is not known"):
        mb.read_nodes(spark, str(tmp_path / "d.pbf")).count()


def test_blocks_are_coded_and_read_as_a_whole(monkeypatch):
    """Numbers of all ways of a block are written and read at once: calls do not grow with the ways, and nothing changes."""
    ids = np.array([5, -7, 1 << 40, 9])
    refs = [np.array([3, -4, 1 << 60]), np.zeros(0, np.int64), np.array([-(1 << 62)]), np.array([8, 8])]
    batch = mb._batch("way", np.tile(ids, 500), None, None, refs * 500, None)
    calls = []
    for name in ("varints", "numbers"):
        plain = getattr(mb, name)
        monkeypatch.setattr(mb, name, lambda n, plain=plain, name=name: calls.append(name) or plain(n))
    data = mb.way_block(batch)
    got = next(mb.elements(mb.content(data[4 + int.from_bytes(data[:4], "big") :])))
    assert got.to_pylist() == batch.to_pylist() and len(calls) < 20
    with pytest.raises(ValueError):
        mb._references([b"\x80", b"\x01"])
