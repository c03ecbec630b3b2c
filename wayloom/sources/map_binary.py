"""The binary map format as a Spark data source: blocks of nodes and ways, written and read a block at a time.

`df.write.format("map_binary").mode("append").save(folder)` writes one file a partition, in the order of its rows, each
a whole file with a header; a manifest written at the end names the files that count, in the order of the partitions, so
what failed or repeated attempts left is never read. `spark.read.format("map_binary").load(path)` reads such a folder, a
folder of files without a manifest, or one file. Files are cut into ranges of bytes; a task reads the blocks whose head
starts in its range and finds the first of them by the head's own form, so nobody lists a file's blocks first.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.wire import field, fields, number_field, numbers, sizes, unzigzag, varints, zigzag

SCHEMA = "kind string, id long, lat_e7 long, lon_e7 long, refs array<long>, tags map<string,string>"

# Fixed values of the format: elements in a block, bytes of a block's head and of a block at most, names and field numbers below.
BLOCK_ELEMENTS = 8000
MOST_HEAD, MOST_BLOCK = 64 << 10, 32 << 20
KNOWN = {b"OsmSchema-V0.6", b"DenseNodes", b"HistoricalInformation"}
_DATA_HEAD = b"\x0a\x07OSMData"

#: References in a block at most, unless one way has more; bytes of a file that one task reads, and that it reads at once.
BLOCK_REFS = 500_000
SPLIT_BYTES, CHUNK = 64 << 20, 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


# --- blocks -----------------------------------------------------------------------------------------------------------


def blob(kind: bytes, content: bytes) -> bytes:
    """A block with its length and head; content is compressed."""
    if len(content) > MOST_BLOCK:
        raise ValueError(f"a block of {len(content)} bytes; the format allows {MOST_BLOCK}")
    body = number_field(2, len(content)) + field(3, zlib.compress(content))
    head = field(1, kind) + number_field(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def header(ordered: bool) -> bytes:
    features = field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes") + (field(5, b"Sort.Type_then_ID") if ordered else b"")
    return blob(b"OSMHeader", features + field(16, b"wayloom"))


def content(body: bytes) -> bytes:
    said = dict(fields(body))
    if 1 in said:
        return said[1]
    if 3 not in said:
        raise ValueError("a block is compressed in a way other than zlib")
    return zlib.decompress(said[3])


class _Words:
    """A block's strings by number; 0 is none."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def __getitem__(self, word: str) -> int:
        return self.number.setdefault(word, len(self.number) + 1)

    def table(self) -> bytes:
        return field(1, b"".join(field(1, w.encode()) for w in ["", *self.number]))


def _steps(n: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Differences from one to the next; at starts the number itself."""
    out = np.diff(n, prepend=0) if len(n) else n
    if starts is not None and len(n):
        out[starts] = n[starts]
    return out


def _tags_of(batch: pa.RecordBatch) -> list | None:
    """The tags of each row as pairs; None where no row has any."""
    tags = batch.column("tags")
    return tags.to_pylist() if pc.any(pc.greater(pc.subtract(tags.offsets[1:], tags.offsets[:-1]), 0)).as_py() else None


def _woven(*pieces: tuple[bytes | np.ndarray, np.ndarray]) -> bytes:
    """Row by row, one piece of each: (the bytes of a piece for all rows, its size by row)."""
    size = np.stack([n for _, n in pieces], 1)
    ends = np.cumsum(size.ravel()).reshape(size.shape)
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, (data, n) in enumerate(pieces):
        own = np.cumsum(n)
        out[np.arange(own[-1]) + np.repeat(ends[:, k] - own, n)] = np.frombuffer(data, np.uint8)
    return out.tobytes()


def node_block(batch: pa.RecordBatch) -> bytes:
    words, column = _Words(), lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    tags = _tags_of(batch) or []
    dense = b"".join(field(k, varints(zigzag(_steps(column(c))))) for k, c in ((1, "id"), (8, "lat_e7"), (9, "lon_e7")))
    if any(tags):
        dense += field(10, varints(np.array([n for t in tags for n in (*(words[w] for kv in t or () for w in kv), 0)], np.uint64)))
    return blob(b"OSMData", words.table() + field(2, field(2, dense)))


def way_block(batch: pa.RecordBatch) -> bytes:
    words = _Words()
    refs = batch.column("refs")
    n = pc.list_value_length(refs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = refs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    coded = zigzag(_steps(flat, starts[n > 0]))
    data, ends = varints(coded), np.concatenate([[0], np.cumsum(sizes(coded))]).astype(np.int64)
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    said = [b"".join(field(2 + k, varints(np.array([words[kv[k]] for kv in t], np.uint64))) for k in (0, 1)) if t else b"" for t in _tags_of(batch) or ()]
    tagged = np.array([len(t) for t in said], np.int64) if said else np.zeros(len(n), np.int64)
    length = ends[starts + n] - ends[starts]
    whole = 2 + sizes(ids) + tagged + sizes(length.astype(np.uint64)) + length
    one, mark = np.ones(len(n), np.int64), lambda k, kind: bytes([k << 3 | kind]) * len(n)
    number = lambda v: (varints(v.astype(np.uint64)), sizes(v.astype(np.uint64)))
    ways = _woven((mark(3, 2), one), number(whole), (mark(1, 0), one), number(ids), (b"".join(said), tagged), (mark(8, 2), one), number(length), (data, length))
    return blob(b"OSMData", words.table() + field(2, ways))


def elements(data: bytes, kind: str | None = None) -> Iterator[pa.RecordBatch]:
    """The nodes and ways of a block's content; other elements go. kind leaves the others unread."""
    strings, groups, scale = [], [], {17: 100, 19: 0, 20: 0}
    for k, v in fields(data):
        if k == 1:
            strings = [w.decode() for _, w in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k in scale:
            scale[k] = v - (1 << 64) if v >> 63 else v
    e7 = lambda n, offset: (scale[offset] + scale[17] * n + 50) // 100
    pairs = lambda keys, vals: [(strings[a], strings[b]) for a, b in zip(numbers(keys).tolist(), numbers(vals).tolist(), strict=True)]
    signed = lambda n: unzigzag(np.array([n], np.uint64))[0]
    for group in groups:
        single, ids, refs, way_tags = [], [], [], []
        for k, v in fields(group):
            if k == 2 and kind != "way":
                said = dict(fields(v))
                nodes, lat, lon = (np.cumsum(unzigzag(numbers(said.get(c, b"")))) for c in (1, 8, 9))
                tags = [[] for _ in nodes] if said.get(10) else None
                at, open_key = 0, None
                for n in numbers(said.get(10, b"")).tolist():
                    if open_key is not None:
                        tags[at].append((strings[open_key], strings[n]))
                        open_key = None
                    elif n:
                        open_key = n
                    else:
                        at += 1
                yield _batch("node", nodes, e7(lat, 19), e7(lon, 20), None, tags)
            elif k == 1 and kind != "way":
                said = dict(fields(v))
                single.append((signed(said[1]), e7(signed(said[8]), 19), e7(signed(said[9]), 20), pairs(said.get(2, b""), said.get(3, b""))))
            elif k == 3 and kind != "node":
                said = dict(fields(v))
                ids.append(said[1] - (1 << 64) if said[1] >> 63 else said[1])
                refs.append(said.get(8, b""))
                way_tags.append(pairs(said[2], said.get(3, b"")) if 2 in said else ())
        if single:
            nodes, lat, lon, tags = zip(*single, strict=True)
            yield _batch("node", np.array(nodes), np.array(lat), np.array(lon), None, list(tags))
        if ids:
            yield _batch("way", np.array(ids, np.int64), None, None, _references(refs), way_tags)


def _references(coded: list[bytes]) -> list[np.ndarray]:
    """The references of each way from its bytes; all are read at once."""
    data = b"".join(coded)
    last = np.frombuffer(data, np.uint8) < 128
    ends = np.cumsum([len(c) for c in coded])
    held = ends[np.diff(ends, prepend=0) > 0]
    if not last[held - 1].all():
        raise ValueError("the last number is cut off")
    starts = np.concatenate([[0], np.concatenate([[0], np.cumsum(last)])[ends]])
    sums = np.cumsum(unzigzag(numbers(data)))  # what the ways before come to goes again, also where it overflows
    before = np.concatenate([np.zeros(1, np.int64), sums])[starts[:-1]]
    return np.split(sums - np.repeat(before, np.diff(starts)), starts[1:-1])


def _batch(kind: str, ids: np.ndarray, lat, lon, refs, tags: list | None) -> pa.RecordBatch:
    n = len(ids)
    place = lambda c: pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64())
    lists = pa.nulls(n, pa.list_(pa.int64())) if refs is None else pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in refs])]).astype(np.int32), np.concatenate(refs))
    none = pa.array([], pa.string())
    said = pa.array([dict(t) for t in tags], pa.map_(pa.string(), pa.string())) if tags and any(tags) else pa.MapArray.from_arrays(np.zeros(n + 1, np.int32), none, none)
    return pa.RecordBatch.from_arrays([pa.repeat(kind, n), pa.array(ids, pa.int64()), place(lat), place(lon), lists, said], [c.split()[0] for c in SCHEMA.split(", ")])


# --- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str | None


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of one kind that follow each other and fit one block."""
    kind = batch.column("kind").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    refs = np.cumsum(pc.list_value_length(batch.column("refs")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), batch.num_rows]
    for start, end in pairwise(edges):
        while start < end:
            room = BLOCK_REFS + (refs[start - 1] if start else 0)
            upto = max(start + 1, min(end, start + BLOCK_ELEMENTS, int(np.searchsorted(refs, room, "right"))))
            yield batch.slice(start, upto - start)
            start = upto


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, ordered: bool):
        self.path, self.overwrite, self.ordered = path, overwrite, ordered

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        name, out = f"{uuid.uuid4().hex}.osm.pbf", None
        try:
            for batch in iterator:
                for run in _runs(batch):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        out.write(header(self.ordered))
                    kind = run.column("kind")[0].as_py()
                    if kind not in ("node", "way"):
                        raise ValueError(f"no such kind of element: {kind}")
                    out.write(node_block(run) if kind == "node" else way_block(run))
        finally:
            if out is not None:
                out.close()
        return _Written(TaskContext.get().partitionId(), None if out is None else name)

    def commit(self, messages: list) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("manifest-")]
        if before and not self.overwrite:
            raise ValueError("the folder holds a map already")
        names = [m.name for m in sorted((m for m in messages if m and m.name), key=lambda m: m.partition)]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}") as s:
            s.write("\n".join(names).encode())
        for old in before:
            fs.delete_file(old)

    def abort(self, messages: list) -> None:
        """What was written is in no manifest."""


# --- reading ----------------------------------------------------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


def _head(data: bytes) -> tuple[bytes, int] | None:
    """(kind, size of the block) of a head; None for bytes that are none."""
    try:
        said = dict(fields(data))
        kind, size = said[1], said[3]
    except (KeyError, IndexError, ValueError):
        return None
    return (kind, size) if set(said) <= {1, 2, 3} and isinstance(kind, bytes) and isinstance(size, int) and size <= MOST_BLOCK + (1 << 20) else None


def first_block(stream, start: int, end: int, size: int) -> int | None:
    """The place of the first data block whose length and head start in [start, end)."""
    at, held = start, b""
    while at < min(end + 4 + len(_DATA_HEAD), size):
        stream.seek(at)
        got = stream.read(CHUNK)
        if not got:
            return None
        data, base = held + got, at - len(held)
        found = data.find(_DATA_HEAD)
        while found >= 0:
            place = base + found - 4
            if start <= place < end:
                stream.seek(place)
                length = int.from_bytes(stream.read(4), "big")
                if length <= MOST_HEAD and (head := _head(stream.read(length))) and head[0] == b"OSMData" and place + 4 + length + head[1] <= size:
                    return place
            found = data.find(_DATA_HEAD, found + 1)
        held = data[-(3 + len(_DATA_HEAD)) :]
        at += len(got)
    return None


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str | None, split: int):
        self.path, self.kind, self.split = path, kind, split

    def partitions(self) -> list:
        fs, root = _store(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            found = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(root))}
            manifests = [f for n, f in found.items() if n.startswith("manifest-")]
            names = sorted(n for n in found if n.endswith(".pbf"))
            if manifests:
                with fs.open_input_stream(manifests[0].path) as s:
                    names = s.read().decode().split()
            files = [found[n] for n in names]
        return [_Range(f.path, s, min(s + self.split, f.size)) for f in files for s in range(0, f.size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _store(self.path)
        with fs.open_input_file(partition.path) as s:
            size = s.size()
            at = 0 if partition.start == 0 else first_block(s, partition.start, partition.end, size)
            while at is not None and at < partition.end:
                s.seek(at)
                length = int.from_bytes(s.read(4), "big")
                head = _head(s.read(length)) if length <= MOST_HEAD else None
                if head is None or at + 4 + length + head[1] > size:
                    raise ValueError(f"{partition.path} is no binary map at byte {at}")
                body = s.read(head[1])
                if head[0] == b"OSMHeader":
                    unknown = {v for k, v in fields(content(body)) if k == 4} - KNOWN
                    if unknown:
                        raise ValueError(f"the map needs what is not known here: {sorted(unknown)}")
                elif head[0] == b"OSMData":
                    yield from elements(content(body), self.kind)
                at += 4 + length + head[1]


class MapBinary(DataSource):
    """Options: path; kind (reading: "node" or "way" leaves the others unread), split_bytes (reading); ordered (writing: rows are by kind and id)."""

    @classmethod
    def name(cls) -> str:
        return "map_binary"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, self.options.get("ordered", "false").lower() == "true")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("kind"), int(self.options.get("split_bytes", SPLIT_BYTES)))


# --- tables -----------------------------------------------------------------------------------------------------------


def write(nodes: DataFrame, ways: DataFrame, path: str, tags: DataFrame | None = None) -> None:
    """nodes (node_id, x_e7, y_e7), ways (way_id, seq, node_id) and tags (way_id, tags map) as a binary map, nodes before ways, each by id.

    The files in the manifest's order are in that order as a whole, so nothing has to sort them again. Nulls: nodes
    without an id or a place go, as do references that are null and tags with a null key or value; a way is there if it
    has a reference; tags of ways that are not there go, and of repeated ways' tags one counts. Of nodes with one id, all
    are written. A way is one row in one block; one whose references take more than 32 MB is an error.
    """
    spark = nodes.sparkSession
    spark.dataSource.register(MapBinary)
    none = F.create_map().cast("map<string,string>")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda p: p["node_id"])
    lines = ways.where("way_id IS NOT NULL AND node_id IS NOT NULL").groupBy(F.col("way_id").cast("long").alias("id")).agg(refs.cast("array<long>").alias("refs"))
    if tags is not None:
        clean = F.map_filter("tags", lambda k, v: v.isNotNull())
        own = tags.where("way_id IS NOT NULL").groupBy(F.col("way_id").cast("long").alias("id")).agg(F.any_value(clean, True).alias("tags"))
        lines = lines.join(own, "id", "left")
    else:
        lines = lines.withColumn("tags", none)
    n = nodes.where("node_id IS NOT NULL AND x_e7 IS NOT NULL AND y_e7 IS NOT NULL")
    null = lambda t: F.lit(None).cast(t)
    rows = n.select(F.lit("node").alias("kind"), F.col("node_id").cast("long").alias("id"), F.col("y_e7").cast("long").alias("lat_e7"), F.col("x_e7").cast("long").alias("lon_e7"), null("array<long>").alias("refs"), none.alias("tags"))
    rows = rows.union(lines.select(F.lit("way"), "id", null("long"), null("long"), "refs", F.coalesce("tags", none)))
    rows.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.format("map_binary").option("ordered", "true").mode("append").save(path)


def _read(spark: SparkSession, path: str, kind: str, split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MapBinary)
    return spark.read.format("map_binary").option("kind", kind).option("split_bytes", split).load(path)


def read_nodes(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(node_id, x_e7, y_e7)."""
    return _read(spark, path, "node", split).select(F.col("id").alias("node_id"), F.col("lon_e7").alias("x_e7"), F.col("lat_e7").alias("y_e7"))


def read_ways(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(way_id, seq, node_id), seq from 1."""
    return _read(spark, path, "way", split).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id")).select("way_id", (F.col("seq") + 1).cast("long").alias("seq"), "node_id")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, key, value)."""
    return _read(spark, path, "way").select(F.col("id").alias("way_id"), F.explode("tags").alias("key", "value"))
