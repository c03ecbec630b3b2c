"""WARC archives as a Spark data source, and their index: locally sorted runs merged into globally ordered capture histories.

`df.write.format("warc").save(path)` writes one gzip member per record, in the order of each partition's rows, into files
of bounded size; a manifest written at the end names the files that count, so what failed or repeated attempts left is
never read. `spark.read.format("warc").load(path)` reads them back, a file a task. As each partition is sorted before it
is written, each file is a run sorted by URL key and time. merged() deals the runs' entries out by ranges of that
order; a task then merges what it has of each run through a tree of losers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..plans.staging import shared_dir, staged, table

#: A file is closed at the record that takes it past so many bytes.
FILE_BYTES = 256 << 20
#: Index entries that a merging task holds, on average.
MERGE_ROWS = 200_000
#: Payloads with at least one of so many records each are at most so many: they may be broadcast.
HOT_SHARE = 1000
CHUNK = 1 << 16
#: Bytes of payloads that a reader holds before it hands them on.
BATCH_BYTES = 16 << 20

WRITTEN = "record_id string, record_type string, url string, time timestamp, digest string, payload_bytes long, refers_to string, payload binary"
READ = f"file string, place long, start long, length long, {WRITTEN}"

# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _plain(text: str) -> str:
    """A header's value in one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(record_id: str, record_type: str, url: str | None, date: str, digest: str, payload_bytes: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record; a revisit has the head of its response only, which tells the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:capture:{_plain(record_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:capture:{_plain(refers_to or '')}>"]
    else:
        block += payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block + _END


def parsed(data: bytes) -> dict:
    """What record() wrote; the digest and length of a response are those of the payload that is there."""
    head, _, rest = data.partition(_END)
    said = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(said["Content-Length"])].partition(_END)
    name = lambda k: said[k].removeprefix("<urn:capture:").removesuffix(">") if k in said else None
    whole = said["WARC-Type"] == "response"
    return {
        "record_id": name("WARC-Record-ID"),
        "record_type": said["WARC-Type"],
        "url": said.get("WARC-Target-URI"),
        "time": said["WARC-Date"],
        "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else said["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": len(payload) if whole else int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "refers_to": name("WARC-Refers-To"),
        "payload": payload,
    }


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, content) of each gzip member of a file."""
    start = at = 0
    data, parts, gz = b"", [], zlib.decompressobj(31)
    while data or (data := stream.read(CHUNK)):
        parts.append(gz.decompress(data))
        at += len(data) - len(gz.unused_data)
        data = gz.unused_data
        if gz.eof:
            yield start, at - start, b"".join(parts)
            start, parts, gz = at, [], zlib.decompressobj(31)
    if parts:
        raise ValueError("the file ends inside a record")


@dataclass
class _Files(WriterCommitMessage):
    names: list


@dataclass
class _File(InputPartition):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, most: int):
        self.path, self.overwrite, self.most = path, overwrite, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                dates = batch.column("time").cast(pa.timestamp("us", "UTC")).to_pylist()
                cols = {c: batch.column(c) for c in batch.schema.names}
                for i, date in enumerate(dates):
                    r = {c: v[i].as_py() for c, v in cols.items() if c != "time"}
                    payload = r["payload"] or b""
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    data = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(r["record_id"], r["record_type"], r["url"], f"{date:%Y-%m-%dT%H:%M:%SZ}" if date else "1970-01-01T00:00:00Z", digest, r["payload_bytes"], r["refers_to"], payload)
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    done = data.compress(raw) + data.flush()
                    out.write(done)
                    size += len(done)
                    if size >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Files(names)

    def commit(self, messages: list) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("manifest-")] if self.overwrite else []
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}") as out:
            out.write("\n".join(n for m in messages if m for n in m.names).encode())
        for old in before:
            fs.delete_file(old)

    def abort(self, messages: list) -> None:
        """What was written is in no manifest."""


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload

    def partitions(self) -> list:
        fs, root = _store(self.path)
        names: list[str] = []
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith("manifest-"):
                with fs.open_input_stream(f.path) as s:
                    names += s.read().decode().split()
        return [_File(n) for n in sorted(names)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _store(self.path)
        rows, size, place = [], 0, 0
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None) as s:
            for start, length, data in members(s):
                r = parsed(data)
                size += len(data) if self.payload else 300
                rows.append((partition.name, place, start, length, *(r[c] for c in ("record_id", "record_type", "url", "time", "digest", "payload_bytes", "refers_to")), r["payload"] if self.payload and r["record_type"] == "response" else None))
                place += 1
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), None, pa.string(), pa.int64(), pa.string(), pa.binary()]
    cols = [pa.array(c, k) if k else pa.array([x.rstrip("Z") for x in c]).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in READ.split(", ")])


class WarcSource(DataSource):
    """Options: path; payload (reading: "false" leaves payloads null); file_bytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, int(self.options.get("file_bytes", FILE_BYTES)))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")


def url_key(url: Column) -> Column:
    """The key that sorts a site's captures together: host from the right, then path and query. Null: empty; what has no scheme and host: the text."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(url, f"{scheme}([^/?#]*)", 1))
    for part in ("^.*@", ":[0-9]*$", "^www[0-9]*[.]"):
        host = F.regexp_replace(host, part, "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.regexp_extract(url, f"{scheme}[^/?#]*([^#]*)", 1))
    return F.coalesce(F.when(host == "", url).otherwise(key), F.lit(""))


def planned(captures: DataFrame, least: int = 0) -> DataFrame:
    """captures (id, url, time, payload binary) as rows to write, sorted within partitions by URL key, second and id as text.

    Of equal payloads of at least `least` bytes (a null payload is empty) those of the largest id are responses and the
    others revisit it; a null id is less than any, and where all are null all are responses. Payloads are not shuffled
    unless the table of repeated ones is too large to send: that of hot ones never is.
    """
    full = captures.select("id", "url", "time", F.coalesce("payload", F.lit(b"")).alias("payload"))
    full = full.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = full.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    repeated = staged(repeated.where("n > 1 AND last IS NOT NULL"), "repeated")
    if not repeated.isEmpty():
        hot = F.col("n") >= captures.count() / HOT_SHARE
        key = lambda df, s: df.select(F.concat_ws("-", "digest", "payload_bytes").alias(f"{s}_key"), F.col("last").alias(f"{s}_last"))
        own = F.concat_ws("-", "digest", "payload_bytes")
        full = full.join(F.broadcast(key(repeated.where(hot), "hot")), own == F.col("hot_key"), "left")  # at most HOT_SHARE rows
        # Hot rows get a key of their own each, so that they do not meet in one task of the other join.
        apart = F.when(F.col("hot_key").isNull(), own).otherwise(F.concat(F.lit("#"), F.xxhash64("id", "url").cast("string")))
        full = full.join(key(repeated.where(~hot), "cold"), apart == F.col("cold_key"), "left")
        full = full.withColumn("last", F.coalesce("hot_last", "cold_last"))
    else:
        full = full.withColumn("last", F.lit(None).cast(captures.schema["id"].dataType))
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    second = F.date_trunc("second", F.coalesce("time", F.timestamp_seconds(F.lit(0))))  # what a record says of its time
    rows = full.sortWithinPartitions(url_key(F.col("url")), second, text("id"))
    return rows.select(text("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "url", F.col("time").cast("timestamp").alias("time"), "digest", "payload_bytes", F.when(revisit, text("last")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def write(captures: DataFrame, path: str, least: int = 0, **options) -> None:
    captures.sparkSession.dataSource.register(WarcSource)
    planned(captures, least).write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


class LoserTree:
    """Merges k sorted runs with about log2(k) comparisons an item: each inner place keeps the loser of its match."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [self._next(i) for i in range(len(runs))]
        k = len(runs)
        self.losers = [-1] * k
        winners = [0] * k + list(range(k))  # of the matches at 1..k-1, then the leaves
        for place in range(k - 1, 0, -1):
            a, b = winners[2 * place], winners[2 * place + 1]
            a, b = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
            winners[place], self.losers[place] = a, b
        self.winner = winners[1] if k > 1 else 0

    def _next(self, run: int) -> tuple:
        item = next(self.runs[run], None)
        return (1,) if item is None else (0, item, run)

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        k = len(self.runs)
        while self.heads[self.winner] != (1,):
            run = self.winner
            yield self.heads[run][1]
            self.heads[run] = self._next(run)
            place = (run + k) // 2
            while place:
                if self.heads[self.losers[place]] < self.heads[run]:
                    run, self.losers[place] = self.losers[place], run
                place //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's entries of all runs, merged; part and row tell the order."""
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    rows = rows.take(pc.sort_indices(rows, [("file", "ascending"), ("place", "ascending")])).combine_chunks()
    files = rows.column("file").combine_chunks()
    keys = list(zip(*(rows.column(c).to_pylist() for c in ("url_key", "at", "record_id")), range(len(rows)), strict=True))
    ends = [i for i in range(1, len(rows)) if files[i] != files[i - 1]]
    runs = [iter(keys[a:b]) for a, b in zip([0, *ends], [*ends, len(rows)], strict=True)]
    order = pa.array([k[-1] for k in LoserTree(runs)], pa.int64())
    out = rows.take(order)
    part = TaskContext.get().partitionId()
    out = out.append_column("part", pa.array([part] * len(out), pa.int32())).append_column("row", pa.array(range(len(out)), pa.int64()))
    yield from out.to_batches(max_chunksize=10_000)


def merged(runs: DataFrame) -> DataFrame:
    """All entries of runs (as read() gives them) with url_key and capture_order, 0-based by URL key, time and record id.

    Runs may be as many and as long as they like: ranges of the order are cut so that a task holds about MERGE_ROWS
    entries, and captures of one URL can lie in many ranges.
    """
    entries = staged(runs.drop("payload").withColumn("url_key", url_key(F.col("url"))).withColumn("at", F.unix_micros("time")), "runs")
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // MERGE_ROWS))
    dealt = entries.repartitionByRange(n, "url_key", "at", "record_id", "file", "place")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    whole = staged(dealt.mapInArrow(_merge, f"{kinds}, part int, row long"), "merged")
    sizes = whole.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return whole.join(before, "part").withColumn("capture_order", F.col("before") + F.col("row")).drop("part", "row", "before", "at")


def fetched(entries: DataFrame, path: str) -> DataFrame:
    """entries with the payload at their file, start and length, read there alone. A revisit has none of its own."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path)
        for batch in batches:
            out = []
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    r = parsed(zlib.decompress(f.read_at(length, start), 31))
                out.append(r["payload"] if r["record_type"] == "response" else None)
            yield batch.append_column("payload", pa.array(out, pa.binary()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(look, f"{kinds}, payload binary")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as captures. They have no time: they count as taken a second apart by id from 2020 on, anew after 10**9 seconds; a null id has none."""
    when = F.timestamp_seconds(F.pmod(F.col("page_id"), F.lit(1_000_000_000)) + 1_577_836_800)
    return pages.select(F.col("page_id").alias("id"), "url", when.alias("time"), F.col("html").cast("binary").alias("payload"))


def op11_capture_histories(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/wayloom/{uuid.uuid4().hex}-warc"
    write(page_captures(pages), path)
    kind = pages.schema["page_id"].dataType
    index = merged(read(spark, path, payload=False))
    number: Callable = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return index.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "url_key", "capture_order")


_DIGITS = " || ".join(f"translate(to_base(CAST('0x' || h[{10 * i + 1}:{10 * i + 10}] AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(4))
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
OP11_SQL = rf"""WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '{_SCHEME}([^/?#]*)', 1)) AS host, sha1(coalesce(html, '')) AS h FROM pages),
 q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*[.]', '') AS site FROM p),
 k AS (SELECT *, coalesce(CASE WHEN site = '' THEN url ELSE array_to_string(list_reverse(string_split(site, '.')), ',') || ')' || regexp_extract(url, '{_SCHEME}[^/?#]*([^#]*)', 1) END, '') AS url_key, max(page_id) OVER (PARTITION BY h) AS last FROM q)
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, CASE WHEN page_id IS NOT NULL THEN ((page_id % 1000000000) + 1000000000) % 1000000000 ELSE -1577836800 END, CAST(page_id AS VARCHAR)) - 1 AS capture_order FROM k"""
