"""Token ids as binary shards, reached through a minimal perfect hash of the document keys.

Files: shards (nothing but raw little-endian ids, one document after the other), `blocks` (one row per stretch of a
shard: its file and first byte, the keys and lengths of the documents in it) and `index` (one row per bucket of keys:
the levels of its minimal perfect hash, and by hash value the key's fingerprint and its place: shard, block, first row,
rows). A lookup hashes the key to its bucket, walks the levels to a slot, compares the fingerprint and reads one place:
constant work for each key. A key with so many rows that they fill more than a block goes on in the blocks after it;
`more` has one row for each of those.

A task writes its shard's file itself, under a name of its own for each attempt, and gives the blocks as rows; the table
of blocks is written by Spark and holds those of finished attempts only, so a file that a lost task left is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import shared_dir, staged, table
from .tokens import encoded, encoder, tokenizer_spec
from .warc import _store

#: Bytes of ids in a block, and keys in a bucket of the index: both bound what a task holds.
BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 100_000
#: Lookups that ask for so many buckets or blocks at most read no others.
FEW_PLACES = 200
#: Texts of a batch that are Python strings at once.
SLICE = 500
#: Characters of a text that order rows of one doc_id: what Spark samples to cut ranges must not hold whole texts.
TIE_CHARS = 64
#: Bits per key in the first level.
GAMMA = 2.0


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser, a new function for each seed."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Distinct 64-bit hashes to 0..n-1. Each level keeps the keys that are alone in their bit; the rest go to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.cumsum(bits) - bits
            self.ranks.append(ones + base)
            base += int(bits.sum())
        self.size = base

    @staticmethod
    def _at(keys: np.ndarray, other: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(keys ^ _mix(other, level + (1 << 16)), level) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, other: np.ndarray | None = None) -> MinimalPerfectHash:
        """other: a second hash of each key, which tells keys of the same first hash apart."""
        other = np.zeros_like(keys) if other is None else other
        levels = []
        while len(keys):
            size = max(64, int(GAMMA * len(keys)))
            at = cls._at(keys, other, len(levels), size)
            hits = np.bincount(at, minlength=size)
            levels.append((hits == 1).astype(np.int64))
            again = hits[at] > 1
            keys, other = keys[again], other[again]
            if len(levels) > 200:
                raise ValueError("two keys have the same two 64-bit hashes")
        return cls(levels)

    def __call__(self, keys: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key, -1 where no level has it (a key that was not built in can also get some slot)."""
        other = np.zeros_like(keys) if other is None else other
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = self._at(keys[open_], other[open_], i, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.ranks[i][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<i8").tobytes()
        return head + b"".join(np.packbits(b.astype(np.uint8)).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        at, levels = 8 * (n + 1), []
        for size in sizes.tolist():
            take = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, take, at), count=size).astype(np.int64))
            at += take
        return cls(levels)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _hashed(df: DataFrame) -> DataFrame:
    """df with h and g, two hashes of its column key."""
    return df.withColumn("h", F.xxhash64("key", F.col("key").isNull())).withColumn("g", F.xxhash64(F.lit("g"), "key", F.col("key").isNull()))


def _unsigned(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def _only(df: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """df, read only where asked has its `by` if those are few: the scan then skips all other files and row groups."""
    wanted = asked.select(by).distinct().limit(FEW_PLACES + 1).collect()
    if len(wanted) > FEW_PLACES:
        return df
    return df.where(reduce(lambda c, x: c | x, (reduce(lambda c, x: c & x, (F.col(k) == r[k] for k in by)) for r in wanted), F.lit(False)))


@dataclass
class IdStore:
    blocks: DataFrame  # shard, block, n_ids, file, offset, keys, lens
    index: DataFrame  # bucket, mph, places
    more: DataFrame  # shard, block, row of a key's place, and at_shard, at_block, at_row, at_rows where it goes on
    buckets: int
    width: int  # bytes of an id in a payload
    key_type: str

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> IdStore:
        """Encodes documents (doc_id, text), in ascending doc_id order (null first, ties by the first TIE_CHARS characters of the text), into shards and indexes every key.

        Null texts are empty. Rows with the same doc_id follow each other and are one key; however many they are, they
        are dealt out over tasks and blocks. An empty table gives an empty store. Other columns are not read.
        """
        spec = tokenizer_spec(tokenizer_file)
        width = 2 if max(encoder(spec).size, end_id + 1) <= 1 << 16 else 4
        key_type = docs.schema["doc_id"].dataType.simpleString()
        dtype = f"<u{width}"

        root = f"{shared_dir(docs.sparkSession)}/wayloom/{uuid.uuid4().hex}-shards"

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard, block, size, offset = TaskContext.get().partitionId(), 0, 0, 0
            keys: list[pa.Array] = []
            lens: list[int] = []
            out, name = None, f"{root}/{uuid.uuid4().hex}.ids"

            def full() -> pa.RecordBatch:
                own = pa.ListArray.from_arrays(pa.array([0, sum(map(len, keys))], pa.int32()), pa.concat_arrays(keys))
                cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([sum(lens)], pa.int64()), pa.array([name]), pa.array([offset], pa.int64()), own, pa.array([lens], pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(cols, ["shard", "block", "n_ids", "file", "offset", "keys", "lens"])

            try:
                for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
                    if out is None:
                        fs, path = _store(name)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    ids, first = batch.column("doc_id"), 0
                    # Keys stay Arrow values: through pandas a null among them would turn large ones into other numbers.
                    for row, payload in enumerate(encoded(spec, batch.column("text").to_pylist(), end_id)):
                        if size >= BLOCK_BYTES:
                            keys.append(ids.slice(first, row - first))
                            yield full()
                            block, offset, keys, lens, size, first = block + 1, offset + size, [], [], 0, row
                        raw = payload if width == 4 else np.frombuffer(payload, "<u4").astype(dtype).tobytes()
                        out.write(raw)
                        lens.append(len(raw) // width)
                        size += len(raw)
                    keys.append(ids.slice(first))
            finally:
                if out is not None:
                    out.close()  # before the last block is told of
            if lens:
                yield full()

        # The start of the text and the row's place in the table deal the rows of one doc_id out, also those of one text.
        dealt = docs.select("doc_id", "text", F.substring("text", 1, TIE_CHARS).alias("tie"), F.monotonically_increasing_id().alias("at"))
        ordered = dealt.repartitionByRange("doc_id", "tie", "at").sortWithinPartitions("doc_id", "tie", "at").select("doc_id", "text")
        blocks = staged(ordered.mapInArrow(shards, f"shard int, block int, n_ids long, file string, offset long, keys array<{key_type}>, lens array<long>"), "ids")
        rows = blocks.select("shard", "block", F.size("keys").alias("n"), F.posexplode("keys").alias("row", "key"))
        runs = rows.groupBy("shard", "block", "key").agg(F.min("row").alias("row"), F.count("*").alias("rows"), F.max("n").alias("n"))
        # Only the first and the last key of a block can go on in another: at most two rows a block meet by key.
        ends = runs.where("row = 0 OR row + rows = n").groupBy("key").agg(F.min(F.struct("shard", "block", "row")).alias("p"), F.collect_list(F.struct("shard", "block", "row", "rows")).alias("each")).where("size(each) > 1")
        told = ends.select("p", F.explode("each").alias("e")).where("p.shard <> e.shard OR p.block <> e.block")
        more = staged(told.select("p.*", *(F.col(f"e.{c}").alias(f"at_{c}") for c in ("shard", "block", "row", "rows"))), "more")
        later = more.select(*(F.col(f"at_{c}").alias(c) for c in ("shard", "block", "row")))
        entries = _hashed(runs.join(later, ["shard", "block", "row"], "left_anti"))
        buckets = max(1, -(-docs.count() // BUCKET_KEYS))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            h, g = _unsigned(pdf["h"]), _unsigned(pdf["g"])
            mph = MinimalPerfectHash.build(h, g)
            slot = mph(h, g)
            places = np.zeros((len(h), 5), dtype="<i8")
            places[slot] = np.column_stack([fingerprint(g).astype(np.int64), *(pdf[c].to_numpy().astype(np.int64) for c in ("shard", "block", "row", "rows"))])
            return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "mph": [mph.to_bytes()], "places": [places.tobytes()]})

        entries = entries.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
        index = staged(entries.select("bucket", "h", "g", "shard", "block", "row", "rows").groupBy("bucket").applyInPandas(build, "bucket long, mph binary, places binary"), "mph")
        return cls(blocks, index, more, buckets, width, key_type)

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, shard, block, row, rows) of each distinct key of keys(key) that the index has, through hash and fingerprint.

        An absent key passes the fingerprint with a chance of 2**-32; read() compares the key itself.
        """
        asked = _hashed(keys.select("key").distinct()).withColumn("bucket", F.pmod(F.col("h"), F.lit(self.buckets)))

        def look(asked: pa.Table, index: pa.Table) -> pa.Table:
            names = ["key", "shard", "block", "row", "rows"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            if not asked.num_rows or not index.num_rows:
                return pa.Table.from_arrays([asked.column("key").slice(0, 0), *(pa.array([], t) for t in types)], names)
            h, g = _unsigned(asked.column("h")), _unsigned(asked.column("g"))
            places = np.frombuffer(index.column("places")[0].as_py(), "<i8").reshape(-1, 5)
            slot = MinimalPerfectHash.from_bytes(index.column("mph")[0].as_py())(h, g)
            ok = (slot >= 0) & (places[slot, 0] == fingerprint(g).astype(np.int64))
            found = places[slot[ok]]
            return pa.Table.from_arrays([asked.column("key").filter(pa.array(ok)), *(pa.array(found[:, i + 1]).cast(t) for i, t in enumerate(types))], names)

        index = _only(self.index, asked, ["bucket"])
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, f"key {self.key_type}, shard int, block int, row long, rows long")

    def read(self, keys: DataFrame) -> DataFrame:
        """For each key of keys(key): doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the blocks."""
        shards = self.blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
        shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_base"))
        sizes = self.blocks.select("shard", "block", "n_ids")
        bases = sizes.select("shard", "block", (F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("base")).join(shards, "shard")
        first = staged(self.locate(keys), "first")
        later = first.join(self.more, ["shard", "block", "row"]).select("key", *(F.col(f"at_{c}").alias(c) for c in ("shard", "block", "row", "rows")))
        located = staged(first.union(later), "located")
        asked = located.join(bases.select("shard", "block", (F.col("base") + F.col("shard_base")).alias("base")), ["shard", "block"])
        width, kind = self.width, self.key_type

        def slices(asked: pa.Table, block: pa.Table) -> pa.Table:
            at, out = [], []
            if asked.num_rows and block.num_rows:
                lens = np.asarray(block.column("lens")[0].values, dtype=np.int64)
                own, key = block.column("keys")[0].values, asked.column("key")
                ends = np.cumsum(lens)
                # Another key may have this fingerprint.
                wanted = [(i, row, rows, base) for i, (row, rows, base) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("row", "rows", "base")), strict=True)) if own[row].as_py() == key[i].as_py()]
                if wanted:
                    low = min(int(ends[row] - lens[row]) for _, row, _, _ in wanted)
                    high = max(int(ends[row + rows - 1]) for _, row, rows, _ in wanted)
                    fs, path = _store(block.column("file")[0].as_py())
                    with fs.open_input_file(path) as f:
                        f.seek(block.column("offset")[0].as_py() + width * low)
                        payload = np.frombuffer(f.read(width * (high - low)), f"<u{width}")
                for i, row, rows, base in wanted:
                    for r in range(row, row + rows):
                        ids = payload[int(ends[r] - lens[r]) - low : int(ends[r]) - low].astype("<u4")
                        at.append(i)
                        out.append((int(base + ends[r] - lens[r]), int(lens[r]), zlib.crc32(ids.tobytes())))
            cols = np.array(out, dtype=np.int64).reshape(-1, 3).T
            return pa.Table.from_arrays([asked.column("key").take(pa.array(at, pa.int64())), *map(pa.array, cols)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        blocks = _only(self.blocks, located, ["shard", "block"]).select("shard", "block", "file", "offset", "keys", "lens")
        grouped = asked.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block"))
        return grouped.applyInArrow(slices, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op8_perfect_hash_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    store = IdStore.write(docs, public_tokenizers.path("word_bpe_49k.json"))
    return store.read(docs.select(F.col("doc_id").alias("key")))
