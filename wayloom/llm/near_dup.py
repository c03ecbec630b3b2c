"""Near-duplicate documents: minhash signatures, a multi-index Hamming join, links confirmed on the full shingle sets.

A signature has SYMBOLS values of b bits. It is split into CHUNKS chunks; if two signatures differ in at most
2 * CHUNKS - 1 symbols, some chunk differs in at most one (pigeonhole), so it agrees once that symbol is left out.
Every chunk is therefore indexed once for each symbol left out, which finds all pairs within that distance. Two sets
of similarity 0.85 are within it but for a chance of about 1e-5.

A bucket's pairs are not listed. The bucket's best-connected member is compared with the others, what it links
becomes one component, and the next member of another component follows. Members of buckets that then still span
components (many texts that are like each other but not enough) meet once more, now only where they share one of their
rarest shingles: of two sets of similarity t, the |x| - ceil(t |x|) + 1 shingles of each that are least frequent have
one in common, so no link is lost and texts that differ in every rare shingle are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..operators.components import connected_components
from ..plans.staging import staged, table
from .shingles import mix, shingle_set

SYMBOLS, BITS, CHUNKS = 64, 16, 12
#: Signatures that differ in more symbols need not be found.
DISTANCE = 2 * CHUNKS - 1
#: Buckets with so few members left list their pairs at once.
SMALL_BUCKET = 8
#: Rounds of one member against the rest, in the buckets of the signatures and then of the rare shingles.
STAR_ROUNDS, RARE_ROUNDS = 2, 1
#: Buckets that still span components then are compared in blocks of so many members.
BLOCK = 256
#: Texts of a batch that are Python strings at once.
SLICE = 500
#: Bits of a set's map: two sets differ in at least as many elements as their maps in bits.
MAP_BITS = 2048

_A = np.random.default_rng(20).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.random.default_rng(21).integers(1, 2**63, SYMBOLS, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The low BITS of each permutation's least value, mixed."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        for i in range(SYMBOLS):
            least[i] = min(least[i], (part * _A[i] + _C[i]).min())
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def bit_map(s: np.ndarray) -> bytes:
    bits = np.zeros(MAP_BITS, dtype=np.uint8)
    bits[(s & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _maps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), MAP_BITS // 64)


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) keys: for each symbol, its chunk's other symbols and its place."""
    bounds = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]
    keys = np.empty(sigs.shape, dtype=np.uint64)
    wide = sigs.astype(np.uint64)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for out in range(lo, hi):
            k = np.full(len(sigs), out + 1, dtype=np.uint64)
            for i in range(lo, hi):
                if i != out:
                    k = k * np.uint64(0x9E3779B97F4A7C15) + wide[:, i] + np.uint64(1)
            keys[:, out] = mix(k)
    return keys


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, other, sig, bits): node and other are two hashes of the whole set, null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, size)
                node, other = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist() if len(s) else (None, None)
                out.append((len(s), node, other, signature(s).tobytes() if len(s) else None, bit_map(s) if len(s) else None))
            cols = zip(*out, strict=True) if out else ((), (), (), (), ())
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            # Ids stay Arrow values: through pandas a null among them would turn large ones into other numbers.
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "n_shingles", "node", "other", "sig", "bits"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node long, other long, sig binary, bits binary")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar. A pair brings both texts; runs of the same a keep its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ok = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a != last:
                    last, kept = a, shingle_set(ta, size)
                ok.append(similar(kept, shingle_set(tb, size), percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs that sizes and maps allow."""

    @F.pandas_udf(T.IntegerType())
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        return pd.Series(np.bitwise_count(_maps(x) ^ _maps(y)).sum(axis=1).astype("int32"))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    sized = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # Similar sets differ in (100 - percent) / (100 + percent) of their sizes' sum at most.
    return sized.where((100 + percent) * differ("bits_a", "bits_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _listed(members: DataFrame) -> DataFrame:
    """Pairs of different components in the buckets with few members."""
    by = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "comp"))).alias("m"))
    a = by.select("m", F.posexplode("m").alias("i", "x"))
    b = a.select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    return b.where("x.comp <> y.comp").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _blocked(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that sizes and maps allow, in large buckets: every block of members against every
    block, each pair of blocks in a group of its own; other pairs never leave it."""
    blocks = members.groupBy("key").agg(F.count("*").alias("n")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    dealt = members.join(blocks, "key").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).join(nodes.select("node", "bits", "n_shingles"), "node")
    wide = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    wide = wide.select("key", "node", "comp", "bits", "n_shingles", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        x, y = pdf[pdf["blk"] == lo], pdf[pdf["blk"] == hi]
        out = []
        if len(x) and len(y):
            bx, by, ny, cy, ids = _maps(x["bits"]), _maps(y["bits"]), y["n_shingles"].to_numpy(), y["comp"].to_numpy(), y["node"].to_numpy()
            for i, (node, comp, n) in enumerate(zip(x["node"], x["comp"], x["n_shingles"], strict=True)):
                hit = (cy != comp) & ((lo != hi) | (np.arange(len(y)) > i)) & (100 * np.minimum(ny, n) >= percent * np.maximum(ny, n))
                at = np.flatnonzero(hit)
                near = (100 + percent) * np.bitwise_count(by[at] ^ bx[i]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (ny[at] + n)
                out += [(node, m) for m in ids[at[near]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return wide.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def _weighed(index: DataFrame) -> DataFrame:
    """key, node, w, comp of the keys that several nodes share; w: how many rows a node's keys have in all; comp: itself."""
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(index.join(shared, "key"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    return staged(members.join(weight, "node").select("key", "node", "w", F.col("node").alias("comp")), "weighed")


def _rare(open_: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(key, node): each open node's rarest shingles, so many that two linked nodes have one in common."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                s = shingle_set(text, size)
                yield pd.DataFrame({"node": node, "n": len(s), "key": s.view(np.int64)})

    each = staged(open_.join(texts, "node").select("node", "text").mapInPandas(cut, "node long, n long, key long"), "shingles")
    counted = each.join(each.groupBy("key").agg(F.count("*").alias("c")), "key")
    rank = F.row_number().over(W.partitionBy("node").orderBy("c", "key"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("c > 1").select("key", "node")


def components(nodes: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, comp) of the nodes that are linked with another. nodes: node, n_shingles, sig, bits; texts: node, text."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                k = chunk_keys(np.frombuffer(b"".join(part["sig"]), dtype=np.uint16).reshape(len(part), SYMBOLS))
                yield pd.DataFrame({"key": k.view(np.int64).ravel(), "node": np.repeat(part["node"].to_numpy(), SYMBOLS)})

    index = nodes.select("node", "sig").mapInPandas(keys, "key long, node long")
    members = _weighed(index)
    edges = nodes.sparkSession.createDataFrame([], "a long, b long")
    comps = None
    for turn in range(STAR_ROUNDS + RARE_ROUNDS + 1):
        if members.isEmpty():
            break
        if turn == STAR_ROUNDS:
            members = _weighed(_rare(members.select("node").distinct(), texts, percent, size))
            comp = comps.select("node", F.col("component").alias("_comp"))
            members = members.join(comp, "node", "left").withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp")
        stats = members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("w", "node", "comp")).alias("best"))
        with_best = members.join(stats, "key")
        few = _listed(with_best.where(F.col("n") <= SMALL_BUCKET).select("key", "node", "comp"))
        large = with_best.where(F.col("n") > SMALL_BUCKET)
        if turn < STAR_ROUNDS + RARE_ROUNDS:
            many = large.where("comp <> best.comp").select(F.col("best.node").alias("a"), F.col("node").alias("b"))
            members = large.where("node <> best.node").select("key", "node", "w")
        else:
            many = _blocked(large.select("key", "node", "comp"), nodes, percent)
            members = large.limit(0).select("key", "node", "w")
        pairs = few.union(many).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = staged(_close(pairs, nodes, percent), "pairs")
        edges = staged(edges.union(_verify(pairs, texts, percent, size)), "links")
        comps = staged(connected_components(edges), "comps")
        comp = comps.select("node", F.col("component").alias("comp"))
        members = members.join(comp, "node", "left").select("key", "node", "w", F.coalesce("comp", "node").alias("comp"))
        open_ = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        members = staged(members.join(open_, "key", "left_semi"), "open")
    return comps.select("node", F.col("component").alias("comp")) if comps is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _nodes(rows: DataFrame) -> DataFrame:
    """node, n_shingles, sig, bits, at_id, at_hash (the row that stands for it), one_set: one row for each node of signatures()."""
    by_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    one = (F.min("other") == F.max("other")).alias("one_set")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(by_id).alias("at"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"), F.min("bits").alias("bits"), one)
    return staged(nodes.select("node", "n_shingles", "sig", "bits", F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash"), "one_set"), "nodes")


def judged(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """What near_duplicates() returns, with text_hash and comp: equal for linked rows, null for those that link with nothing for want of words."""
    rows = staged(signatures(docs, size), "signatures")
    nodes = _nodes(rows)
    if not nodes.where("NOT one_set").isEmpty():  # sets that differ and have the same first hash
        rows = rows.withColumn("node", F.when(F.col("node").isNotNull(), F.xxhash64("node", "other")))
        nodes = _nodes(rows)
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = nodes.select("node", "at_id", "at_hash").join(source, F.col("at_id").eqNullSafe(F.col("doc_id")) & (F.col("at_hash") == F.col("text_hash"))).select("node", "text").dropDuplicates(["node"])
    comps = components(nodes.select("node", "n_shingles", "sig", "bits"), texts, percent, size)
    linked = nodes.select("node", "at_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = linked.groupBy("comp").agg(F.min("at_id").alias("component_id"))
    named = linked.join(first, "comp").select("node", "component_id", "comp")
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash", "comp")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents (doc_id, text).

    Null texts and texts without words have an empty set, link with nothing and are kept. Equal sets (by 128 bits of
    hash) are one node from the start, so repeated rows and groups of copies cost one signature. Of a component the row(s) with the
    smallest doc_id are kept. A null doc_id is no smallest id: such a row is kept only if its component has no id at
    all. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    return judged(docs, percent, size).drop("text_hash", "comp")


def op6_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
