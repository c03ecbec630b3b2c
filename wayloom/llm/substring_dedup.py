"""Repeated passages across documents, by compaction of a De Bruijn graph of word k-mers.

The graph's edges are the k-mers, k being the length of a window; its nodes are the runs of k - 1 words between them. A
document is a walk. The steps, each over all documents:

1. Walks are cut into pieces: consecutive k-mers around one anchor, their least hashed sub-mer. An anchor stands at
   another offset in each of its k-mers, so no path branches inside a piece that is equal wherever its anchor stands,
   and the piece is one edge in the joins instead of one for each k-mer. Pieces are counted.
2. An anchor with different pieces is where paths branch or a repeat ends. Only there k-mers are edges one by one: those
   of the pieces found once, and those of one source of each repeated piece.
3. Edges found twice or more are the repeated graph. A node where one edge comes in and one goes out does not branch;
   the edges on its two sides are linked, and pointer doubling over joins compacts each chain of links into one path.
4. The source coordinates of a path's edges, joined to the path, give one span for each passage of a document, accepted
   where its edges tile it without a gap; the document's words are then cut by its spans.

Edges are equal if a cryptographic digest of their words, read at the source coordinates, is, and so is another hash:
that of the anchor, or of a single k-mer's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import forget, staged, table
from .shingles import hashes, mix, split, windows

#: Words in an anchor.
ANCHOR = 8


_MULT = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def spans_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words in each [start, end), whose own hashes are h."""
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h) * _power(_MULT, len(h)), out=total[1:])
    back = _power(pow(_MULT, -1, 1 << 64), len(h))
    return mix((total[ends] - total[starts]) * back[starts]).view(np.int64)


def digests(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit cryptographic digest of the words in each [start, end)."""
    data = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])
    spans = zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(data[a:b], digest_size=8).digest() for a, b in spans]), dtype=np.int64)


def runs(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first k-mer, number of k-mers, anchor, digest) of each piece of a document."""
    none = np.zeros(0, dtype=np.int64)
    n = len(words) - k + 1
    if n <= 0:
        return none, none, none, none
    size = min(ANCHOR, k)
    value = windows(hashes(words), size)
    place = np.arange(len(value))
    width, want = 1, k - size + 1
    while width < want:  # leftmost least value of `width` sub-mers, doubled
        shift = min(width, want - width)
        left, right = value[: len(value) - shift], value[shift:]
        less = right < left
        value, place = np.where(less, right, left), np.where(less, place[shift:], place[: len(place) - shift])
        width += shift
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    counts = np.diff(np.append(starts, n))
    return starts, counts, value[starts].view(np.int64), digests(words, starts, starts + counts + k - 1)


def _key(docs: DataFrame) -> DataFrame:
    """Rows by (doc_id, hash of the text): rows equal in both have the same words and so the same result."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _on(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


DOC, EDGE = ["doc_id", "th"], ["a", "b"]


def _pieces(source: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, p, n, a, b): every piece of every row; a is the anchor, b the digest of the words."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [runs(split(t), k) for t in part.column("text").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                p, n, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                # Ids stay Arrow values: through pandas a null among them would turn large ones into other numbers.
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("th").take(rows), pa.array(p).cast(pa.int32()), pa.array(n).cast(pa.int32()), pa.array(a), pa.array(b)], [*DOC, "p", "n", *EDGE])

    return source.mapInArrow(cut, f"doc_id {kind}, th long, p int, n int, a long, b long")


def _kmers(with_text: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, p, asks, a, b): the k-mers of pieces, given as packed coordinates `at`, by hash and digest of their words."""
    kind = with_text.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                found = []
                for at, text in zip(part.column("at"), part.column("text").to_pylist(), strict=True):
                    x = at.values.to_numpy()
                    n = (x >> 1) & 255
                    p = np.repeat(x >> 9, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    words = split(text)
                    found.append((p, np.repeat(x & 1, n) == 1, spans_hash(hashes(words), p, p + k), digests(words, p, p + k)))
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                p, asks, a, b = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("th").take(rows), p.cast(pa.int32()), asks, a, b], [*DOC, "p", "asks", *EDGE])

    return with_text.mapInArrow(cut, f"doc_id {kind}, th long, p int, asks boolean, a long, b long")


#: Keys with more than this share of the rows (so at most its inverse in number) are joined by a broadcast.
HOT_SHARE = 0.001


def repeated_edges(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, p, n, a, b, hot): where the repeated graph's edges stand, once for rows equal in doc_id and text.

    hot marks the edges of more than HOT_SHARE of all places.
    """
    source = _key(docs)
    rows_repeat = not source.groupBy(*DOC).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    once_a_row = (lambda df: df.distinct()) if rows_repeat else (lambda df: df)
    found = staged(_pieces(source, k), "pieces")
    limit = max(1.0, HOT_SHARE * found.count())
    by_edge = staged(found.groupBy(*EDGE).agg(F.count("*").alias("c")), "by_edge")
    by_anchor = by_edge.groupBy("a").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).where("total > 1").drop("total")
    known = staged(by_edge.join(by_anchor, "a"), "known")
    hot = F.broadcast(known.where(F.col("c") > limit))
    counted = found.join(hot, EDGE).union(found.join(hot.select(*EDGE), EDGE, "left_anti").join(known.where(F.col("c") <= limit), EDGE)) if not known.where(F.col("c") > limit).isEmpty() else found.join(known, EDGE)
    counted = staged(once_a_row(counted.select(*DOC, "p", "n", *EDGE, "c", (F.col("kinds") > 1).alias("branching"))), "counted")
    forget(found, by_edge, known)

    once = counted.where("branching AND c = 1").select(*DOC, "p", "n", F.lit(True).alias("asks"))
    shown = counted.where("branching AND c > 1").groupBy(*EDGE).agg(F.min(F.struct(*DOC, "p", "n")).alias("s"))
    shown = once.union(shown.select("s.doc_id", "s.th", "s.p", "s.n", F.lit(False)))
    packed = F.col("p").cast("long") * 512 + F.col("n") * 2 + F.col("asks").cast("int")
    by_doc = staged(shown.groupBy(*DOC).agg(F.collect_list(packed).alias("at")), "shown")
    with_text = by_doc.join(source, _on(by_doc, source)).select(by_doc["doc_id"], by_doc["th"], "at", "text")
    single = staged(once_a_row(_kmers(with_text, k)), "kmers")
    forget(by_doc)
    twice = single.groupBy(*EDGE).agg(F.count("*").alias("c")).where("c > 1")
    singles = single.where("asks").join(twice, EDGE).select(*DOC, "p", F.lit(1).alias("n"), *EDGE, (F.col("c") > limit).alias("hot"))
    edges = staged(counted.where("c > 1").select(*DOC, "p", "n", *EDGE, (F.col("c") > limit).alias("hot")).union(singles), "edges")
    forget(counted, single)
    return edges


def compacted(edges: DataFrame) -> DataFrame:
    """(a, b, pa, pb, off): for each edge that is not the first of its path, the path's first edge and the k-mers before it.

    An edge is linked with the one before it where that is the only repeated edge before it in any document and it is
    the only one after that. Pointer doubling halves the chain left to each edge's head in every round; edges on a circle never
    find one, and stay paths of their own once the chains can be no longer.
    """
    at = W.partitionBy(*DOC).orderBy("p", F.desc("n"), *EDGE)
    after = F.lead(F.struct("p", *EDGE)).over(at)
    steps = edges.select(*EDGE, "n", F.col("p"), after.alias("next")).where("next.p = p + n").select("n", F.struct(*EDGE).alias("e"), F.struct("next.a", "next.b").alias("f"))
    steps = staged(steps.groupBy("e", "f").agg(F.max("n").alias("n")), "steps")
    out = steps.groupBy("e").agg(F.count("*").alias("outs")).where("outs = 1").select("e")
    into = steps.groupBy("f").agg(F.count("*").alias("ins")).where("ins = 1").select("f")
    links = steps.join(out, "e").join(into, "f").where("e <> f")
    links = staged(links.select("f.a", "f.b", F.col("e.a").alias("pa"), F.col("e.b").alias("pb"), F.col("n").cast("long").alias("off"), F.lit(False).alias("done")), "chains")
    forget(steps)
    before = None
    while (left := links.where("NOT done").count()) not in (0, before):  # a round that ends no chain leaves circles only
        before = left
        up = links.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("ua"), F.col("pb").alias("ub"), F.col("off").alias("more"), F.col("done").alias("ready"))
        moved = links.where("NOT done").join(up, ["pa", "pb"], "left")
        found = F.col("ua").isNotNull()
        moved = moved.select(*EDGE, F.coalesce("ua", "pa").alias("pa"), F.coalesce("ub", "pb").alias("pb"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), (~found | F.coalesce("ready", F.lit(False))).alias("done"))
        grown = staged(links.where("done").union(moved), "chains")
        forget(links)
        links = grown
    return links.where("done").drop("done")


def spans_of(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, th, spans): the first k-mer and the number of k-mers (first * 2**32 + number) of each passage on one path.

    An edge lies on a line, the path's start in the document; edges of one path and line that tile it are one span.
    """
    hot = edges.where("hot").select(*EDGE).distinct()  # at most 1 / HOT_SHARE
    rare = edges.where("NOT hot").join(paths, EDGE, "left")
    often = edges.where("hot").join(F.broadcast(paths.join(F.broadcast(hot), EDGE, "left_semi")), EDGE, "left")
    on = rare.union(often).select(*DOC, "p", "n", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb"), (F.col("p") - F.coalesce("off", F.lit(0))).alias("line"))
    # All groups of a document are made where the document is.
    each = on.repartition(*DOC).groupBy(*DOC, "pa", "pb", "line").agg(F.min("p").alias("p"), F.max(F.col("p") + F.col("n")).alias("end"), F.sum("n").alias("n"), F.collect_list(F.struct("p", "n")).alias("own"))
    pack = lambda p, n: F.shiftleft(p.cast("long"), 32) + n.cast("long")
    whole = F.array(pack(F.col("p"), F.col("n")))
    apart = F.transform("own", lambda x: pack(x["p"], x["n"]))
    tiled = each.select(*DOC, F.when(F.col("end") - F.col("p") == F.col("n"), whole).otherwise(apart).alias("s"))
    return tiled.groupBy(*DOC).agg(F.flatten(F.collect_list("s")).alias("spans"))


def covered(n_words: int, spans: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a window that starts in one of the spans."""
    if not len(spans):
        return np.zeros(n_words, dtype=bool)
    edge = np.zeros(n_words + 1, dtype=np.int64)
    first, n = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n + k - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, k: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept `text` of every row of documents (doc_id, text).

    A null or empty text has no words; with fewer than k words nothing is removed. Texts of any length are read whole.
    All copies go, the first included, and so do passages repeated inside one document. Repeated rows are copies of
    each other. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    if not 1 <= k <= 200:
        raise ValueError("k must be in 1..200")
    kind = docs.schema["doc_id"].dataType.simpleString()
    edges = repeated_edges(docs, k)
    spans = staged(spans_of(edges, compacted(edges)), "spans").withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    forget(edges)
    source = _key(docs)
    both = source.join(spans, source["doc_id"].eqNullSafe(spans["_id"]) & (source["th"] == spans["_th"]), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                part = batch.slice(at, 500)
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    words = split(text)
                    gone = covered(len(words), spans.values.to_numpy() if spans.is_valid else np.zeros(0, dtype=np.int64), k)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                cols = zip(*out, strict=True)
                made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS p FROM w WHERE len(ws) >= 35
), h AS (
  SELECT doc_id, p, array_to_string(ws[p + 1 : p + 35], ' ') AS win FROM p
), r AS (
  SELECT win FROM h GROUP BY win HAVING count(*) > 1
), c AS (
  SELECT DISTINCT doc_id, p + unnest(range(35)) AS i FROM h JOIN r USING (win)
), g AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i - 1)) END AS kept
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""
