"""Vector codes in whole numbers: each part of a vector is the index of its nearest codebook entry.

A codebook holds at most `entries` parts, so what goes to the tasks and to the driver in a round is the codebooks and
their sums: entries times a vector's length, however many vectors there are. Sums are exact, so the order of tasks
changes nothing. Entries are searched by partial distances: see nearest().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import staged, table

#: Vectors that are compared with a codebook at once, and dimensions between two looks at the best complete distance.
BLOCK = 512
STEP = 4
#: Labels with at least one of so many vectors each are at most so many: their sums may be broadcast.
HOT_SHARE = 1000
#: Larger components, either sign, count as this.
LARGEST = 1 << 62


def _exact(*arrays: np.ndarray) -> type:
    """int64 where no squared distance between the arrays' rows can overflow it, else Python's own integers."""
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    return np.int64 if 4 * most * most * max(arrays[0].shape[1], 1) < 1 << 62 else object


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest row of book for each row of x (ties: the lower), and its squared distance.

    Dimensions are summed in the order of falling variance in the book. A mask drops each entry once its sum strictly
    exceeds the best complete distance of its vector so far, which is that of the entry that looked best at the last look.
    """
    n, d = x.shape
    kind = _exact(x, book)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable") if d else np.arange(0)
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    index, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=kind)
    for at in range(0, n, BLOCK):
        xs = x[at : at + BLOCK]
        rows = np.arange(len(xs))
        best = None
        row, entry = np.repeat(rows, len(book)), np.tile(np.arange(len(book)), len(xs))
        sums = np.zeros((len(xs), len(book)), dtype=kind)
        for k in range(min(STEP, d)):
            away = xs[:, k, None] - book[None, :, k]
            sums += away * away
        sums = sums.ravel()
        for begin in range(min(STEP, d), d + STEP, STEP):
            first = np.searchsorted(row, rows)
            low = np.minimum.reduceat(sums, first)
            lowest = np.flatnonzero(sums == low[row])
            lead = lowest[np.searchsorted(row[lowest], rows)]
            rest = xs[:, begin:] - book[entry[lead], begin:]
            whole = sums[lead] + (rest * rest).sum(axis=1)
            best = whole if best is None else np.minimum(best, whole)
            for k in range(begin, min(begin + STEP, d)):
                live = sums <= best[row]
                row, entry, sums = row[live], entry[live], sums[live]
                away = xs[row, k] - book[entry, k]
                sums = sums + away * away
            live = sums <= best[row]
            row, entry, sums = row[live], entry[live], sums[live]
        first = np.searchsorted(row, rows)
        low = np.minimum.reduceat(sums, first)
        lowest = np.flatnonzero(sums == low[row])
        index[at : at + BLOCK] = entry[lowest[np.searchsorted(row[lowest], rows)]]
        distance[at : at + BLOCK] = low
    return index, distance


def _parts(length: int, parts: int) -> list[slice]:
    """Consecutive parts; where they cannot be equal the first ones are one longer."""
    ends = np.cumsum([length // parts + (p < length % parts) for p in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, length)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): vectors (vec_id, embedding, label) with floor(scale * x) for each component.

    Rows go whose vector is null or holds a component that is null, not a number or infinite; components beyond LARGEST
    count as that. Of the vectors left those of the most frequent length stay (ties: the longer), as others cannot be
    compared with them.
    """
    v = F.col("embedding")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * float(scale)))).cast("long")
    kept = staged(vectors.where(usable).select("vec_id", "label", F.transform(v, scaled).alias("v")), "vectors")
    length = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept if length is None else kept.where(F.size("v") == length["size"])


class Codebooks:
    """A codebook for each part of the vectors (vec_id, label, v) of equal length."""

    def __init__(self, books: list[np.ndarray], cuts: list[slice]):
        self.books, self.cuts = books, cuts

    @classmethod
    def fit(cls, vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
        """Starts from the vectors of the smallest vec_ids (null last; ties by components) and moves each entry, `rounds` times, to the floor of the mean of the parts nearest to it."""
        first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)
        cuts = _parts(start.shape[1], parts)
        out = cls([start[:, c].copy() for c in cuts], cuts)
        for _ in range(rounds if len(first) else 0):
            out = out._moved(vectors)
        return out

    @property
    def length(self) -> int:
        return self.cuts[-1].stop

    def _moved(self, vectors: DataFrame) -> Codebooks:
        books, cuts, length = self.books, self.cuts, self.length

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(b), dtype=np.int64) for b in books]
            totals = [np.zeros(b.shape, dtype=object) for b in books]
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch, length)
                kind = np.int64 if int(abs(v).max(initial=0)) * len(v) < 1 << 62 else object
                for p, cut in enumerate(cuts):
                    at, _ = nearest(v[:, cut], books[p])
                    order = np.argsort(at, kind="stable")
                    used, begins = np.unique(at[order], return_index=True)
                    counts[p] += np.bincount(at, minlength=len(books[p]))
                    if totals[p].shape[1]:
                        totals[p][used] += np.add.reduceat(v[order, cut].astype(kind), begins, axis=0)
            rows = [(p, int(e), int(counts[p][e]), list(map(str, totals[p][e].tolist()))) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], ["part", "entry", "n", "total"])

        by_task = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, total array<string>")
        each = by_task.select("part", "entry", "n", F.posexplode_outer("total").alias("k", "t"))
        moved = [b.copy() for b in books]
        for r in each.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect():  # entries times length
            if r["k"] is not None:
                moved[r["part"]][r["entry"], r["k"]] = int(r["t"]) // r["n"]
        return Codebooks(moved, cuts)

    def digest(self) -> str:
        """SHA-256 of all entries' components as decimals, by part, entry and place."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) of each vector: two hex digits a part (more where a codebook has over 256 entries), and the squared distances' sum (at most the largest long)."""
        books, cuts, length = self.books, self.cuts, self.length
        digits = max(2, *(len(f"{max(len(b) - 1, 0):x}") for b in books))

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch, length)
                at, far = zip(*(nearest(v[:, cut], book) for cut, book in zip(cuts, books, strict=True)), strict=True)
                code = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*(a.tolist() for a in at), strict=True)]
                error = [min(sum(row), (1 << 63) - 1) for row in zip(*(f.tolist() for f in far), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
        return vectors.select("vec_id", "label", "v").mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over equal labels, nulls together. Few labels can be hot; their sums are sent to all tasks, so no task meets all rows of one."""
    sums = staged(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("s")), "labels")
    sums = sums.select(F.col("label").alias("of"), "n", F.least("s", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    least = coded.count() / HOT_SHARE
    hot = F.broadcast(sums.where(F.col("n") >= least).select("of", F.col("label_error").alias("hot_error")))  # at most HOT_SHARE rows
    first = coded.join(hot, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    met = first.where("hot_error IS NOT NULL").withColumnRenamed("hot_error", "label_error")
    rest = first.where("hot_error IS NULL").drop("hot_error")
    cold = sums.where(F.col("n") < least).select("of", "label_error")
    return met.select("vec_id", "label", "code", "error", "label_error").union(rest.join(cold, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error"))


def op13_partial_distance_codes(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), 1024)
    books = Codebooks.fit(vectors)
    coded = with_label_errors(staged(books.encode(vectors), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    """The query in SQL, for vectors of one length that four divides; distances are exact as doubles."""
    dot = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    found = "SELECT rid, part, any_value(x) AS x, min(CAST(xx - 2 * " + dot("x", "e") + " + ee AS BIGINT) * 256 + entry) AS m FROM p JOIN c{r} USING (part) GROUP BY rid, part"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({found.format(r=r)})")
        mean = "(s - ((s % n) + n) % n) // n"
        sums = f"SELECT part, m % 256 AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) u GROUP BY ALL"
        steps.append(f"n{r} AS (SELECT part, entry, list({mean} ORDER BY i) AS e FROM ({sums}) q GROUP BY part, entry)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, e, {dot('e', 'e')} AS ee FROM (SELECT c.part, c.entry, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN n{r} n USING (part, entry)) q)")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT rid, part, x, {dot('x', 'x')} AS xx FROM (SELECT rid, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k, range(4) r(part)) q),
 c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS e, xx AS ee FROM p WHERE rid <= 256), {", ".join(steps)},
 f AS MATERIALIZED ({found.format(r=rounds)}), d AS (SELECT rid, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM f GROUP BY rid),
 h AS (SELECT sha256(string_agg(CAST(e[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS digest FROM c{rounds}, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i) u)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM k JOIN d USING (rid), h"""


OP13_SQL = _sql()
