"""Best-fit packing with swap-based local search, over counts of piece lengths.

Only a piece's length matters for where it fits, so the packing is solved over the histogram of lengths (at most
`max_tokens` counts, whatever the corpus size): classes of equal bins, each a multiset of lengths with a multiplicity.
Best fit builds the classes; the local search exchanges one-for-one, two-for-one or moves lengths between underfull
classes while that raises the squared fill, which empties bins. Pieces then take the classes' places by their rank
within their length, found from per-partition counts, so no task and no driver sees more than its own rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.staging import staged, table
from .tokens import encoded, tokenizer_spec

#: Texts of a batch that are Python strings at once.
SLICE = 500

Bins = dict[tuple[int, ...], int]  # lengths in falling order -> number of such bins


def best_fit(counts: dict[int, int], cap: int) -> Bins:
    """Best fit, longest first: each piece goes to the fullest bin that takes it, or opens one.

    Equal bins are filled at once. A bin that takes a length is then the fullest that may take more of it, so it gets
    as many as it holds before the next one.
    """
    by_fill: dict[int, list[tuple[tuple[int, ...], int]]] = {0: [((), sum(counts.values()))]}
    for x, n in sorted(((k, v) for k, v in counts.items() if v > 0), reverse=True):
        while n:
            fill = max(f for f in by_fill if f <= cap - x)
            items, bins = by_fill[fill].pop()
            each = (cap - fill) // x
            whole, rest = min(bins, n // each), 0
            if whole < bins:
                rest = n - whole * each  # less than a bin holds
            for take, times in ((each, whole), (rest, 1 if rest else 0)):
                if times:
                    by_fill.setdefault(fill + take * x, []).append((items + (x,) * take, times))
            left = bins - whole - (1 if rest else 0)
            if left:
                by_fill[fill].append((items, left))
            elif not by_fill[fill]:
                del by_fill[fill]
            n -= whole * each + rest
    out: Bins = {}
    for classes in by_fill.values():
        for items, bins in classes:
            if items:
                out[items] = out.get(items, 0) + bins
    return out


def _sums(items: tuple[int, ...]) -> dict[int, tuple[int, ...]]:
    """One or two of a bin's lengths for each sum that they make; one where it does. A bin of `cap` has few distinct lengths."""
    has = Counter(items)
    lengths = sorted(has)
    out = {x + y: (x, y) for i, x in enumerate(lengths) for y in lengths[i + (has[x] < 2) :]}
    return out | {x: (x,) for x in lengths}


def _mask(sums) -> int:
    m = 0
    for s in sums:
        m |= 1 << s
    return m


@lru_cache(maxsize=100_000)
def _offers(items: tuple[int, ...]) -> tuple[dict[int, tuple[int, ...]], int, int]:
    """The sums of one or two lengths, as a map and as bits, and the bits of single lengths."""
    sums = _sums(items)
    return sums, _mask(sums), _mask(set(items))


def _exchange(a: tuple[int, ...], b: tuple[int, ...], cap: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The change between the fuller bin a and bin b that fills a most: a move, one-for-one or two-for-one; None if none helps."""
    room, best, gain = cap - sum(a), None, 0
    sums_a, _, _ = _offers(a)
    _, any_b, ones_b = _offers(b)
    for given in (0, *sums_a):
        give = sums_a[given] if given else ()
        # One for one or two, two for one, and one for nothing.
        offered = (any_b if len(give) == 1 else ones_b) & ((1 << (given + room + 1)) - 1)
        taken = offered.bit_length() - 1
        if taken - given > gain:
            best, gain = (give, taken), taken - given
            if gain == room:
                break
    if best is None:
        return None
    give, taken = best
    take = (taken,) if len(give) != 1 or ones_b >> taken & 1 else _offers(b)[0][taken]
    new_a, new_b = Counter(a), Counter(b)
    new_a.subtract(give)
    new_a.update(take)
    new_b.subtract(take)
    new_b.update(give)
    return tuple(sorted(new_a.elements(), reverse=True)), tuple(sorted(new_b.elements(), reverse=True))


def local_search(bins: Bins, cap: int) -> Bins:
    """Raises the squared fill by exchanges between classes of underfull bins, until no exchange helps or no bin can go.

    Every exchange makes the fuller bin fuller, so the squared fill rises each time and the search ends. Equal bins
    are one class and change together.
    """
    bins = dict(bins)
    least = -(-sum(sum(k) * n for k, n in bins.items()) // cap)
    changed = True
    while changed and sum(bins.values()) > least:
        changed = False
        under = sorted((k for k in bins if sum(k) < cap), key=lambda k: (-sum(k), k))
        for i, a in enumerate(under):
            for b in reversed(under[i:]):
                n = min(bins.get(a, 0), bins.get(b, 0)) if a != b else bins.get(a, 0) // 2
                if n and (new := _exchange(a, b, cap)):
                    for k in (a, b):
                        bins[k] -= n
                        if not bins[k]:
                            del bins[k]
                    for k in new:
                        if k:
                            bins[k] = bins.get(k, 0) + n
                    changed = True
                if not bins.get(a):
                    break
    return bins


def pack_counts(counts: dict[int, int], cap: int) -> Bins:
    full = counts.get(cap, 0)
    bins = local_search(best_fit({k: v for k, v in counts.items() if k < cap}, cap), cap)
    return bins | ({(cap,): full} if full else {})


def places(bins: Bins) -> pd.DataFrame:
    """Runs of ranks: pieces of `length` with ranks from `rank` on take offset `at` of the sequences from `sequence` on."""
    rows, taken, first = [], Counter(), 0
    for lengths, n in sorted(bins.items(), reverse=True):
        at = 0
        for x in lengths:
            rows.append((x, taken[x], n, first, at))
            taken[x] += n
            at += x
        first += n
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "at"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def cut(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of cap but the first, which holds the remainder."""
    first = n % cap or cap
    return [(0, first)] + [(s, cap) for s in range(first, n, cap)]


def pieces(docs: DataFrame, spec: str, end_id: int, cap: int) -> DataFrame:
    """Pieces of each row's ids, with `part` and the place among the pieces of that length in the part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(cap + 1, dtype=np.int64)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            at, out = [], []
            for row, payload in enumerate(encoded(spec, batch.column("text").to_pylist(), end_id)):
                for i, (start, length) in enumerate(cut(len(payload) // 4, cap)):
                    at.append(row)
                    out.append((i, start, length, zlib.crc32(payload[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            cols = np.array(out, dtype=np.int64).reshape(-1, 6).T
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            # Ids stay Arrow values: through pandas a null among them would turn large ones into other numbers.
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c).cast(t) for c, t in zip(cols, types, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, max_tokens: int = 1024) -> DataFrame:
    """Packs the token ids of documents (doc_id, text) into sequences of at most max_tokens.

    Null and empty texts are a piece of the end id alone. Rows with the same doc_id are packed each for itself. Longer
    documents are cut into pieces of max_tokens; the first piece holds the remainder. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    cut_up = staged(pieces(docs, tokenizer_spec(tokenizer_file), end_id, max_tokens), "pieces")
    by_part = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    where = places(pack_counts(counts, max_tokens))
    # One number orders (length, rank); the runs are as many as the classes have lengths, not as the pieces.
    keys = where["length"].to_numpy() * (1 << 50) + where["rank"].to_numpy()
    ranks, sequences, offsets = (where[c].to_numpy() for c in ("rank", "sequence", "at"))
    ranked = cut_up.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            i = np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences[i] + rank - ranks[i]), pa.array(offsets[i])], [*cols, "sequence_id", "offset"])

    return ranked.select(*cols, "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
