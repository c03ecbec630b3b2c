import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import SF
from wayloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, part int"


def near(x, book):
    return min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), j) for j, e in enumerate(book))


def want(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = sorted(((i, v, label) for i, v, label in kept if len(v) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sizes = [length // parts + (p < length % parts) for p in range(parts)]
    cuts = [slice(sum(sizes[:p]), sum(sizes[: p + 1])) for p in range(parts)]
    books = [[v[c] for _, v, _ in kept[:entries]] for c in cuts]
    for _ in range(rounds):
        for p, c in enumerate(cuts):
            met = defaultdict(list)
            for _, v, _ in kept:
                met[near(v[c], books[p])[1]].append(v[c])
            books[p] = [[sum(x) // len(met[j]) for x in zip(*met[j], strict=True)] if j in met else e for j, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [near(v[c], books[p]) for p, c in enumerate(cuts)]) for i, v, label in kept]
    sums = Counter()
    for _, label, n in found:
        sums[label] += sum(d for d, _ in n)
    return Counter((i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), sums[label], digest) for i, label, n in found)


def got(spark, rows, monkeypatch):
    frame = spark.createDataFrame([(*r, "clash", 7, 8) for r in rows], SCHEMA)
    monkeypatch.setattr(vc, "table", lambda *a: frame)
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.op13_partial_distance_codes(spark, "").collect())


@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 9), st.integers(1, 11), st.sampled_from([2, 50, 1 << 33]))
@settings(max_examples=80, deadline=None)
def test_search_finds_the_lowest_of_the_nearest(seed, n, k, d, size):
    g = np.random.default_rng(seed)
    x, book = g.integers(-size, size, (n, d)), g.integers(-size, size, (k, d))
    index, distance = vc.nearest(x, book)
    expect = [near(a, book.tolist()) for a in x.tolist()]
    assert list(zip(distance.tolist(), index.tolist(), strict=True)) == expect


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.op13_partial_distance_codes(spark, SF).collect()) == want(rows)


def test_edge_cases(spark, monkeypatch):
    g = np.random.default_rng(5)
    some = [(i, [float(np.float32(x)) for x in g.normal(size=6)], int(i % 3) if i % 4 else None) for i in range(300)]
    odd = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 2), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 2), (904, [1.0], 3), (905, [], 3), (None, [0.5] * 6, None), (3, some[3][1], 1), (3, [2.0] * 6, 1), (906, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 9)]
    expect = want([r for r in some + odd if r[0] != 906])
    assert got(spark, some + odd[:-1], monkeypatch) == expect
    monkeypatch.setattr(vc, "HOT_SHARE", 3)
    assert got(spark, some + odd[:-1], monkeypatch) == expect
    assert len(got(spark, some + odd, monkeypatch)) == len(expect) + 1
    assert got(spark, some[:3], monkeypatch) == want(some[:3])
    assert got(spark, [], monkeypatch) == Counter() == got(spark, odd[:2], monkeypatch)
