import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import SF, docs
from wayloom.llm import packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_bins_hold_every_piece_once(counts):
    bins = packing.pack_counts(counts, 64)
    got = Counter()
    for k, n in bins.items():
        assert sum(k) <= 64 and n > 0
        for x in k:
            got[x] += n
    assert got == Counter(counts)
    assert sum(bins.values()) <= sum(packing.best_fit(counts, 64).values())


def test_search_raises_squared_fill_and_empties_bins():
    bins = {(60,): 1, (30, 30): 1, (4, 4): 1}
    out = packing.local_search(bins, 64)
    assert sum(out.values()) == 2
    assert packing._exchange((60,), (4,), 64) == ((60, 4), ())
    assert packing._exchange((40, 10), (24,), 64) == ((40, 24), (10,))
    assert packing._exchange((40, 20), (12, 12), 64) == ((40, 12, 12), (20,))


def check(rows, texts, cap=1024):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for d, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for i, (s, n) in enumerate(packing.cut(len(ids), cap)):
            want[d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= cap
    return len(seqs), -(-sum(r.length for r in rows) // cap)


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "a"), (4, "a"), (None, "b"), (5, "x\n\n\n  y   z "), (6, "<|endoftext|>")]
    check(packing.pack(docs(spark, texts), P.path("byte_bpe_50k.json")).collect(), texts)
    assert packing.pack(docs(spark, []), P.path("byte_bpe_50k.json")).collect() == []


def test_whole_table_is_packed_tightly(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, least = check(packing.op3_best_fit_packing(spark, SF).collect(), texts)
    assert n <= least + max(1, least // 100)


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)])])
def test_cut(n, want):
    assert packing.cut(n, 1024) == want
