import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import SF, docs
from wayloom.llm import id_store
from wayloom.llm.id_store import IdStore, MinimalPerfectHash

FILE = P.path("word_bpe_49k.json")


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=50, deadline=None)
def test_hash_is_minimal_and_perfect_and_round_trips(keys):
    h = np.array(sorted(keys), dtype=np.uint64)
    m = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(h).to_bytes())
    assert sorted(m(h).tolist()) == list(range(len(h)))


def want(texts):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    start, out = 0, []
    for d, x in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_edge_cases(spark):
    texts = [(3, None), (2, ""), (9, "Word " * 4000), (4, "a b"), (4, "a b"), (4, "c"), (None, "n"), (5, "é\n\n\n x's")]
    df = docs(spark, texts)
    store = IdStore.write(df, FILE)
    assert got(store.read(df.selectExpr("doc_id AS key"))) == want(texts)
    absent = spark.createDataFrame([(10**6 + i,) for i in range(50)], "key long")
    assert store.read(absent).collect() == []
    one = spark.createDataFrame([(9,)], "key long")
    assert got(store.read(one)) == [r for r in want(texts) if r[0] == 9]
    empty = docs(spark, [])
    assert IdStore.write(empty, FILE).read(empty.selectExpr("doc_id AS key")).collect() == []


def test_a_doc_id_of_many_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(id_store, "BLOCK_BYTES", 2000)
    texts = [(7, f"row {i % 900} of one key") for i in range(3000)] + [(None, f"none {i}") for i in range(1500)] + [(7, "same")] * 1500 + [(i, "a") for i in range(8, 40)]
    df = docs(spark, texts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = IdStore.write(df.repartition(8), FILE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    where = {(r.shard, r.block) for r in store.blocks.where("array_contains(keys, 7L)").collect()}
    assert len(where) > 10 and len({s for s, _ in where}) > 1
    whole = got(store.read(df.selectExpr("doc_id AS key")))
    # Rows of one key may be in any order: the same documents, one after the other without a gap.
    assert sorted(r[2:] for r in whole if r[0] == 7) == sorted(r[2:] for r in want(texts) if r[0] == 7)
    assert [r[0] for r in whole] == [r[0] for r in want(texts)]
    assert all(a[1] + a[2] == b[1] for a, b in zip(whole, whole[1:], strict=False)) and whole[0][1] == 0
    one = got(store.read(spark.createDataFrame([(7,)], "key long")))
    assert one == [r for r in whole if r[0] == 7] and len(one) == 4500
    assert len(got(store.read(spark.createDataFrame([(None,)], "key long")))) == 1500
    # The files hold nothing but ids.
    files = {r.file: r.n for r in store.blocks.groupBy("file").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()}
    for f, n in files.items():
        fs, path = id_store._store(f)
        assert fs.get_file_info(path).size == n * store.width


def test_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(id_store, "BUCKET_KEYS", 16)
    monkeypatch.setattr(id_store, "BLOCK_BYTES", 500)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(id_store.op8_perfect_hash_ids(spark, SF)) == want(texts)
