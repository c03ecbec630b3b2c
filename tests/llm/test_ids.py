"""Ids above 2**53 beside a null, and columns with the names that operators use inside."""

import public_tokenizers as P

import corpus_pipeline
from tests.llm.helpers import SF, docs
from wayloom.llm import html_text, id_store, near_dup, packing, substring_dedup, toxicity

BIG = [2**53 + 1, 2**53 + 3, None, 2**62 + 1]
ROWS = [(d, f"text number {i} with some words of its own {i * 7} and so on") for i, d in enumerate(BIG)]


def test_large_ids_beside_a_null(spark):
    df = docs(spark, ROWS).coalesce(1)
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    byte, word = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
    store = id_store.IdStore.write(df, word)
    results = {
        "packing": packing.pack(df, byte),
        "repeats": substring_dedup.remove_repeats(df),
        "near": near_dup.near_duplicates(df),
        "ids": store.read(df.selectExpr("doc_id AS key")),
        "toxicity": toxicity.toxicity(df, labels),
    }
    for name, out in results.items():
        assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, BIG)), name
    pages = spark.createDataFrame([(d, "u", "<p>Hello there.</p>") for d in BIG], "page_id long, url string, html string").coalesce(1)
    assert sorted(map(str, (r.page_id for r in html_text.extract(pages, html_text.new_model()).collect()))) == sorted(map(str, BIG))


def test_pipeline_keeps_ids_and_clashing_columns(spark):
    df = docs(spark, ROWS).coalesce(1).selectExpr("*", "9.0D AS score", "'mine' AS _row", "true AS _one", "5 AS _n", "6 AS _h", "7 AS _base", "8 AS _terms")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns and got.dtypes == df.dtypes, name
        assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, BIG)), name
        assert {(r.score, r._row, r._n, r._h) for r in got.collect()} == {(9.0, "mine", 5, 6)}, name
    assert {r.doc_id for r in corpus_pipeline.packing(spark, df, SF).collect()} == set(BIG)
