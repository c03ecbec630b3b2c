"""Personal data in a text with very many mentions."""

import time

from tests.llm.helpers import collect, docs
from wayloom.llm import pii


def test_many_mentions_in_one_text(spark):
    text = " ".join(f"n{i} user{i % 50}@host{i % 7}.org" for i in range(6000))
    start = time.time()
    got = collect(pii.detect(docs(spark, [(1, text), (2, "x")])))
    assert got[1]["n_email"] == 6000 and got[2]["spans"] == ""
    assert time.time() - start < 60


def test_documents_of_terms_are_counted_before_words_are_shuffled(spark, monkeypatch):
    texts = docs(spark, [(1, "alpha beta Beta"), (2, "beta, gamma"), (3, None)])
    wanted = spark.createDataFrame([("beta",), ("gamma",)], "term string")
    few = pii._document_counts(texts, wanted)
    assert dict(map(tuple, few.collect())) == {"beta": 2, "gamma": 1}
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 1)
    many = pii._document_counts(texts, wanted).join(wanted, "term")
    assert dict(map(tuple, many.collect())) == {"beta": 2, "gamma": 1}
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and plan.count("Join") == 1
