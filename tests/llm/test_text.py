"""Quotation linking, page text and the pipeline."""

import collections
import re
import time
from random import Random

import numpy as np

import corpus_pipeline
from tests.llm.helpers import SF, collect, docs
from wayloom.llm import html_text as H, quotes
from wayloom.plans.staging import staged


def test_quotes_are_linked_and_removed(spark):
    m = [(1, 0, "user", "Hello there, how are you?\nSecond line here."), (1, 1, "assistant", "On Mon X wrote:\n> Hello there,  how are you?\nI am fine thanks."), (1, 2, "user", "Unrelated thing entirely."),
         (1, 3, "user", ">> hello there, how ARE you?\n> I am fine thanks.\n\nGreat to hear it."), (1, 4, "user", "> Unrelated thing entirely.\nok"), (2, 0, "u", None), (None, 0, "u", "x"), (2, None, "u", "> x"), (2, 1, "u", "> not found"), (2, 1, "u", "> not found")]
    df = spark.createDataFrame([(*x, 1) for x in m], "conv_id long, turn long, role string, text string, root_turn int")
    got = quotes.link_quotes(df).collect()
    assert len(got) == len(m)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].parent_turn, by[1, t].root_turn, by[1, t].position) for t in range(5)] == [(None, 0, 0), (0, 0, 1), (None, 2, 3), (1, 0, 2), (2, 2, 4)]
    assert by[1, 1].text == "I am fine thanks." and by[1, 3].text == "Great to hear it." and by[1, 3].max_depth == 2
    assert by[2, 1].parent_turn is None and by[2, 0].text == "" and by[None, 0].position == 0
    assert sorted(r.position for r in got if r.conv_id == 2) == [0, 1, 2, 3]
    assert quotes.link_quotes(df.limit(0)).collect() == []


def test_every_conversation_is_ordered(spark):
    got = quotes.op1_quotation_linking(spark, SF).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.conv_id, []).append((r.position, r.turn))
    for v in seen.values():
        assert [p for p, _ in sorted(v)] == list(range(len(v))) and [t for _, t in sorted(v)] == sorted(t for _, t in v)


def test_blocks():
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><p>a &amp; b<p>c <b>d</b> e<br>f<script>"</p>"</script></article><!-- <p>no</p> --><p>x < y</p><div class="ad">z'
    assert [b[0] for b in H.blocks(page)] == ["T", "Menu", "a & b", "c d e f", "x < y", "z"]
    assert H.blocks(None) == [] and H.blocks("") == [] and [(t, n.tag, k) for t, n, k in H.blocks("plain")] == [("plain", "", 0.0)]
    assert [b[0] for b in H.blocks("<p>two<hr>three<br>four<img>five</div></b>six")] == ["two", "three fourfive", "six"]
    assert [n.mark for _, n, _ in H.blocks('<main><p>a</p><div class="x ad">b<p>c</div>d</main><p>e')] == [1, 0, 0, 1, None]


def test_reading_is_linear():
    start = time.time()
    page = "<div>" * 8000 + "".join(f"<b><p>word {i} is here.<svg><option>" for i in range(20000))
    assert len(H.blocks(page)) == 20000 and time.time() - start < 10


def test_long_pages_are_read_in_parts(monkeypatch):
    model, page = H.new_model(5), H.blocks("".join(f"<p>word {i} stands here.</p>" for i in range(50)))
    (whole,) = H.label(model, [page])
    monkeypatch.setattr(H, "GROUP_BLOCKS", 7)
    (parts,) = H.label(model, [page])
    assert np.abs(whole - parts).max() < 1e-5


def test_gradient():
    r = Random(3)
    x, mask = H.padded([H.vectors(H.blocks(H.made_page(r)))[:4] for _ in range(2)])
    y, model = (np.arange(8).reshape(2, 4) % 2).astype(float), H.new_model(3)
    _, g = H.gradients(model, x, mask, y, mask)
    for k in g:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        out = []
        for d in (1e-5, -1e-5):
            model[k][i] += d
            out.append(H.gradients(model, x, mask, y, mask)[0])
            model[k][i] -= d
        assert abs(g[k][i] - (out[0] - out[1]) / 2e-5) < 1e-6


def test_held_out_pages_and_edges(spark):
    r = Random(99)
    pages = [H.made_page(r) for _ in range(120)]
    want = [" ".join(t for t, n, _ in H.blocks(x) if n.said) for x in pages]
    rows = [(i, "u", re.sub(r" data-is=[01]", "", x), 1) for i, x in enumerate(pages)] + [(900, None, None, 1), (901, "u", "", 1), (None, "u", "<p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {x.page_id: x for x in H.extract(df, H.train(df.limit(0))).collect()}
    words = lambda t: collections.Counter(t.split())
    both = sum((words(got[i].text) & words(w)).total() for i, w in enumerate(want))
    assert both > 0.95 * sum(words(w).total() for w in want) and both > 0.95 * sum(words(got[i].text).total() for i in range(len(want)))
    assert got[900].text == "" and got[901].n_chars == 0 and got[None].text == ""
    assert H.extract(df.limit(0), H.new_model()).collect() == []


def test_pages_of_another_hand(spark):
    """A wiki, coded names with a reader comment, no names, foreign names."""
    story = [f"The {a} of the old harbour town was rebuilt in {y}, after a fire that burned for {d} days. Nobody knows who laid the first stone, but the council paid for the rest." for a, y, d in (("church", 1720, 3), ("market", 1731, 2), ("bridge", 1744, 5), ("school", 1802, 4), ("mill", 1850, 6))]
    paras = "".join(f"<p>{x}</p>" for x in story)
    menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Contact", "About"))
    wiki = f'<html><body><div id="mw-head"><ul>{menu}</ul></div><div class="mw-body"><div class="mw-parser-output">{paras}</div></div><div id="catlinks"><ul>{menu}</ul></div></body></html>'
    coded = f'<html><body><div class="x1a2"><ul>{menu}</ul></div><div class="q-77f"><h1>The old harbour town</h1>{paras}</div><div class="zz-9"><h3>Comments</h3><div class="k1">Anna says:</div><div class="k2">Nice one, thanks for sharing this with us.</div><a href="#">Reply</a></div><div class="b0">&copy; 2024 All rights reserved</div></body></html>'
    bare = f"<html><body><ul>{menu}</ul><h1>The old harbour town</h1>{paras}<div>&copy; All rights reserved</div></body></html>"
    german = f'<html><body><div id="hauptmenue"><ul>{menu}</ul></div><div id="inhalt"><h1>The old harbour town</h1>{paras}</div><div class="werbung">Anzeige Buy now and save</div><div id="fusszeile">Impressum</div></body></html>'
    df = spark.createDataFrame(list(enumerate((wiki, coded, bare, german))), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    got = {x.page_id: x.text for x in H.extract(df, H.train(spark.read.parquet(f"{SF}/pages.parquet"))).collect()}
    for i, text in got.items():
        assert all(x in text for x in story), i
        assert not any(x in text for x in ("Home", "Reply", "Nice one", "reserved", "Anzeige")), (i, text)


def test_pages_of_the_table(spark):
    got = {x.page_id: x.text for x in H.op2_recurrent_block_labeller(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)
        if inner and "&" not in inner[1]:
            assert got[p.page_id] == " ".join(re.sub(r"<[^>]*>", " ", inner[1]).split())


def test_pipeline(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    at = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = staged(stage(spark, at, SF), name)
        assert new.columns == source.columns and new.dtypes == source.dtypes
        assert {r.doc_id for r in new.select("doc_id").collect()} <= {r.doc_id for r in at.select("doc_id").collect()}
        at = new
    assert 0.5 * source.count() < at.count() < source.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.collect()}


def test_pipeline_stages_take_empty_and_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "only one two three four five six")]
    for df in (docs(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, part int, row int, length string"), docs(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).collect()
    assert collect(corpus_pipeline.STAGES[3][1](spark, docs(spark, [(1, "a@b.c x")]), SF))[1]["text"] == "[EMAIL] x"


def test_pipeline_filters_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    one, two, three = ("north river hills fold under grey rain", "seven small boats left our harbour early", "bakers knead their dough before any sunrise")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, "plain words that nothing else here repeats"), (8, three), (None, None), (None, None), (9, ""), (9, "")]
    kept = corpus_pipeline.near_duplicate(spark, docs(spark, rows), SF)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[3], rows[4], *rows[6:]]))
    held = [(None, f"so {item} then"), (None, one), (5, two), (5, f"well {item}"), (6, None)]
    left = corpus_pipeline.decontamination(spark, docs(spark, held), SF)
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [held[1], held[2], held[4]]))
