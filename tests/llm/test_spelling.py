import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st

from tests.llm.helpers import SF, docs
from wayloom.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(texts, least_n=3, every=97):
    n = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least_n}


def want(voc):
    near = {w: [x for x in voc if one_edit(w, x)] for w in voc}
    form = {}
    for w, n in voc.items():
        best = min(near[w], key=lambda x: (-voc[x], x), default=None)
        if best and voc[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in voc.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), voc[form[w]] if w in form else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@given(st.lists(st.text("abé", min_size=0, max_size=7), max_size=30, unique=True))
@settings(max_examples=200, deadline=None)
def test_group_finds_every_pair_that_it_should(texts):
    for c in {len(t) for t in texts}:
        group = sorted((t for t in texts if len(t) in (c, c + 1)), key=len)
        if group and len(group[0]) == c:
            pairs = sorted(spelling.near_in_group(group))
            assert pairs == [(i, j) for i in range(len(group)) for j in range(i) if len(group[j]) == c and one_edit(group[i], group[j])]


def test_small_groups_and_ties(spark, monkeypatch):
    words = {a + b + c: 3 + (ord(b) * 7 + len(c)) % 40 for a in ("inter", "Änter", "xx") for b in "abcdefghij" for c in ("", "n", "tion", "tiom", "ation")}
    words |= {"x" * 300: 3, "x" * 299: 9, "x" * 301: 9, "x" * 302: 40}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for size in (300, 4):
        monkeypatch.setattr(spelling, "GROUP", size)
        assert got(spelling.variants(frame)) == want(words)


def test_counts_nulls_and_case(spark):
    texts = [(1, "Hello hello HELLO hallo, hallo\nhallo"), (1, "Hello hello HELLO hallo"), (None, "École école éCOLE ÉCOLE straße"), (4, None), (5, ""), (6, "hello" * 5000 + " strasse" * 6), (7, "hello÷hellô×hellô hellô")]
    for every in (97, 1):
        voc = spelling.vocabulary(docs(spark, texts), every=every)
        assert {r.word: r.n for r in voc.collect()} == vocabulary(texts, every=every)
    assert got(spelling.variants(spelling.vocabulary(docs(spark, texts)))) == want(vocabulary(texts))
    assert spelling.variants(spelling.vocabulary(docs(spark, []))).collect() == []


def test_query_against_all_pairs(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    voc = vocabulary(texts)
    some = {w for w in voc if w[0] in "abc"}  # all pairs of all words would take long here
    full = got(spelling.op12_spelling_variants(spark, SF))
    assert full.keys() == voc.keys()
    for w in some:
        near = [x for x in voc if one_edit(w, x)]
        best = min(near, key=lambda x: (-voc[x], x), default=None)
        form = best if best and voc[best] >= 2 * voc[w] else None
        assert full[w][0] == form and full[w][2:] == (voc[w], len(near), voc[form] if form else None)
        assert full[w][1] == (full[form][1] if form else w)
