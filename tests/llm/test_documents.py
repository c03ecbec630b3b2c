"""Near-duplicates, repeated passages, personal data, decontamination, toxicity and quality on small tables, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import SF, collect, docs, words
from wayloom.llm import decontaminate as dc, near_dup, pii, quality, substring_dedup as sd, toxicity as tox

LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (4, LONG), (5, "a b c"), (6, "A B c"), (None, "a b c"), (7, "word " * 300), (8, LONG + " tail")]


def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(sets[i]), d if not sets[i] else min(ids[find(i)], default=None)) for i, (d, _) in enumerate(texts)]


def test_near_duplicates(spark):
    for texts, df in ((EDGE, docs(spark, EDGE)), (table(spark), spark.read.parquet(f"{SF}/documents.parquet"))):
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect())
        assert got == collections.Counter(brute_components(texts))
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []


def test_near_duplicates_in_a_large_group_of_unlike_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for d in range(60):
        w = list(base)
        for k in range(d % 6):
            w[(d * 7 + k * 23) % 150] = f"own{d}_{k}"
        texts.append((d, " ".join(w)))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts)).collect())
    assert got == collections.Counter(brute_components(texts))


def brute_repeats(texts, k):
    count = collections.Counter(tuple(w[i : i + k]) for _, t in texts for w in [words(t)] for i in range(len(w) - k + 1))
    out = []
    for d, t in texts:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("k", [5, 35])
def test_repeated_passages(spark, k):
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(20, "x1 x2 " + passage), (21, "y1 " + " ".join(passage.split()[10:50]) + " y2"), (22, "a b " * 40), (23, passage[: len(passage) // 2])]
    for texts in (EDGE + more, table(spark)):
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(docs(spark, texts), k).collect())
        assert got == brute_repeats(texts, k)
    assert sd.remove_repeats(docs(spark, []), k).collect() == []


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def spans(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(k, m[0]))


def test_personal_data(spark):
    texts = [(30, "é mail a.b+c@x.org+d@e.f 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (555) 010-9999 256.1.1.1 000.1.02.3"), (31, "9" * 20000), (32, "a@b " * 50 + "x\u0001y@z.w"), (33, "+1" + "(" * 3000), *EDGE, *table(spark)]
    got = pii.detect(docs(spark, texts)).collect()
    want = collections.Counter()
    for d, t in texts:
        found = spans(t)
        joined = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in found)
        want[(d, *(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.detect(docs(spark, [])).collect() == []


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"note {i} about thornhill manor: write to owner@manor.org soon please {i * 7919}") for i in range(6)]
    rows += [(100 + i, f"other text {i * 31} with soon please words about things") for i in range(40)] + [(200, None)]
    df = docs(spark, rows)
    got = collect(pii.detect(df))
    text = dict(rows)
    terms = {text[0][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[0]["spans"].split(",")) if k == "term"}
    assert {"thornhill", "manor"} <= terms and not {"soon", "please", "about"} & terms
    clean = collect(pii.sanitise(df))
    assert "thornhill" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"]
    assert clean[100]["text"] == text[100] and clean[200]["text"] is None and clean[0]["length"] == "clash"


def test_terms_far_from_the_entity(spark):
    gap = lambda i: " ".join(f"g{i}x{k}" for k in range(40))
    rows = [(i, f"Thornhill begins {i * 7919} {gap(i)} write to owner@manor.org soon {i * 31} {gap(-i)} and THORNHILL ends") for i in range(6)]
    rows += [(50 + i, f"seen near lakeside {i * 17} a@lake.org by day {gap(60 + i)} then lakeside once more") for i in range(6)]
    rows += [(100 + i, f"other text {i * 31} soon begins with ends and words about things by day then once more seen near write") for i in range(40)]
    rows += [(200, "the thornhill of no one")]
    got, text = collect(pii.detect(docs(spark, rows))), dict(rows)
    terms = lambda d: [text[d][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[d]["spans"].split(",")) if k == "term"]
    assert all(terms(d) == ["Thornhill", "THORNHILL"] for d in range(6)) and got[200]["spans"] == ""
    assert all(terms(d) == ["lakeside", "lakeside"] for d in range(50, 56))


def test_decontamination(spark):
    item = "If Mary has 12 apples and gives Tom 5 apples to her friend, how many apples does Mary keep? She had 12 at first."
    bench = spark.createDataFrame([(9, item), (9, item), (10, None), (11, ""), (None, "x")], "item_id long, text string")
    swap = lambda a, b, c, d: item.replace("Mary", a).replace("12", b).replace("Tom", c).replace("5 ", d + " ")
    rows = [(1, "So. " + item + " Bye"), (2, "x y z " + swap("Anna", "33", "Bob", "8")), (3, swap("Anna", "33", "Bob", "8").replace("33 at", "34 at")), (4, None), (5, ""), (6, " ".join(item.split()[:9])), (7, LONG), (1, "So. " + item + " Bye")]
    got = dc.decontaminate(docs(spark, rows), bench).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: (r.contaminated, r.n_exact, r.n_reparameterised) for r in got}
    assert held == {1: (True, 1, 0), 2: (True, 0, 1), 3: (False, 0, 0), 4: (False, 0, 0), 5: (False, 0, 0), 6: (False, 0, 0), 7: (False, 0, 0)}
    assert dc.decontaminate(docs(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in dc.decontaminate(docs(spark, rows), bench.limit(0)).collect())


def test_decontamination_of_repeated_slots(spark):
    head, tail = "which of the numbers below in our little series ", " comes right before the one that ends it"
    runs = ["2, 4, 6, 8, 10, 12, 14", "we met Alice, Bob, Carol, Dave, Erin, Frank", "find 3 x 4 x 5 x 6 x 7"]
    items = [*(head + r + tail for r in runs), runs[0] + ", 16, 18, 20"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = head + "3, 5, 7, 9, 11, 13, 15" + tail
    added = items[0].replace("our little", "our very little")
    rows = [*((i, "well then " + t) for i, t in enumerate(items)), (10, other), (11, head + "5, 4, 5, 8, 10, 4, 14" + tail), (12, "or so " + added)]
    got = {r.doc_id: (r.n_exact, r.n_reparameterised) for r in dc.decontaminate(docs(spark, rows), bench.where("item_id < 3")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (0, 0), 10: (0, 1), 11: (0, 0), 12: (1, 0)}
    assert [r.n_exact for r in dc.decontaminate(docs(spark, [(3, items[3])]), bench.where("item_id = 3")).collect()] == [1]


def test_decontamination_of_names_first_in_sentences_and_of_other_space(spark):
    item = "Tom has 5 apples. Tom gives 2 apples to Mary. Then 'Tom' buys 3 more apples. How many apples does Tom have now?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    swap = item.replace("Tom", "Sam").replace("Mary", "Lucy").replace("5", "9").replace("3", "4")
    wrapped = item.replace("to Mary", "to\nMary").replace("does Tom", "does\n  Tom").replace("Tom has", "Tom\thas")
    torn = swap.replace("Sam gives", "Bob gives")
    rows = [(1, swap), (2, "Read this:\n" + wrapped), (3, item.replace("buys", "gets")), (4, torn), (5, item.replace("buys", "gets").replace("many", "few").replace("gives", "hands"))]
    got = {r.doc_id: (r.n_exact, r.n_reparameterised) for r in dc.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (1, 0), 4: (0, 0), 5: (0, 0)}


def test_decontamination_finds_whole_passages(spark):
    bare = lambda t: f" {' '.join(re.findall(r'\w+', (t or '').lower()))} "
    items = [bare(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, t in table(spark) if any(i in bare(t) for i in items)}
    assert want <= {r.doc_id for r in dc.op9_template_decontamination(spark, SF).where("contaminated").collect()}


def test_toxicity(spark):
    clean = [(i, f"plain words number {i} about rivers and hills and trees") for i in range(0, 300)]
    rude = [(1000 + i, f"plain words number {i} you utter nitwit about hills") for i in range(150)]
    labels = spark.createDataFrame([(d, 0, int(d >= 1000)) for d, _ in clean + rude] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    df = docs(spark, clean + rude + [(None, None), (5000, ""), (4, clean[4][1])])
    got = tox.toxicity(df, labels).collect()
    assert len(got) == len(clean) + len(rude) + 3 and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 5000]
    assert test and all(r.predicted == (r.doc_id >= 1000) for r in test)
    assert tox.toxicity(docs(spark, []), labels).collect() == []
    assert {r.score for r in tox.toxicity(df, labels.limit(0)).collect()} == {0.5}


def plain_ftrl(data, epochs, alpha=tox.ALPHA, beta=tox.BETA, l1=tox.L1, l2=tox.L2):
    """The update of each coordinate by itself; the bias is None."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        penalty = 0.0 if i is None else l1
        return 0.0 if abs(z[i]) <= penalty else -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for buckets, y in data:
            on = [*buckets, None]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in on:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_toxicity_learns_as_plain_python():
    import random

    rng = random.Random(5)
    data = []
    for i in range(120):
        text = " ".join(rng.choices([f"w{k}" for k in range(30)], k=12)) + (" nitwit" if i % 4 == 0 else "")
        data.append((tox.features(text), int(i % 4 == 0)))
    got, want = tox.fitted(data, 4), plain_ftrl([([int(b) for b in x], y) for x, y in data], 4)
    bias = want.pop(None)
    assert got[-1] == pytest.approx(bias, abs=1e-5)
    assert {i for i in want if want[i]} == set(np.flatnonzero(got[:-1]).tolist())
    assert all(got[i] == pytest.approx(w, abs=1e-5) for i, w in want.items())


def test_toxicity_cut():
    def f1(s, y, c):
        return 2 * sum(b for a, b in zip(s, y, strict=True) if a > c) / (sum(a > c for a in s) + sum(y))

    rng = np.random.default_rng(3)
    for n in (2, 5, 40):
        for _ in range(20):
            s, y = rng.integers(0, 6, n).astype(float), rng.integers(0, 2, n)
            cut = tox.best_cut(s, y)
            if len(set(s)) < 2 or len(set(y)) < 2:
                assert cut is None
            else:
                assert f1(s, y, cut) == max(f1(s, y, c + 0.5) for c in set(s) - {s.max()})
    data = [(np.array([i % 7], dtype=np.int64), 1) for i in range(10)]
    assert (tox.calibrated(data, 2, 0.7) == tox.fitted(data, 2)).all() and (tox.calibrated(data[:1], 2, 0.7) == tox.fitted(data[:1], 2)).all()


def test_toxicity_of_one_id_held_by_many_rows_and_of_a_long_text(spark):
    clean = [(i, f"plain words number {i} about rivers and hills and trees") for i in range(200)]
    rude = [(1000 + i, f"plain words number {i} you utter nitwit about hills") for i in range(100)]
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d, _ in clean + rude], "doc_id long, toxic int")
    many = next(d for d, _ in clean if zlib.crc32(str(d).encode()) % 3 != 1)
    once = tox.train(docs(spark, clean + rude), labels)
    again = tox.train(docs(spark, clean + rude + [(many, clean[many][1])] * 2000), labels)
    assert all((a == b).all() for a, b in zip(once, again, strict=True))
    mild, harsh = (f"{t} " * 100_000 for t in (clean[0][1], rude[0][1]))
    got = {r.doc_id: r.predicted for r in tox.toxicity(docs(spark, clean + rude + [(7001, mild), (7002, harsh)]), labels).collect()}
    assert (got[7001], got[7002]) == (0, 1)


def test_toxicity_finds_most_held_out_rows(spark):
    """At sf0.01, labels that it may not learn from: more than half are found, with one false alarm at most."""
    sf = SF.replace("0.001", "0.01")
    got = tox.op10_toxicity_ftrl(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic IS NOT NULL").collect()
    assert sum(r.predicted for r in got if r.toxic == 1) > 0.5 * sum(r.toxic for r in got)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 1


def test_quality_base_statistics(spark):
    texts = [*EDGE, (9, "a\na\n \nb #x<y> | one two three four five one two three four five"), *table(spark)]
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs(spark, texts)).collect())
    want = collections.Counter()
    for d, t in texts:
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, cov = collections.Counter(win), set()
        for i, x in enumerate(win):
            if n[x] > 1:
                cov.update(range(i, i + 5))
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)] += 1
    assert got == want
    assert quality.judge(docs(spark, [])).collect() == []


def test_quality_rejects_outliers_of_its_group(spark):
    rows = [(i, " ".join(f"word{(i * 17 + k * 31) % 997}" for k in range(40 + i % 30)) + ".", "en", "s" if i % 3 else "t") for i in range(300)]
    rows += [(900, "&&& ### %%% *** " * 3 + " ".join(f"ab$%{k}" for k in range(60)), "en", "s"), (901, " ".join(f"tiny{k} one" for k in range(30)), None, None)]
    rows += [(902, " ".join(f"word{k * 31 % 997}" for k in range(50)) + ".", "xx", "own")]
    got = collect(quality.judge(docs(spark, rows)))
    # A row alone in its language is judged by the estimate of all rows.
    assert not got[900]["kept"] and got[902]["kept"] and got[901]["distance"] > got[902]["distance"] > 0
    assert sum(not got[i]["kept"] for i in range(300)) == 0


def brute_verdicts(x, lang, source):
    """Distances by the method of quality.py in numpy. x: features of the rows that pass the base limits."""
    floor, p = np.array(quality.FLOOR), quality.P
    at = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1]
    scatter = lambda c: c + np.diag(floor)
    d2 = lambda f, m, c: np.einsum("ij,ij->i", (f - m) @ np.linalg.inv(scatter(c)), f - m)
    logdet = lambda c: np.linalg.slogdet(scatter(c))[1]

    def step(f, m, c):
        d = d2(f, m, c)
        near = f[d <= at(d, quality.SUBSET)]
        return near.mean(0), np.cov(near.T, bias=True), len(near)

    def mcd(f):
        m = at(f, 0.5)
        s = np.sqrt((1.4826 * at(np.abs(f - m), 0.5)) ** 2 + floor)
        z = (f - m) / s
        clip = np.clip(z, -2, 2)
        starts = [np.eye(p), clip.T @ clip / len(f), p * (z / np.maximum((z**2).sum(1), 1e-9)[:, None]).T @ z / len(f)]
        found = []
        for c in starts:
            e = (m, c * np.outer(s, s), len(f))
            for _ in range(quality.START_STEPS):
                e = step(f, *e[:2])
            found.append(e)
        best = min(found, key=lambda e: logdet(e[1]))
        while logdet((after := step(f, *best[:2]))[1]) < logdet(best[1]) - quality.FALL:
            best = after
        return best

    groups = [np.zeros(len(x), dtype=object), lang, np.array([f"{a}|{b}" for a, b in zip(lang, source, strict=True)], dtype=object)]
    draw = lambda own, n, larger: (n * own + quality.PRIOR * larger) / (n + quality.PRIOR)
    fits = [{g: mcd(x[of == g]) for g in set(of)} for of in groups]
    out = np.zeros(len(x))
    shrunk = {}
    for g in set(groups[2]):
        i = int(np.flatnonzero(groups[2] == g)[0])
        (m0, c0, _), (m1, c1, n1), (m2, c2, n2) = fits[0][0], fits[1][groups[1][i]], fits[2][g]
        shrunk[g] = draw(m2, n2, draw(m1, n1, m0)), draw(c2, n2, draw(c1, n1, c0))
        rows = groups[2] == g
        out[rows] = d2(x[rows], *shrunk[g])
    middle = [{g: (at(out[of == g], 0.5), (of == g).sum()) for g in set(of)} for of in groups]
    scale = np.zeros(len(x))
    for i in range(len(x)):
        (a, _), (b, nb), (c, nc) = middle[0][0], middle[1][groups[1][i]], middle[2][groups[2][i]]
        scale[i] = quality.MEDIAN / max(draw(c, nc, draw(b, nb, a)), 1e-9)
    return out * scale


def test_quality_verdicts_against_numpy(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    stats = quality.statistics(source).where("NOT base_failed").toPandas()
    want = brute_verdicts(stats[[f"f{i}" for i in range(quality.P)]].to_numpy(), stats["lang"].to_numpy(), stats["source"].to_numpy())
    got = collect(quality.judge(source))
    assert len(want) > 100
    for d, w in zip(stats["doc_id"], want, strict=True):
        assert abs(got[d]["distance"] - w) < 1e-6 * max(1, w) and got[d]["kept"] == (w <= quality.CUTOFF)
