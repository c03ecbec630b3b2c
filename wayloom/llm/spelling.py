"""Spelling variants: words one edit apart, found through a positional q-gram index and its count filter.

Words go to small groups first: of two words one edit apart, with c and c or c + 1 letters, the first c // 2 letters or
the last c - c // 2 are the same, so a word is in four groups, by class c and by side. A group of more than GROUP words
is cut again by the same rule for what is left of its words, until groups are small or at most one letter is left of
the shorter words; no pair is lost by a cut. In a group's task the words' padded bigrams with their places are an
inverted index. One edit leaves all but two of a word's bigrams, each at most one place away, so a partner stands in
the postings of some of its three rarest bigrams: those are merged with a heap, counts are completed from the longer
postings, pairs under the bound go, and the rest are compared letter by letter.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import staged, table

#: Words of a group that one task compares; larger groups are cut.
GROUP = 300
#: A pair of words one edit apart differs in so many of a word's padded bigrams at most.
LOST = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(docs: DataFrame, least: int = 5, every: int = 97) -> DataFrame:
    """(word) for each run of letters of docs (doc_id, text), A-Z in lower case, of `least` letters or more.

    A run whose crc32 with its doc_id is divisible by `every` lacks one letter, at the remainder of the crc32 by its
    length. Null texts have no words; a null doc_id counts as empty text.
    """
    found = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), found.alias("run"))
    runs = runs.select("d", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2))")
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def _sides(rows: DataFrame) -> DataFrame:
    """Each row (key, word, n, rest, c) in the two groups of its class c: what is left of its word has c or c + 1 letters."""
    m = F.floor(F.col("c") / 2).cast("int")
    left = lambda n: F.substring("rest", F.lit(1), n)
    begin = F.struct(F.concat("key", F.lit(">"), left(m)).alias("key"), F.substring("rest", m + 1, F.length("rest")).alias("rest"), (F.col("c") - m).alias("c"))
    kept = F.length("rest") - (F.col("c") - m)
    end = F.struct(F.concat("key", F.lit("<"), F.substring("rest", kept + 1, F.length("rest"))).alias("key"), left(kept).alias("rest"), m.alias("c"))
    return rows.withColumn("s", F.explode(F.array(begin, end))).select("s.key", "word", "n", "s.rest", "s.c")


def _alike(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_in_group(rests: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs (i, j), j before i, one edit apart, of texts of c letters followed by texts of c + 1; not those of c + 1 with each other."""
    c = len(rests[0])
    index: dict[tuple[str, int], list[int]] = {}
    for i, rest in enumerate(rests):
        padded = f">{rest}<"
        grams = [(padded[k : k + 2], k) for k in range(len(padded) - 1)]
        bound = len(grams) - LOST
        if bound <= 0:  # at most one letter: any other such text is one edit away
            yield from ((i, j) for j in range(i) if len(rests[j]) == c and _alike(rests[j], rest))
        else:
            slots = []
            for g, k in grams:
                lists = [x for x in (index.get((g, k - 1)), index.get((g, k)), index.get((g, k + 1))) if x]
                slots.append((sum(map(len, lists)), lists))
            slots.sort(key=lambda s: s[0])
            longer = [lists for n, lists in slots[LOST + 1 :] if n]
            for j, same in groupby(heapq.merge(*(x for _, lists in slots[: LOST + 1] for x in lists))):
                count = sum(1 for _ in same)
                if count + len(longer) < bound:
                    continue
                count += sum(any((p := bisect_left(x, j)) < len(x) and x[p] == j for x in lists) for lists in longer)
                if count >= bound and _alike(rests[j], rest):
                    yield i, j
        if len(rest) == c:
            for g in grams:
                index.setdefault(g, []).append(i)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rest, word, n) sorted by key and length of rest, as pairs of words; a group may span batches."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "c", "rest", "word", "n")), strict=True))
    out: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["a", "a_n", "b", "b_n"])
    for _, group in groupby(rows, lambda r: r[0]):
        first = next(group)
        members = [first, *group]
        if len(members) > 1 and len(first[2]) == first[1]:  # else no shorter text is there
            out += [(*members[i][3:], *members[j][3:]) for i, j in near_in_group([m[2] for m in members])]
        if len(out) >= 10_000:
            yield made()
            out = []
    if out:
        yield made()


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of distinct words (word, n) exactly one edit apart, once. Words are unique and not null."""
    size = F.length("word")
    classes = words.where(size > 0).select("word", "n", F.col("word").alias("rest"), F.explode(F.array(size, size - 1)).alias("c"))
    rows = _sides(classes.select(F.col("c").cast("string").alias("key"), "word", "n", "rest", "c"))
    small = None
    while True:
        hot = staged(rows.where("c > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("key"), "hot_groups")
        some = hot.isEmpty()
        left = rows if some else rows.join(hot, "key", "left_anti")
        small = left if small is None else small.union(left)
        if some:
            break
        rows = _sides(rows.join(hot, "key", "left_semi"))
    dealt = small.repartition("key").sortWithinPartitions("key", F.length("rest"), "word")
    found = dealt.mapInArrow(_pairs, "a string, a_n long, b string, b_n long")
    return found.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()


def _follow(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends, by pointer doubling. Each form is more frequent, so there is no circle."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = staged(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of unique words (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least ratio times
    its own; root is where forms lead to.
    """
    words = words.select("word", "n")
    pairs = staged(near_words(words), "near_words")
    one = lambda a, b: pairs.select(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.struct((-F.col(f"{b}_n")).alias("n"), F.col(b).alias("word")).alias("other"))
    near = one("a", "b").union(one("b", "a")).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("other").alias("m"))
    formed = -F.col("m.n") >= ratio * F.col("n")
    near = staged(near.select("word", "n_near", F.when(formed, F.col("m.word")).alias("form"), F.when(formed, -F.col("m.n")).alias("form_n")), "near")
    roots = _follow(near.where("form IS NOT NULL").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def vocabulary(docs: DataFrame, least_n: int = 3, **rule) -> DataFrame:
    """(word, n): the distinct words of docs (doc_id, text) found least_n times or more in all; see words_of."""
    return words_of(docs, **rule).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(staged(vocabulary(table(spark, sf_dir, "documents")), "words"))


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
OP12_SQL = f"""WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents) r GROUP BY ALL),
 bytes AS (SELECT run, m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
 crcs AS MATERIALIZED (SELECT run, m, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, t.tab[xor(c, b) % 256 + 1])), 4294967295) AS h FROM bytes, (SELECT {_CRC_TABLE} AS tab) t),
 voc AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crcs) w WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
 cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS k FROM voc, LATERAL (SELECT unnest(range(length(word))) AS i) g),
 longer AS (SELECT v.word AS a, v.n AS an, c.word AS b, c.n AS bn FROM voc v JOIN cut c ON v.word = c.k),
 near AS MATERIALIZED (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION SELECT a, an, b, bn FROM longer UNION SELECT b, bn, a, an FROM longer),
 best AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, arg_min(b, r) AS form, max(bn) AS form_n, any_value(an) AS n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS r FROM near) q GROUP BY a),
 formed AS MATERIALIZED (SELECT word, form, form_n FROM best WHERE form_n >= 2 * n),
 walk AS (SELECT word, form AS root FROM formed UNION SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root),
 roots AS (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM formed))
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, f.form_n FROM voc v LEFT JOIN best b USING (word) LEFT JOIN formed f USING (word) LEFT JOIN roots r USING (word)"""
