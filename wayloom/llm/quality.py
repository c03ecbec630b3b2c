"""Quality rules: fixed limits, and robust multivariate outliers per language and source, in DataFrame functions only.

Each document is a vector of transformed statistics (FEATURES). For every language and source the minimum covariance
determinant is sought by concentration steps: distances under the present estimate, the SUBSET of rows nearest, their
mean and covariance, again. Each group has three deterministic starts (medians and median deviations; the covariance of
clipped deviations; that of their directions); after START_STEPS the one of least determinant goes on until its
determinant falls no more. Distances are then scaled so that their median is that of chi-squared, and documents beyond
CUTOFF are rejected.

The same is done for each language and for all rows, and a group's estimate is drawn towards its language's, and that
towards the whole, with the weight of PRIOR rows: a source of a few rows is judged mostly by its language.

A group's estimate is a row of sums and approximate quantiles, all summed where the rows are, and rows meet estimates by
a broadcast (behind a count of groups) or salted, so a source with a third of the rows is no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import forget, staged, table

SUBSET = 0.75
#: Concentration steps of every start, and the least fall of the log determinant that counts as one.
START_STEPS, FALL = 2, 0.01
#: Rows that an estimate is drawn towards the larger one with.
PRIOR = 60.0
#: Estimates (some 300 bytes each) of so many groups go to every task; more are joined by group and salt.
BROADCAST_GROUPS, SALTS = 50_000, 64
#: The chi-squared median of six features; and a cutoff far beyond its tail (1e-7 is at 43), as good documents have heavier tails: at sf0.01 it keeps 99 of 100 documents of quality 1.
MEDIAN, CUTOFF = 5.348, 80.0
#: Added to each feature's variance: without it, features that are equal in most rows would make the scatter singular.
FLOOR = [0.04, 0.0025, 0.15, 0.6, 0.15, 0.05]
FEATURES = ["log words", "log mean word length", "symbols", "repeated lines", "capitals", "punctuation"]
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: The columns of an estimate: rows in its subset, mean, and covariance.
ESTIMATE = ["n", *(f"m{i}" for i in range(P)), *(f"c{j}_{i}" for i, j in PAIRS)]

_SPACE = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, grouping columns, the base statistics and features f0.. of every row, written to the shared folder.

    Were it a plan, a filter on a statistic would be pushed through it and copy the array expressions again and again.
    """
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    length = lambda drop: F.length(F.regexp_replace("text", drop, ""))
    split_ = source.select("doc_id", "lang", "source", _words(F.col("text")).alias("words"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, _SPACES, "") != "").alias("lines"),
        length(r"[^\p{Lu}]++").alias("upper"), length(r"[^\p{L}]++").alias("letters"), length(r"[\p{L}\p{N}\s#*$%&|<>]++").alias("marks"))
    n = F.size("words")
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(F.slice("words", i + 1, 5)))).otherwise(F.array().cast("array<bigint>"))
    counted = split_.select("doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"), "upper", "letters", "marks", hashes.alias("h"))
    # Only a text with equal windows is sorted to find where they are.
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    ranked = counted.withColumn("s", pairs).drop("h")
    same = lambda x, j: F.coalesce(F.get(F.col("s"), j)["h"] == x["h"], F.lit(False))
    twice = ranked.withColumn("at", F.array_sort(F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("s")
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(5))).alias("n"))
    based = twice.withColumn("n_repeat_words", F.aggregate("at", start, step, lambda acc: acc["n"])).drop("at")
    share = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    features = [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("upper", "letters"),
        share("marks", "word_chars"),
    ]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    cols = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return staged(based.select(*cols, failed.alias("base_failed"), *(f.alias(f"f{i}") for i, f in enumerate(features))), "statistics")


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _pools(rows: DataFrame) -> DataFrame:
    """Every row in its three groups grp: all (level 0), its language (1), its language and source (2)."""
    none = F.lit("")
    of = [(none, none), (F.col("lang"), none), (F.col("lang"), F.col("source"))]
    grp = F.array(*(F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in enumerate(of)))
    return rows.select(F.explode(grp).alias("grp"), *(f"f{i}" for i in range(P)))


def _meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of groups (a few rows for each grp)."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "grp")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "grp")), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["grp", "salt"]).drop("salt")


def _inverse(estimate: DataFrame, floor: list[float]) -> DataFrame:
    """estimate with w<i>_<j>, the inverse of its scatter's Cholesky factor, and logdet, the scatter's log determinant."""
    df = estimate
    for i in range(P):
        for j in range(i + 1):
            s = F.col(f"c{j}_{i}") + (F.lit(floor[i]) if i == j else F.lit(0.0)) - (_total([F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)]) if j else F.lit(0.0))
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l{j}_{j}"))
    for i in range(P):
        for j in range(i + 1):
            s = 1.0 / F.col(f"l{i}_{i}") if i == j else -_total([F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)]) / F.col(f"l{i}_{i}")
            df = df.withColumn(f"w{i}_{j}", s)
    df = df.withColumn("logdet", 2.0 * _total([F.log(f"l{i}_{i}") for i in range(P)]))
    return df.select(*estimate.columns, "logdet", *(f"w{i}_{j}" for i, j in PAIRS))


def _d2() -> Column:
    """The squared Mahalanobis distance of f0.. from m0.. under w."""
    y = [_total([F.col(f"w{i}_{j}") * (F.col(f"f{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in range(P)]
    return _total([v * v for v in y])


def _starts(rows: DataFrame, floor: list[float]) -> DataFrame:
    """grp, start and the estimate's columns, three for each group of rows(grp, f0..)."""
    middle = staged(rows.groupBy("grp").agg(*(F.percentile_approx(f"f{i}", 0.5, 1000).alias(f"m{i}") for i in range(P))), "middle")
    spread = _meet(rows, middle).groupBy("grp").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *(F.percentile_approx(F.abs(F.col(f"f{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(P)))
    spread = spread.select("grp", *(f"m{i}" for i in range(P)), *(F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2.0) + F.lit(floor[i])).alias(f"s{i}") for i in range(P)))
    spread = staged(spread, "spread")
    z = _meet(rows, spread).select("*", *(((F.col(f"f{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)))
    z = z.withColumn("zz", F.greatest(_total([F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]), F.lit(1e-9)))
    clip = lambda i: F.greatest(F.least(F.col(f"z{i}"), F.lit(2.0)), F.lit(-2.0))
    both = z.groupBy("grp").agg(F.count("*").cast("double").alias("n"), *(F.first(c).alias(c) for c in spread.columns if c != "grp"),
        *(F.avg(clip(i) * clip(j)).alias(f"a{j}_{i}") for i, j in PAIRS), *(F.avg(P * F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"b{j}_{i}") for i, j in PAIRS))
    both = staged(both, "directions")
    mean = [F.col(f"m{i}") for i in range(P)]

    def start(k: int, c) -> DataFrame:
        return both.select("grp", F.lit(k).alias("start"), "n", *mean, *((c(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{j}_{i}") for i, j in PAIRS))

    return start(0, lambda i, j: F.lit(1.0 if i == j else 0.0)).union(start(1, lambda i, j: F.col(f"a{j}_{i}"))).union(start(2, lambda i, j: F.col(f"b{j}_{i}")))


def _step(rows: DataFrame, estimate: DataFrame, subset: float, floor: list[float]) -> DataFrame:
    """The estimates after a concentration step. estimate: grp, start, ESTIMATE, logdet and w."""
    limit = _meet(rows, estimate).groupBy("grp", "start").agg(F.percentile_approx(_d2(), subset, 1000).alias("limit"))
    limited = staged(estimate.join(limit, ["grp", "start"]), "limits")
    near = _meet(rows, limited).where(_d2() <= F.col("limit"))
    y = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(P)]  # sums about the last mean keep their digits
    sums = near.groupBy("grp", "start").agg(F.count("*").cast("double").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *(F.avg(y[i]).alias(f"y{i}") for i in range(P)), *(F.avg(y[i] * y[j]).alias(f"q{j}_{i}") for i, j in PAIRS))
    moved = sums.select("grp", "start", "n", *((F.col(f"m{i}") + F.col(f"y{i}")).alias(f"m{i}") for i in range(P)), *((F.col(f"q{j}_{i}") - F.col(f"y{i}") * F.col(f"y{j}")).alias(f"c{j}_{i}") for i, j in PAIRS))
    out = staged(_inverse(moved, floor), "estimate")
    forget(limited)
    return out


def estimates(rows: DataFrame, subset: float = SUBSET, floor: list[float] = FLOOR) -> DataFrame:
    """grp, ESTIMATE and logdet of each group of rows(grp, f0..), of least determinant among its starts and their steps."""
    now = staged(_inverse(_starts(rows, floor), floor), "estimate")
    for _ in range(START_STEPS):
        now = _step(rows, now, subset, floor)
    best = now.groupBy("grp").agg(F.min_by(F.struct("start", *now.columns[2:]), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    open_, ended = staged(best, "best"), []
    # A determinant that must fall by FALL each time, and has a least value through the floor, comes to rest.
    while not open_.isEmpty():
        after = _step(rows, open_, subset, floor)
        fell = after.join(open_.select("grp", F.col("logdet").alias("was")), "grp").where(F.col("logdet") < F.col("was") - FALL).select(*after.columns)
        fell = staged(fell, "fell")
        ended.append(open_.join(fell.select("grp"), "grp", "left_anti"))
        open_ = fell
    done = reduce(DataFrame.union, ended) if ended else open_
    return staged(done.select("grp", *ESTIMATE, "logdet"), "estimates")


def _drawn(own: DataFrame, larger: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """own's cols, drawn towards larger's with the weight of PRIOR rows. Both: key, n, cols."""
    far = larger.select(*key, *(F.col(c).alias(f"_{c}") for c in cols))
    near = own.join(far, key) if key else own.crossJoin(far)  # one row for all
    others = [c for c in own.columns if c not in cols]
    return near.select(*others, *(((F.col("n") * F.col(c) + PRIOR * F.col(f"_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in cols))


def _by_level(found: DataFrame) -> list[DataFrame]:
    rest = [c for c in found.columns if c != "grp"]
    keys = [[], ["lang"], ["lang", "source"]]
    return [found.where(F.col("grp.level") == k).select(*(F.col(f"grp.{c}").alias(c) for c in keys[k]), *rest) for k in range(3)]


def _shrunk(found: DataFrame, cols: list[str]) -> DataFrame:
    """lang, source, n and cols of the groups by language and source."""
    whole, language, own = _by_level(found.select("grp", "n", *cols))
    return _drawn(own, _drawn(language, whole, [], cols), ["lang"], cols)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row of
    documents (doc_id, text, lang, source).

    A null text is empty, a null lang or source is the empty one. Rows that fail the base limits take no part in the
    estimates and have no distance. Repeated rows and ties are judged alike; a distance at the cutoff is kept. Texts of
    any length are read whole. An empty table gives no rows. Other columns are not read.
    """
    stats = statistics(docs)
    fit = _pools(stats.where("NOT base_failed"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = _shrunk(estimates(fit), ESTIMATE[1:])
    grp = F.struct(F.lit(2).alias("level"), "lang", "source").alias("grp")
    own = staged(_inverse(own.select(grp, *ESTIMATE), FLOOR), "shrunk")
    far = _meet(stats.where("NOT base_failed").select("lang", grp, *(f"f{i}" for i in range(P))), own).select("lang", "grp", _d2().alias("d2"))
    none = F.lit("")
    levels = F.array(F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")), F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")), F.col("grp"))
    middle = far.select(F.explode(levels).alias("grp"), "d2").groupBy("grp").agg(F.count("*").cast("double").alias("n"), F.percentile_approx("d2", 0.5, 1000).alias("middle"))
    scale = _shrunk(staged(middle, "middles"), ["middle"]).select(grp, (F.lit(MEDIAN) / F.greatest("middle", F.lit(1e-9))).alias("scale"))
    known = staged(own.join(scale, "grp").drop("n", "logdet"), "known")
    fair = _meet(stats.where("NOT base_failed").select(*base, grp, *(f"f{i}" for i in range(P))), known).withColumn("distance", _d2() * F.col("scale"))
    failed = stats.where("base_failed").select(*base, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return fair.select(*base, (F.col("distance") <= cutoff).alias("kept"), "distance").union(failed)


def op5_robust_outliers(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
