"""A search index: postings by word, and words by what is left of them when letters are left out.

Two words within d edits share a text that is left when at most d letters are left out of the first PREFIX letters of
each: an edit costs each of them one letter at most, be it at the end of the prefix. A query thus reads the rows of a
few such texts and of the words found, which stand sorted in the files, and compares no other word.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import haversine_km
from ..plans.staging import staged

PREFIX = 8
MOST_EDITS = 2
#: Lookups of so many words at most are pushed down to the scan as a list.
FEW_WORDS = 500


def edits_allowed(term: str) -> int:
    """None to 2 letters, one to 5, two beyond."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else MOST_EDITS


def shortened(term: str, edits: int) -> set[str]:
    """What is left of a term's prefix without up to `edits` of its letters."""
    p = term[:PREFIX]
    return {"".join(c for i, c in enumerate(p) if i not in out) for n in range(min(edits, len(p)) + 1) for out in combinations(range(len(p)), n)}


def _shortened(term: str) -> Column:
    p = F.substring(term, 1, PREFIX)
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.lit(PREFIX))))
    once = without(p)
    twice = F.flatten(F.transform(F.filter(once, lambda w: w != ""), without))
    return F.array_distinct(F.concat(F.array(p), once, twice))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


@dataclass
class SearchIndex:
    postings: DataFrame  # word, field, key: sorted by word
    shorter: DataFrame  # short, word: sorted by short
    key: str

    @classmethod
    def build(cls, df: DataFrame, key: str, fields: list[str]) -> SearchIndex:
        """Over the words of the fields of df; null fields have none. Rows of the same key count as one."""
        found = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("words")) for f in fields))).alias("f")
        each = df.select(F.col(key).alias("key"), found).select("key", "f.field", F.explode("f.words").alias("word"))
        postings = staged(each.select("word", "field", "key").distinct().repartitionByRange("word", "field", "key").sortWithinPartitions("word", "field", "key"), "postings")
        short = postings.select("word").distinct().select("word", F.explode(_shortened("word")).alias("short"))
        return cls(postings, staged(short.select("short", "word").repartitionByRange("short", "word").sortWithinPartitions("short", "word"), "shortened"), key)

    def matched(self, terms: list[str]) -> DataFrame:
        """(word, term, distance): the indexed words within the edits that each term of a query allows."""
        ask = [(s, t, edits_allowed(t)) for t in terms for s in shortened(t, edits_allowed(t))]
        near = self.shorter.where(F.col("short").isin(sorted({s for s, _, _ in ask})))
        asked = F.broadcast(self.shorter.sparkSession.createDataFrame(ask, "short string, term string, allowed int"))  # a few for each term
        met = near.join(asked, "short").select("word", "term", "allowed").distinct()
        return met.withColumn("distance", F.levenshtein("word", "term")).where("distance <= allowed").select("word", "term", "distance")

    def search(self, query: str, boosts: dict[str, float], size: int = 20, only: DataFrame | None = None) -> DataFrame:
        """(key, score) of the `size` best rows: the best field's boosted share of the query's terms found, an edit costing
        part of a term; ties by key. only: a table whose keys alone may be found."""
        terms = list(dict.fromkeys(query.lower().split()))
        empty = self.postings.select(F.col("key").alias(self.key), F.lit(0.0).alias("score")).limit(0)
        if not terms or not boosts:
            return empty
        found = staged(self.matched(terms), "matched")
        some = [r["word"] for r in found.select("word").distinct().limit(FEW_WORDS + 1).collect()]
        rows = self.postings.where(F.col("field").isin(list(boosts)))
        if len(some) <= FEW_WORDS:
            rows = rows.where(F.col("word").isin(some)) if some else rows.limit(0)
        if only is not None:
            rows = rows.join(only.select(F.col(self.key).alias("key")).distinct(), "key", "left_semi")
        best = rows.join(found, "word").groupBy("key", "field", "term").agg(F.min("distance").alias("d"))
        gain = 1.0 - F.col("d") / (F.length("term") + 1).cast("double")
        boost = F.create_map(*(F.lit(x) for f, b in boosts.items() for x in (f, float(b) / len(terms))))
        scored = best.groupBy("key", "field").agg(F.sum(gain).alias("g")).select("key", (F.col("g") * boost[F.col("field")]).alias("s"))
        out = scored.groupBy("key").agg(F.round(F.max("s"), 6).alias("score")).where("score > 0")
        return out.select(F.col("key").alias(self.key), "score").orderBy(F.desc("score"), self.key).limit(size)


def filtered(df: DataFrame, equal: dict[str, str], lon: float | None = None, lat: float | None = None, km: float | None = None) -> DataFrame:
    """Rows whose columns equal the given texts in any case, and that lie within km of (lon, lat) by lon_e7 and lat_e7."""
    for column, text in equal.items():
        df = df.where(F.lower(F.trim(column)) == text.strip().lower())
    if km is None:
        return df
    return df.where(haversine_km(F.lit(lon), F.lit(lat), F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7) <= km)
