"""Personal data: fixed patterns, and terms that reveal what they protect, in DataFrame functions only.

Every distinct e-mail address, IP address, card and phone number found is a protected entity. A term near its mentions
reveals it as far as the two occur together more often than apart: the pointwise mutual information of entity and term
over the corpus, as a share of the entity's own information,

    [log2(n(e, t) / n(e)) + log2(N / df(t))] / log2(N / n(e)),

with n counting different contexts of the entity, df documents with the term and N documents. A context is what stands
within CONTEXT_CHARS of a mention, and also the whole document, where documents in which the entity's mentions all read
the same count once; the larger share holds. A term at DISCLOSURE or more, seen in MIN_CONTEXTS contexts or more, is a
span of kind `term` wherever it stands in a document that holds the entity.
Sanitising generalises numbers among them to [NUMBER] and other words to [TERM], and removes a term that alone
determines the entity (a share of REMOVAL or more).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import staged, table
from .names import fresh

KINDS = ["email", "ip", "card", "phone", "term"]
CONTEXT_CHARS = 80
MIN_CONTEXTS = 3
DISCLOSURE = 0.8
REMOVAL = 0.98

#: Terms that go to all tasks at most where documents are counted; more are looked up after counting.
BROADCAST_TERMS = 200_000

#: Matches of a text that are added to one short array.
BLOCK = 128

_OPEN, _CLOSE = "\u0001", "\u0002"
_TERM = r"[\p{L}\p{N}]{3,}+"

# The contract's patterns. Possessive where what follows cannot give back, and started only where a run starts (or a
# match has just ended), so that long runs take linear time and no recursion; the matches are the same.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _marked(text: Column, pattern: str | Column, needs: str | None = None) -> Column:
    """The matches as an array of (s, e, m): start and end in code points, and the text matched."""
    safe = F.translate(text, _OPEN + _CLOSE, "\u0003\u0003")
    parts = F.split(F.regexp_replace(safe, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)
    if needs:
        parts = F.when(F.contains(text, F.lit(needs)), parts).otherwise(F.array(F.lit("")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def add(acc: Column, part: Column) -> Column:
        m = F.substring_index(part, _CLOSE, 1)
        end = acc["at"] + F.length(m)
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), end.alias("e"), m.alias("m")))).alias("out"))

    # An array grows by copying, so matches are added to short ones, block by block.
    def add_block(acc: Column, b: Column) -> Column:
        block = F.aggregate(F.slice(rest, b * BLOCK + 1, BLOCK), F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return F.get(F.transform(F.array(block), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), F.lit(0))

    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    start = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string>>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / BLOCK).cast("int"))
    return F.when(F.size(parts) > 1, F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 1, x).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3
        value = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda x: small(x) & (F.when(small(x), value(x)).otherwise("999").cast("int") <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans that hold, as an array of (s, e, m)."""

    def held(kind: str, pattern: str) -> Column:
        return F.filter(_marked(text, pattern, _NEEDS.get(kind)), lambda x: _valid(kind, x["m"]))

    return {k: held(k, p) for k, p in _PATTERNS.items()}


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed. spans: array of (s, k, e)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), n_<kind>, base: array of (s, k, e), entities: (s, e, v, lo, left, right) with the
    protected value and what stands around it with base spans blanked, n_chars, and masked: the text without its base spans where it has any."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    spans = source.select("doc_id", "row", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    value = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}

    def placed(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    def entity(kind: str) -> Column:
        lo = lambda x: F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit(f"{kind}:"), value[kind](x["m"])).alias("v"), lo(x).alias("lo"),
            F.substring("masked", lo(x) + 1, x["s"] - lo(x)).alias("left"), F.substring("masked", x["e"] + 1, F.lit(CONTEXT_CHARS)).alias("right")))

    base = F.concat(*(placed(i, k) for i, k in enumerate(_PATTERNS)))
    entities = F.concat(*map(entity, _PATTERNS))
    based = spans.withColumn("base", base)
    blank = based.withColumn("masked", F.when(F.size("base") > 0, _masked(F.col("text"), F.col("base"))))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in _PATTERNS]
    return blank.select("doc_id", "row", *counts, "base", entities.alias("entities"), F.length("masked").alias("n_chars"), "masked")


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks in place of its base spans; other positions stay."""

    def add(acc: Column, x: Column) -> Column:
        at = F.greatest(acc["at"], x["s"])
        blank = F.concat(acc["out"], F.substring(text, acc["at"] + 1, at - acc["at"]), F.repeat(F.lit(" "), F.greatest(x["e"] - at, F.lit(0))))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), blank.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(base), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, end)


def _together(holders: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, n_both) and (entity, n_entity) over whole documents. holders: row, entity, context; texts: row, text."""
    own = holders.groupBy("entity").agg(F.countDistinct("context").alias("n_entity"))
    # An entity with fewer contexts has no term with enough of them.
    many = holders.join(own.where(F.col("n_entity") >= MIN_CONTEXTS).select("entity"), "entity", "left_semi")
    words = F.array_distinct(F.transform(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: F.lower(w)))
    each = texts.join(many.select("row").distinct(), "row", "left_semi").select("row", F.explode(words).alias("term")).where(F.length("term") >= 3)
    counted = many.join(each, "row").groupBy("entity", "term", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    return counted.where(F.col("n_both") >= MIN_CONTEXTS), own


def _document_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term stands. wanted (term) may leave out others, but need not.

    Counted where the texts are, so that one row a term and task is shuffled. A semi join on the counts would be moved
    below them by Spark and shuffle every word of every text, so few terms go to the tasks and many are not filtered.
    """
    # Lower case is made term by term: on a whole text with letters beyond ASCII it is far slower.
    split = F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"))
    words = docs.select(F.explode(F.array_distinct(F.transform(split, lambda w: F.lower(w)))).alias("term"))
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    return words.groupBy("term").agg(F.count("*").alias("df"))


def disclosing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, s, e, share): the terms that reveal an entity of their document, with the largest share of its information."""
    held_in = spans.where(F.size("entities") > 0).dropDuplicates(["row"])  # of equal rows one
    near = held_in.select("row", "n_chars", F.explode("entities").alias("m"))
    context = F.xxhash64(F.lower(F.regexp_replace(F.concat("m.left", F.lit(" "), "m.right"), r"[^\p{L}\p{N}]+", " ")))
    left, right = F.struct(F.col("m.lo").alias("at"), F.col("m.left").alias("t")), F.struct(F.col("m.e").alias("at"), F.col("m.right").alias("t"))
    sides = near.select("row", F.col("m.v").alias("entity"), F.col("n_chars").alias("n"), context.alias("context"), F.explode(F.array(left, right)).alias("side"))
    terms = sides.select("row", "entity", "n", "context", F.col("side.at").alias("at"), F.length("side.t").alias("len"), F.explode(_marked(F.col("side.t"), _TERM)).alias("x"))
    # A term cut by the context's edge is no whole word.
    whole = ((F.col("x.s") > 0) | (F.col("at") == 0)) & ((F.col("x.e") < F.col("len")) | (F.col("at") + F.col("len") == F.col("n")))
    s, e = F.col("at") + F.col("x.s"), F.col("at") + F.col("x.e")
    terms = staged(terms.where(whole).select("row", "entity", "context", F.lower("x.m").alias("term"), s.alias("s"), e.alias("e")), "terms")
    joint = terms.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= MIN_CONTEXTS)
    held = staged(near.select("row", F.col("m.v").alias("entity"), context.alias("context")).distinct(), "held")
    own = held.groupBy("entity").agg(F.countDistinct("context").alias("n_entity"))
    holders = held.groupBy("row", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("context"))).alias("context"))
    masked = held_in.select("row", F.col("masked").alias("text"))
    whole_joint, whole_own = _together(holders, masked)
    joint = staged(joint.join(own, "entity").union(whole_joint.join(whole_own, "entity")), "joint")
    total = spans.count()
    wanted = joint.select("term").distinct()
    if joint.isEmpty():
        df = wanted.withColumn("df", F.lit(1).cast("long"))
    else:
        df = _document_counts(docs, staged(wanted, "wanted"))
    info = F.log2(F.lit(float(max(total, 2))) / F.col("n_entity"))
    share = F.try_divide(F.log2(F.col("n_both") / F.col("n_entity")) + F.log2(F.lit(float(max(total, 2))) / F.col("df")), info)
    revealing = joint.join(df, "term").where(info > 0).select("entity", "term", share.alias("share")).where(F.col("share") >= DISCLOSURE)
    revealing = staged(revealing.groupBy("entity", "term").agg(F.max("share").alias("share")), "revealing")
    close = terms.join(revealing, ["entity", "term"]).select("row", "s", "e", "share")
    sought = holders.join(revealing, "entity").groupBy("row", "term").agg(F.max("share").alias("share")).join(masked, "row")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), "term", F.lit(r"(?![\p{L}\p{N}])"))
    anywhere = sought.select("row", "share", F.explode(_marked(F.col("text"), pattern)).alias("x")).select("row", "x.s", "x.e", "share")
    return close.union(anywhere).groupBy("row", "s", "e").agg(F.max("share").alias("share"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_<kind>, base: array of (s, k, e), terms: array of (s, k, e, share), empty where there is none."""
    spans = staged(found(docs), "private")
    terms = disclosing_terms(docs, spans).groupBy("row").agg(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e", "share")).alias("terms"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,share:double>>")
    return spans.drop("entities", "n_chars", "masked").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of documents (doc_id, text).

    A null text is empty and has no spans. Repeated rows get the same spans (and are one context). An empty table
    gives no rows. Columns other than doc_id and text are not read.
    """
    out = private_spans(docs)
    plain = F.transform("terms", lambda t: F.struct(t["s"].alias("s"), t["k"].alias("k"), t["e"].alias("e")))
    counts = [f"n_{k}" for k in _PATTERNS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", plain)).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with `text` where [EMAIL], [IP], [CARD], [PHONE], [NUMBER] and [TERM] stand for the spans; a null text stays null.

    Spans that overlap become one placeholder, that of the first. All columns and rows are kept.
    """
    row, own, more = fresh(docs, "_row", "_base", "_terms")
    spans = private_spans(docs).where("size(base) + size(terms) > 0").select(F.col("row").alias(row), F.col("base").alias(own), F.col("terms").alias(more)).dropDuplicates([row])
    joined = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(spans, row, "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("text")
    base = F.transform(own, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.element_at(names, x["k"] + 1).alias("put")))

    def general(x: Column) -> Column:
        digits = F.regexp_replace(F.substring(text, x["s"] + 1, x["e"] - x["s"]), "[0-9]", "") == ""
        return F.when(x["share"] >= REMOVAL, F.lit("")).when(digits, F.lit("[NUMBER]")).otherwise(F.lit("[TERM]"))

    terms = F.transform(more, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), general(x).alias("put")))

    def add(acc: Column, x: Column) -> Column:
        put = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["put"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), put.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate(F.array_sort(F.concat(base, terms)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, end)
    return joined.withColumn("text", F.when(F.col(own).isNull(), text).otherwise(clean)).select(docs.columns)


def op7_pii_disclosure(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
