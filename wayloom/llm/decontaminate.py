"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names (capitalised words, at a sentence's start other than PLAIN) and units become typed placeholders; the other words are in lower
case without punctuation. White space of any kind and length parts words alike. Windows of WINDOW template words are
hashed and joined with the benchmark's. The values under the placeholders are slots: along one alignment of a document with an item, a slot value of the item must always stand
for the same value of the document and the other way round. A document holds an item if an alignment's windows cover at
least COVERAGE of the item's words and its slots are consistent; equal slots are a copy, others a re-parameterised question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.staging import staged, table

WINDOW = 5
COVERAGE = 0.8
#: An alignment may shift by this many words in all (a word added or left out on the way).
SLACK = 4
#: One way to lay an item on a document.
ALIGNMENT = ["row", "item_id", "way", "at"]
#: Benchmark windows up to this many bytes (with their slots) go to every task; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

# Units, as written after a number.
UNITS = "km cm mm kg mg ml ms mph kmh km/h kwh mb gb tb hz khz mhz m g l s h min sec hours hour days day weeks week months month years year minutes minute seconds second miles mile meters metres meter metre feet foot inches inch pounds pound dollars dollar euros euro cents percent degrees liters litres liter litre grams gram kilograms kilometers kilometres usd eur".split()
# Fixed words that begin sentences and are no names there; inside a sentence any capitalised word is one.
PLAIN = "The This That These Those An All Any Both Each Every Either Neither No Some Many Much Most More Several Such Other Another One Two Three He She It We You They His Her Its Our Your Their There Here Who Whom Whose What Which When Where Why How If Unless Until While Whereas Although Though Because Since So Then Thus Hence Therefore However But And Or Nor Not Yet As At By For From In Into Of Off On Onto Out Over Under Up Down To With Within Without About Above After Again Against Before Below Between During Through Also Once Now Later Next Finally First Second Third Is Are Was Were Be Been Do Does Did Has Have Had Can Could May Might Must Shall Should Will Would Let Given Suppose Assume Consider Find Calculate Compute Determine Solve Show Prove Explain Give Name Choose Select Answer Write Please Only Even Still Just Than Der Die Das Den Dem Ein Eine Und Oder Wenn Wie Was Wer Wo Warum Ist Sind Er Sie Es Wir Ihr Im Mit Von Zu Auf Für Nach Le La Les Un Une Des Du De Et Ou Si Qui Que Quel Quelle Comment Il Elle Ils Elles Nous Vous On Dans Pour Avec Par Sur El Los Las Una Uno Unos Unas Del Y Con Por Para En Se Su Sus Qué Cuál Cómo Cuando Cuántos Cuántas".split()

_PLAIN = "|".join(dict.fromkeys(w for w in PLAIN if len(w) > 1))
_UNIT = "|".join(sorted((u.replace("/", "\\/") for u in UNITS), key=len, reverse=True))
_NUMBER = r"[-+]?[$€£]?[0-9]++(?:[.,:\/][0-9]++)*+[%°€$]?"


def _marked(text: Column) -> Column:
    """A text (null: empty) with marks before its placeholders' values, and spaces for what parts words or is no part of one.

    Each pattern first looks at one character, so that it gives up at once nearly everywhere.
    """
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?: (?=[\s\u0001-\u0003])|[^\S ]|[\u0001-\u0003])[\s\u0001-\u0003]*+", " ")
    apart = lambda t: F.regexp_replace(t, rf"(?=[-+$€£0-9])(?<![\p{{L}}\p{{N}}])({_NUMBER})(?=(?:{_UNIT})(?![\p{{L}}\p{{N}}]))", "$1 ")
    named = lambda t: F.regexp_replace(t, rf"(?=\p{{Lu}})(?:(?<=[\p{{L}}\p{{N}},;] )|(?<![\p{{L}}\p{{N}}\p{{M}}])(?<![\p{{L}}\p{{N}}\p{{M}}]['’-])(?!(?:{_PLAIN})(?!\p{{L}})))(\p{{Lu}}\p{{Ll}}++)(?!\p{{Lu}})", "\u0001$1")
    numbered = lambda t: F.regexp_replace(t, rf"(?=[-+$€£0-9])(?<![\p{{L}}\p{{N}}\u0001])({_NUMBER})(?![\p{{L}}\p{{N}}])", "\u0002$1")
    units = lambda t: F.regexp_replace(t, rf"(\u0002\S++ )((?i:{_UNIT}))(?![\p{{L}}\p{{N}}])", "$1\u0003$2")
    # A text without digits has no numbers and so no units. The array holds one text, which is so made once.
    both = lambda t: F.when(F.rlike(t, F.lit("[0-9]")), units(numbered(named(apart(t))))).otherwise(named(t))
    marked = F.get(F.transform(F.array(safe), both), F.lit(0))
    # Quotation marks before a placeholder go. Inside a number its signs stay; elsewhere what is no letter, digit or mark parts words or goes.
    return F.regexp_replace(marked, r"(?![a-zA-Z0-9 ])(?:[^\p{L}\p{N}\p{M}\s\u0001-\u0003'’.,:$€£%°\/+-]++|(?<![0-9$€£])[.,:$€£\/+](?![0-9])|(?<=[0-9%°])[.,:\/+-]++(?![0-9])|(?<![\p{L}\p{N}\p{M}])['’-]++(?=[\u0001\u0002]))", " ")


def _kind(w: Column) -> Column:
    """The template word of one of _marked's words: a placeholder, or the word in lower case without punctuation ("" if it has no more).

    Lower case is made word by word: on a whole text with letters beyond ASCII it costs more than all patterns.
    """
    return F.when(w >= "\u0004", F.translate(F.lower(w), "'’.,:$€£%°/+-", "")).when(w < "\u0001", F.lit("")).when(w < "\u0002", F.lit("<name>")).when(w < "\u0003", F.lit("<number>")).otherwise(F.lit("<unit>"))


def _value(w: Column) -> Column:
    """The value of a placeholder in lower case, null for other words."""
    return F.when(w < "\u0004", F.translate(F.lower(w), "\u0001\u0002\u0003'’", ""))


def _windows_of(t: str) -> Column:
    """The hashes of the windows over the words' hashes t; one short window if there are fewer words."""
    at = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.greatest(F.size(t) - WINDOW, F.lit(0))))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(WINDOW))))


def places(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each window: key, pos (from 0), h."""
    hashed = F.transform(F.split(_marked(F.col("text")), " "), lambda w: F.xxhash64(_kind(w)))
    # No filter on the size: pushed below the projection, it would make every template twice.
    parts = df.select(*key, F.filter(hashed, lambda h: h != F.xxhash64(F.lit(""))).alias("t"))
    return parts.select(*key, F.posexplode(_windows_of("t")).alias("pos", "h"))


def windows(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each window: key, pos (from 0), h, slots (for each of its words the placeholder's value, or null)."""
    parts = df.select(*key, F.filter(F.transform(F.split(_marked(F.col("text")), " "), lambda w: F.struct(_kind(w).alias("t"), _value(w).alias("v"))), lambda x: x["t"] != "").alias("w"))
    parts = parts.select(*key, F.transform("w.t", lambda t: F.xxhash64(t)).alias("t"), F.col("w.v").alias("v"))
    listed = parts.select(*key, "v", _windows_of("t").alias("h")).select(*key, F.posexplode(F.transform("h", lambda h, i: F.struct(h.alias("h"), F.slice("v", i + 1, WINDOW).alias("slots")))).alias("pos", "x"))
    return listed.select(*key, "pos", F.col("x.h").alias("h"), F.col("x.slots").alias("slots"))


def _aligned(hits: DataFrame) -> DataFrame:
    """hits(pos, ipos, ..) with line, the item's place in the document, in steps of SLACK, each hit in the two steps around it."""
    shift = F.floor((F.col("pos") - F.col("ipos")) / SLACK)
    return hits.withColumn("line", F.explode(F.array(shift, shift + 1)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, n_matched, n_words, same_values) for the items that a document holds; row is docs' key column.

    All documents are read for where windows hit; only those that cover an item are read again for their slots.
    """
    items = staged(windows(benchmark.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")), ["item_id"]).withColumn("w", F.size("slots")), "benchmark")
    totals = items.groupBy("item_id").agg(F.max(F.col("pos") + F.col("w")).alias("n_words"))
    size = items.agg(F.sum(40 + 16 * F.col("w") + F.octet_length(F.array_join("slots", ""))).alias("n")).first()["n"]
    small = F.broadcast if (size or 0) <= BROADCAST_BYTES else lambda df: df
    # A template that several items share is one row of the join until it has met a document.
    asked = items.groupBy("h").agg(F.collect_list(F.struct("item_id", F.col("pos").alias("ipos"), "w")).alias("at"))
    hits = staged(places(docs, ["row"]).join(small(asked), "h").select("row", "pos", F.inline("at")), "hits")
    lines = staged(_covering(_aligned(hits), ["row", "item_id", "line"], totals).select("row", "item_id", "line").distinct(), "lines")
    again = docs.join(lines.select("row").distinct(), "row", "left_semi")
    with_slots = items.groupBy("h").agg(F.collect_list(F.struct("item_id", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "w")).alias("at"))
    aligned = _aligned(windows(again, ["row"]).join(small(with_slots), "h").select("row", "pos", "slots", F.inline("at")))
    near = staged(aligned.join(lines, ["row", "item_id", "line"], "left_semi").distinct(), "near")
    taken = _one_to_one(near)
    lines = _covering(taken, ALIGNMENT, totals)
    pairs = taken.where(F.exists("slots", lambda v: v.isNotNull()))
    pairs = pairs.select(*ALIGNMENT, F.explode(F.arrays_zip("slots", "islots")).alias("z")).select(*ALIGNMENT, F.col("z.slots").alias("mine"), F.col("z.islots").alias("theirs")).where("mine IS NOT NULL").distinct()
    per_theirs = pairs.groupBy(*ALIGNMENT, "theirs").agg(F.count("*").alias("n"), F.max(F.col("mine") != F.col("theirs")).alias("other"))
    per_mine = pairs.groupBy(*ALIGNMENT, "mine").agg(F.count("*").alias("n"), F.lit(False).alias("other"))
    cols = [*ALIGNMENT, "n", "other"]
    clash = per_theirs.select(cols).union(per_mine.select(cols)).groupBy(*ALIGNMENT).agg(F.max("n").alias("n"), F.max("other").alias("other"))
    judged = lines.join(clash, ALIGNMENT, "left").where(F.coalesce("n", F.lit(1)) == 1)
    return judged.groupBy("row", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_words").alias("n_words"), F.max(~F.coalesce("other", F.lit(False))).alias("same_values"))


def _covering(hits: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """The alignments (by) whose windows cover enough of the item, with n_matched, its words that they cover."""
    starts = hits.groupBy(*by).agg(F.sort_array(F.collect_set("ipos")).alias("i"), F.max("w").alias("w"))
    covered = F.aggregate("i", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + F.col("w") - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + F.col("w")).alias("end")), lambda a: a["n"])
    return starts.select(*by, covered.alias("n_matched")).join(totals, "item_id").where(F.col("n_matched") >= COVERAGE * F.col("n_words"))


def _one_to_one(near: DataFrame) -> DataFrame:
    """near's hits by ALIGNMENT, each with one place in the document for a window of the item.

    Where template windows repeat, as in a run of numbers, a window of the item hits at several shifts, and slots of
    different shifts say nothing of each other. Alignments are each exact shift by itself (way 0), and for texts with a
    word added or left out three choices among the shifts of a line: equal slots first (1), or the shift of the nearest
    window before (2) or after (3) that hits only once; then the shift with more windows, and with more equal ones.
    """
    item = W.partitionBy("row", "item_id", "line")
    same = F.col("slots").eqNullSafe(F.col("islots"))
    at = near.select("row", "item_id", "line", "pos", "ipos", "slots", "islots", "w", (F.col("pos") - F.col("ipos")).alias("shift"), same.cast("int").alias("same"))
    shifts = W.partitionBy("row", "item_id", "line", "shift")
    at = at.withColumn("n", F.count("*").over(shifts)).withColumn("n_same", F.sum("same").over(shifts))
    at = at.withColumn("sure", F.when(F.count("*").over(W.partitionBy("row", "item_id", "line", "ipos")) == 1, F.col("shift")))
    before = F.last("sure", ignorenulls=True).over(item.orderBy("ipos").rangeBetween(W.unboundedPreceding, 0))
    after = F.first("sure", ignorenulls=True).over(item.orderBy("ipos").rangeBetween(0, W.unboundedFollowing))
    first = lambda by: F.struct(by.alias("by"), "n", "n_same", (-F.abs("shift")).alias("small"), "shift")
    ways = [F.col("same"), F.coalesce(F.col("shift") == before, F.lit(False)).cast("int"), F.coalesce(F.col("shift") == after, F.lit(False)).cast("int")]
    ranked = at.select("*", *(first(by).alias(f"w{i}") for i, by in enumerate(ways)))
    best = W.partitionBy("row", "item_id", "line", "ipos")
    ranked = ranked.select("*", *((F.col(f"w{i}") == F.max(f"w{i}").over(best)).alias(f"is{i}") for i in range(len(ways))))
    way = F.array(F.struct(F.lit(0).alias("way"), F.col("shift").alias("at")), *(F.when(F.col(f"is{i}"), F.struct(F.lit(i + 1).alias("way"), F.col("line").alias("at"))) for i in range(len(ways))))
    each = ranked.select("row", "item_id", "ipos", "slots", "islots", "w", F.explode(F.array_compact(way)).alias("a"))
    return each.select("row", "item_id", F.col("a.way").alias("way"), F.col("a.at").alias("at"), "ipos", "slots", "islots", "w")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, n_exact, n_reparameterised, first_item (smallest item_id held or null), contaminated: for every row of documents (doc_id, text).

    Texts that are null or without words hold nothing. Items without words are not looked for; of rows with the same
    item_id the least text counts; items shorter than a window are one short window and match documents of just those
    words. Repeated rows are judged alike. Empty tables give no rows, or no contaminated ones. Columns other than
    doc_id, item_id and text are not read.
    """
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = leaks(source.select("row", "text"), benchmark.select("item_id", "text"))
    by_row = found.groupBy("row").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct(F.when(F.col("same_values"), F.col("item_id"))).alias("n_exact"), F.min("item_id").alias("first_item"))
    out = source.select("doc_id", "row").join(by_row, "row", "left")
    n = F.coalesce("n_items", F.lit(0))
    return out.select("doc_id", n.alias("n_items"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), (n - F.coalesce("n_exact", F.lit(0))).alias("n_reparameterised"), "first_item", (n > 0).alias("contaminated"))


def op9_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
