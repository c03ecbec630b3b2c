"""Quotation linking in conversations, in DataFrame functions only.

Lines are read by their quote depth (the `>` before them). A run of lines of one depth is a passage. A message's own
text (depth 0) is hashed, normalised, as a whole, by paragraph and by line; a passage is hashed as a whole and by line.
Equal hashes in one conversation link a passage with the earliest message that has it. A message's parent is the message
its shallowest linked passages come from. Messages are ordered by thread: those of one root follow it in turn order, and
a parent always comes before its replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import staged, table, with_offsets

#: Normalised lines that are shorter name no message by themselves.
MIN_LINE = 8
MAX_ROUNDS = 64

# Lines that introduce a quotation.
_INTRODUCES = r"^\s*(?:On\s.+\swrote|Le\s.+\sa écrit|Am\s.+\sschrieb.*|El\s.+\sescribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, id, own (text without quotes), passages: array of (depth, text, lines)."""
    key = F.struct("conv_id", "turn", "role", "text")
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^[ \t]*((?:>[ \t]?)++)", 1)
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("d"), F.regexp_replace(x, r"^[ \t]*(?:>[ \t]?)++", "").alias("c"))

    read = messages.select("conv_id", "turn", "role", F.xxhash64(key).alias("id"), F.transform(lines, line).alias("l"))
    next_ = lambda i: F.coalesce(F.get("l", i + 1)["d"], F.lit(0))
    named = read.withColumn("l", F.transform("l", lambda x, i: F.struct(x["d"].alias("d"), x["c"].alias("c"), (x["c"].rlike(_INTRODUCES) & (next_(i) > x["d"])).alias("intro"))))
    named = named.withColumn("l", F.filter("l", lambda x: ~x["intro"]))
    depth = lambda i: F.coalesce(F.get("l", i)["d"], F.lit(-1))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("l") - 1, F.lit(0))), lambda i: depth(i) != F.when(i == 0, F.lit(-2)).otherwise(depth(i - 1)))
    cut = named.withColumn("starts", starts)

    def run(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("l"))
        texts = F.transform(F.slice("l", s + 1, end - s), lambda x: x["c"])
        return F.struct(depth(s).alias("depth"), F.array_join(texts, "\n").alias("text"), texts.alias("lines"))

    own = F.array_join(F.transform(F.filter("l", lambda x: x["d"] == 0), lambda x: x["c"]), "\n")
    clean = F.trim(F.regexp_replace(F.regexp_replace(own, r"\n(?:[ \t]*\n)++", "\n\n"), r"^\s+|\s+$", ""))
    return cut.select("conv_id", "turn", "role", "id", clean.alias("own"), F.filter(F.transform("starts", run), lambda p: (p["depth"] > 0) & (normalised(p["text"]) != "")).alias("passages"))


def _keys(whole: Column, parts: Column) -> Column:
    """Distinct (hash, length) of a normalised text and of those of its parts that are long enough."""
    some = F.filter(F.transform(parts, normalised), lambda x: F.length(x) >= MIN_LINE)
    return F.array_distinct(F.transform(F.array_compact(F.concat(F.array(F.nullif(normalised(whole), F.lit(""))), some)), lambda x: F.struct(F.md5(x).alias("hash"), F.length(x).alias("n"))))


def links(read: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages with a linked passage."""
    ordered = read.where("turn IS NOT NULL")
    parts = F.concat(F.split("own", r"\n\s*\n"), F.split("own", "\n"))
    said = ordered.select("conv_id", "turn", F.explode(_keys(F.col("own"), parts)).alias("k")).groupBy("conv_id", "k").agg(F.min("turn").alias("source")).select(F.col("conv_id").alias("_conv"), F.col("k").alias("_k"), "source")
    asked = ordered.where(F.size("passages") > 0).select("conv_id", "turn", "id", F.posexplode("passages").alias("at", "p"))
    asked = asked.select("conv_id", "turn", "id", "at", "p.depth", F.explode(_keys(F.col("p.text"), F.col("p.lines"))).alias("k"))
    met = asked.join(said, asked["conv_id"].eqNullSafe(said["_conv"]) & (asked["k"] == said["_k"])).where(F.col("source") < F.col("turn"))
    by_source = met.groupBy("conv_id", "turn", "id", "at", "depth", "source").agg(F.sum("k.n").alias("n"))
    # Of a passage the source that has most of it (then the earliest); of a message the shallowest passage's latest source.
    best = by_source.groupBy("conv_id", "turn", "id", "at", "depth").agg(F.max(F.struct("n", (-F.col("source")).alias("m"))).alias("b"))
    return best.groupBy("conv_id", "turn", "id").agg(F.max(F.struct((-F.col("depth")).alias("d"), (-F.col("b.m")).alias("source"))).alias("b")).select("conv_id", "turn", "id", F.col("b.source").alias("parent_turn"))


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn) by pointer doubling over (conv_id, turn, parent_turn), one row for each turn."""
    at = staged(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn")), "roots")
    for _ in range(MAX_ROUNDS):
        up = at.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("root_turn").alias("_up"))
        moved = at.join(up, at["conv_id"].eqNullSafe(up["_c"]) & (at["root_turn"] == up["_t"]), "left")
        if moved.where("_up IS NOT NULL").isEmpty():
            return at
        at = staged(moved.select("conv_id", "turn", F.coalesce("_up", "root_turn").alias("root_turn")), "roots")
    raise RuntimeError("a reply chain does not end")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, position, n_quotes, max_depth, text for every row of (conv_id, turn, role, text).

    position orders a conversation's messages from 0; text has no quotes, no lines that introduce them and no outer
    white space. A message without linked quotes has no parent_turn and is its own root. Null texts are empty. Rows
    with a null conv_id are one conversation. A null turn comes first and is linked with nothing. Rows with the same
    turn are ordered by role and text; each finds its own parent, and the turn's replies go to the least root. An
    empty table gives no rows. Other columns are not read.
    """
    read = staged(parsed(messages.select("conv_id", "turn", "role", "text")), "parsed")
    linked = staged(links(read), "quote_links")
    own = linked.groupBy("id").agg(F.min("parent_turn").alias("parent_turn"))
    top = roots(linked.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn")))
    top = top.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "root_turn")
    rows = read.join(own, "id", "left")
    rows = rows.join(top, rows["conv_id"].eqNullSafe(top["_c"]) & (rows["turn"] == top["_t"]), "left").drop("_c", "_t").withColumn("root_turn", F.coalesce("root_turn", "turn"))
    flat = rows.select("conv_id", "turn", "role", "parent_turn", "root_turn", F.size("passages").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["depth"])), F.lit(0)).cast("long").alias("max_depth"), F.col("own").alias("text"))
    placed = staged(with_offsets(flat, ["conv_id", "root_turn", "turn", "role", "text"], "ordered"), "placed")
    first = placed.groupBy("conv_id").agg(F.min("row_no").alias("_first")).withColumnRenamed("conv_id", "_c")
    out = placed.join(first, placed["conv_id"].eqNullSafe(first["_c"]))
    return out.select("conv_id", "turn", "role", "parent_turn", "root_turn", (F.col("row_no") - F.col("_first")).alias("position"), "n_quotes", "max_depth", "text")


def op1_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
