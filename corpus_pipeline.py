"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. Null doc_ids, null texts, repeated rows and empty tables go through as the
operators say; columns beyond those of documents are kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.llm.decontaminate import leaks
from wayloom.llm.names import fresh
from wayloom.llm.near_dup import judged
from wayloom.llm.packing import pack
from wayloom.llm.pii import sanitise
from wayloom.llm.toxicity import without_toxic
from wayloom.plans.staging import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The labels are those of rows that are not held out."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id (of rows with the same id one text), and all rows without words."""
    row, one, n, h = fresh(docs, "_row", "_one", "_n", "_h")
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    kept = judged(docs).where("kept").select(F.xxhash64("doc_id", "text_hash").alias(row), "comp")
    single = kept.where("comp IS NOT NULL").groupBy("comp").agg(F.min(row).alias(row)).select(row, F.lit(True).alias(one))
    chosen = single.union(kept.where("comp IS NULL").select(row, F.lit(False)).distinct())
    left = staged(docs.withColumn(row, key).join(chosen, row), "kept")
    extra = left.where(one).groupBy(row).agg(F.count("*").alias(n), F.min(F.xxhash64(*docs.columns)).alias(h)).where(F.col(n) > 1).select(row, h)
    if extra.isEmpty():
        return left.select(docs.columns)
    marked = left.join(extra, row, "left")
    again = marked.where(F.xxhash64(*docs.columns) == F.col(h)).select(docs.columns).dropDuplicates()
    return marked.where(F.col(h).isNull()).select(docs.columns).union(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    (row,) = fresh(docs, "_row")
    held = leaks(docs.select(F.xxhash64("doc_id", "text").alias("row"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).select(F.col("row").alias(row)).distinct()
    return docs.join(held, F.xxhash64("doc_id", "text") == F.col(row), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data; n_chars is that of the new text."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier, the signatures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
