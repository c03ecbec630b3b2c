"""Small document tables, and words as the contracts define them."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, row int, length string"
SF = "/root/testdata/sf0.001"


def words(text):
    return WORDS.findall(text or "")


def docs(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or (doc_id, text, lang, source); columns with names that operators use inside come along."""
    full = []
    for r in rows:
        r = (*r, "en", "s")[:4] if len(r) < 4 else r
        full.append((*r[:4], len(r[1] or ""), 7, 8, "clash"))
    return spark.createDataFrame(full, schema)


def collect(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}
