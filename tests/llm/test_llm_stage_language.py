"""The pipeline's language stage where labels are missing."""

import corpus_pipeline
from pyspark.sql import functions as F


def stage(spark, docs, folder):
    return {r["doc_id"]: r for r in corpus_pipeline.language_stage(spark, docs, folder).collect()}


def test_no_labels_lose_no_documents(spark, documents, folder):
    docs = documents.withColumn("lang", F.lit(None).cast("string"))
    want = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    got = stage(spark, docs, folder)
    assert want and set(got) == want and all(r["lang"] is None for r in got.values())


def test_a_missing_label_is_filled(spark, documents, folder):
    known = {r["doc_id"]: r["lang"] for r in documents.filter("lang is not null and n_chars > 300").collect()}
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    got = stage(spark, docs, folder)
    hidden = [d for d in known if d % 7 == 0 and d in got]
    assert len(hidden) >= 5
    assert sum(got[d]["lang"] == known[d] for d in hidden) >= 0.9 * len(hidden)
    assert all(got[d]["lang"] == known[d] for d in known if d % 7 and d in got)


def test_und_may_be_a_label(spark, documents, folder):
    docs = documents.withColumn("lang", F.when(F.col("lang") == "de", "und").otherwise(F.col("lang")))
    rows = docs.collect()
    want = {r["doc_id"]: r["lang"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
    got = stage(spark, docs, folder)
    assert "und" in want.values() and {d: r["lang"] for d, r in got.items()} == want
