"""A training-data pipeline over ``documents``: five stages, each a Parquet table.

language   drops documents without a letter; a NULL lang becomes the inferred language
simhash    keeps the document of smallest doc_id of each group of near copies: shingles
           of five words with a Jaccard similarity of 0.8 or more, verified exactly;
           near SimHash fingerprints first, MinHash bands for what they leave apart
pii        replaces personal data by its kind
mixing     takes words of each source to its target weight
packing    packs what is left into sequences (rows are pieces)

Every stage reads what the one before it wrote, works on all of it, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, mixing, packing, pii
from tidemark.llm.common import shared_dir

#: No SQL can express trigram mixtures, fingerprints or tokenizers.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; all labelled ones teach, the others get their language."""
    langs, logs = language.fit(docs, F.lit(True))
    return language.with_language(docs, langs, logs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return jaccard.without_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by ``<KIND>``."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.packed_pieces(docs).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language", language_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
