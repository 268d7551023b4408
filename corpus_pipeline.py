"""A corpus from raw documents: quality, near-duplicates, repeated passages, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Columns pass through as they came, whatever their names.

Defined results: null and empty texts are judged by their zero counts in the first stage; those it keeps stand alone in the second, have no passages in the third, and
are taken 0 times by the mix, so that none is packed. Repeated rows are near-duplicates of each other, of which the second stage keeps one, the first by id (null ids
last) and then by place. Null sources are one source, null languages one path. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import line_dedup, mixing, ngram_join, packing, site_quality
from quillstone.session import read_table, written

#: no SQL: a fitted classifier, random rounding and a tokenizer; tests/llm holds the stages against brute force
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return site_quality.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go."""
    left = line_dedup.dedup(docs).where("size(spans) = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    fields = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in docs.columns]
    return left.select(*fields)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
