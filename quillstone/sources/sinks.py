"""Sinks: partitioned JSON lines, texts, CSV; and runs that leave out what an earlier run has done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines without null fields, partitioned by columns."""
    writer = records.write.mode("append").option("ignoreNullFields", "true")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_texts(texts: DataFrame, path: str, run_id: str) -> None:
    """One folder a run, hash and provider, with the markdown and its metadata."""
    texts.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "hash_id", "provider").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; missing values are empty."""
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def not_done(docs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys an earlier run's output lacks."""
    return docs.join(done.select(*keys).distinct(), keys, "left_anti")


def cached(items: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items with what the cache holds, items it lacks), by content keys such as (model, document hash)."""
    return items.join(cache, keys), items.join(cache.select(*keys), keys, "left_anti")


def write_ordered(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in the order of columns, across and within the numbered part files."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def cached_vectors(sentences: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(sentences with the cache's vectors, those it lacks): an entry counts if its model and the hashes of its document and sentence agree."""
    asked = sentences.withColumn("model", F.lit(model))
    return cached(asked, cache, ["model", "document_hash", "sentence_hash"])


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Adds rows (model, document_hash, sentence_hash, vector) to a cache."""
    vectors.select("model", "document_hash", "sentence_hash", "vector").write.mode("append").partitionBy("model").parquet(path)
