"""Entities, ids and links: grouping mentions, numbering them, merging fills, checking edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import dedupe_key


def group_mentions(mentions: DataFrame, label: Column, keys: list[Column] | None = None, prefix: str = "G", doc: str = "document_id", order: str = "idx") -> DataFrame:
    """One row an entity: mentions of a document with equal keys (case and spaces aside), numbered by first appearance.

    A mention without key is an entity of its own. Returns the document, entity_id, label (the first mention's), first_idx, n_mentions
    and mentions (their positions, in order).
    """
    parts = [dedupe_key(k) for k in (keys or [label])]
    none = reduce(lambda a, b: a & b, [p.isNull() for p in parts])
    rows = mentions.select(
        doc, F.col(order).alias("idx"), label.alias("label"), *(p.alias(f"k{i}") for i, p in enumerate(parts)), F.when(none, F.col(order)).alias("alone")
    )
    by = [f"k{i}" for i in range(len(parts))]
    grouped = rows.groupBy(doc, "alone", *by).agg(
        F.min("idx").alias("first_idx"), F.min_by("label", "idx").alias("label"), F.count("*").alias("n_mentions"), F.sort_array(F.collect_list("idx")).alias("mentions")
    )
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("first_idx"))
    return grouped.select(doc, F.concat(F.lit(prefix), nth.cast("string")).alias("entity_id"), "label", "first_idx", "n_mentions", "mentions")


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_best(rows: DataFrame, keys: list[str], score: str, order: str, value: str) -> DataFrame:
    """keys, value and score of the row of the highest score (the earliest of equals), and n_mentions; reduced before the shuffle."""
    best = F.struct(F.col(score), -F.col(order))
    return rows.groupBy(*keys).agg(F.max_by(value, best).alias(value), F.max(score).alias(score), F.count("*").alias("n_mentions"))


def fill_ids(rows: DataFrame, doc: str, order: str, id_col: str, prefix: str) -> DataFrame:
    """Missing ids get the smallest unused numbers of their document, in order; given ids stay."""
    missing = Window.partitionBy(doc).orderBy(order)
    blank = F.col(id_col).isNull() | (F.trim(F.col(id_col)) == "")
    number = F.regexp_extract(F.col(id_col), f"^{prefix}(\\d+)$", 1).try_cast("bigint")
    used = rows.where(~blank).groupBy(doc).agg(F.array_sort(F.array_distinct(F.array_compact(F.collect_list(number)))).alias("used"))
    ranked = rows.withColumn("blank", blank).withColumn("nth", F.sum(F.col("blank").cast("long")).over(missing))
    joined = ranked.join(used, doc, "left").withColumn("used", F.coalesce("used", F.array().cast("array<bigint>")))
    # the nth free number: step over each used number at or below it, smallest first
    free = F.aggregate("used", F.col("nth"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    given = F.when(F.col("blank"), F.concat(F.lit(prefix), free.cast("string"))).otherwise(F.col(id_col))
    return joined.withColumn(id_col, given).drop("blank", "nth", "used")


def fill_fields(stubs: DataFrame, fills: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Left join that completes stubs: a value that is there wins over the fill."""
    renamed = fills.select(*keys, *(F.col(f).alias(f"_fill_{f}") for f in fields))
    joined = stubs.join(renamed, keys, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f), F.col(f"_fill_{f}"))).drop(f"_fill_{f}")
    return joined


def edges_by_type(edges: DataFrame, types: list[str], doc: str = "document_id") -> DataFrame:
    """One row a document with an array of (source_id, target_id) for each known type; edges without both ends go."""
    whole = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    pair = F.struct("source_id", "target_id")
    lists = [F.array_compact(F.sort_array(F.collect_list(F.when(F.col("edge_type") == t, pair)))).alias(t) for t in types]
    return whole.where(F.col("edge_type").isin(*types)).groupBy(doc).agg(*lists)


def edge_integrity(edges: DataFrame, nodes: DataFrame, end: str, node_id: str) -> DataFrame:
    """Edges with a flag that tells whether their end is a known node."""
    known = nodes.select(F.col(node_id).alias("_node")).distinct()
    return edges.join(known, F.col(end) == F.col("_node"), "left").withColumn("resolves", F.col("_node").isNotNull()).drop("_node")
