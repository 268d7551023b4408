"""Exact top-k search: tiled matrix products of query blocks and vector shards.

Queries are taken in rounds of at most ``QUERY_BYTES``, so what is broadcast has a fixed bound; a round's queries go to every shard and the vectors
stay where they are. A shard multiplies its tiles of ``TILE`` vectors with blocks of ``QUERY_BLOCK`` queries, selects within each tile what may still be
among the k best, and gives one list a query. The lists are merged over a tree, so that no task sees more than
``FAN_IN * k`` entries of a query. Each round but an only one is written before the next.

Defined results
    * vectors that are null, or hold a null or non-finite component, take no part;
      rows without an id take no part either;
    * a shorter vector counts as padded with zeros, so an empty one scores 0 with all;
    * ties in score go to the smaller id;
    * a query never meets rows that bear its own id; if an id is repeated among the queries,
      one list results for each row, and a repeated candidate may stand in a list twice;
    * ids are whole numbers: others are an error or null, as Spark's cast has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import ship, written

TILE = 1 << 14
QUERY_BLOCK = 256
QUERY_BYTES = 64 << 20
FAN_IN = 64


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors whose components, if any, are all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(flat.value_lengths())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    return out


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; through float64 where that is exact."""
    dim = max(queries.shape[1], candidates.shape[1])
    queries = np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
    candidates = np.pad(candidates, ((0, 0), (0, dim - candidates.shape[1])))
    bound = dim * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


class BestLists:
    """The k best candidates so far of each query of a round."""

    def __init__(self, q_ids: np.ndarray, queries: np.ndarray, k: int):
        self.q_ids, self.queries, self.k = q_ids, queries, k
        none = np.empty(0, np.int64)
        self.lists = [(none, none)] * len(q_ids)  # (scores, ids), best first

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One tile."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        low, high = np.searchsorted(ids, self.q_ids, "left"), np.searchsorted(ids, self.q_ids, "right")
        for at in range(0, len(self.q_ids), QUERY_BLOCK):
            for i, line in enumerate(_products(self.queries[at : at + QUERY_BLOCK], vectors), at):
                scores, held = self.lists[i]
                floor = scores[-1] if len(scores) == self.k else np.iinfo(np.int64).min
                others = len(line) - (high[i] - low[i])
                if others > self.k:
                    own = line[low[i] : high[i]].copy()
                    line[low[i] : high[i]] = np.iinfo(np.int64).min
                    floor = max(floor, np.partition(line, len(line) - self.k)[len(line) - self.k])
                    line[low[i] : high[i]] = own
                near = np.flatnonzero(line >= floor)
                near = near[(near < low[i]) | (near >= high[i])]
                if not len(near):
                    continue
                scores, held = np.concatenate([scores, line[near]]), np.concatenate([held, ids[near]])
                best = np.lexsort((held, -scores))[: self.k]
                self.lists[i] = scores[best], held[best]

    def table(self, rows: np.ndarray, shard: int) -> pa.RecordBatch:
        sizes = [len(x) for x, _ in self.lists]
        score, ids = (np.concatenate([x[c] for x in self.lists]) if self.lists else np.empty(0, np.int64) for c in (0, 1))
        columns = [np.repeat(rows, sizes), np.repeat(self.q_ids, sizes), ids, score, np.full(len(ids), shard)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=LIST.replace(" long", "").split(", "))


LIST = "row long, query_id long, id long, score long, shard long"


def _lists(asked: pa.Table, held: DataFrame, k: int) -> DataFrame:
    """The list of each query of a round from each shard of ``held`` (id, vector)."""
    rows, q_ids, queries = asked["row"].to_numpy(), asked["id"].to_numpy(), _matrix(asked["vector"])
    shared = held.sparkSession.sparkContext.broadcast((rows, q_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, q_ids, queries = shared.value
        best, waiting, n = BestLists(q_ids, queries, k), [], 0

        def tile() -> None:
            table = pa.Table.from_batches(waiting)
            best.add(table["id"].to_numpy(), _matrix(table["vector"]))

        for batch in batches:
            for at in range(0, len(batch), TILE):
                part = batch.slice(at, TILE)
                if waiting and n + len(part) > TILE:
                    tile()
                    waiting, n = [], 0
                waiting.append(part)
                n += len(part)
        if n:
            tile()
        yield best.table(rows, TaskContext.get().partitionId())

    return held.mapInArrow(run, LIST)


def top_k(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """The k largest integer inner products of each query with ``vectors``.

    Both frames hold ``id_col`` and an integer array ``vector_col`` (see :func:`quantised`);
    other columns are ignored. Returns query_id, rank (from 1), id, score.
    """
    ship(queries.sparkSession)

    def part(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("vector"))
        return kept.where(F.col("id").isNotNull() & usable(F.col("vector")))

    # the queries' numbers are written with them, so that all rounds see the same
    asked = written(part(queries).withColumn("row", F.monotonically_increasing_id()), "queries")
    held = part(vectors)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    rounds = max(1, -(-size.n * (8 * (size.dim or 0) + 64) // QUERY_BYTES))
    shards = max(1, held._jdf.queryExecution().toRdd().getNumPartitions())
    found = []
    for r in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).toArrow()
        merged = merge_lists(_lists(block, held, k), k, shards)
        found.append(merged if rounds == 1 else written(merged, "lists"))
    return reduce(DataFrame.unionByName, found)


def merge_lists(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """Merge the shards' lists over a tree: at each level ``FAN_IN`` lists of a query become one."""
    best = [F.col("score").desc(), F.col("id"), F.col("shard")]
    for level in range(1, max(1, math.ceil(math.log(shards, FAN_IN))) + 1):
        group = F.floor(F.col("shard") / FAN_IN**level)
        rank = F.row_number().over(Window.partitionBy("row", group).orderBy(*best))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "id", "score")
