"""Token-id files compressed by Re-Pair grammars, a grammar a shard.

A shard holds consecutive documents. Its grammar grows by rounds: the most frequent pairs of adjacent
symbols become nonterminals and all their occurrences are replaced, until no pair is frequent enough or
the 16-bit symbol space is full; a vocabulary that leaves it no room is an error. Pairs are counted over the whole ids of the
shard's documents, end ids included, across words, lines and sentences alike; they end at documents alone, so that each is decoded by itself.
The file holds the rules, the expansion length of every nonterminal, the symbols, and for each document the place of its
first symbol and first id, from which any document, or any id within one, is decoded by itself.

File layout (little-endian): magic ``QRP1``; header length; JSON header; then zstd-compressed blocks
``rules`` (uint16 pairs), ``lengths`` (uint32 expansion lengths of nonterminals), ``symbols`` (uint16), ``docs``
(int64 id, with a null flag), ``symbol_starts``, ``id_starts`` (int64).

Defined results: null texts are empty and become the end id alone; null ids come first, repeated ids stand in
the order of their rows; ids are whole numbers, what Spark cannot cast to one is an error; an empty table gives no shard and no row; other columns
are dropped.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.tokens import Segments, default_vocabulary, ragged_take, text_chunks, worker_encoder
from quillstone.session import scratch_path, written

MAGIC = b"QRP1"
SYMBOLS = 1 << 16
#: bytes of text in one shard, unless a single document is longer
SHARD_BYTES = 24 << 20
#: input of one part, as Spark estimates it, and the most parts
PART_BYTES, MOST_PARTS = 256 << 20, 500_000
PAIRS_A_ROUND = 2048
LEAST_COUNT = 16
#: places that are worked on at a time
BLOCK = 1 << 19


def grow_grammar(flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None, vocabulary: int):
    """Re-Pair over runs, each counted ``weights`` times (None: once). Returns (flat, lengths) in symbols and the rules as pairs.

    Nonterminal ``vocabulary + i`` stands for rules[i]. Each round makes rules of the heaviest pairs and replaces
    their occurrences; where occurrences overlap, the heavier pair, then the left one, goes first. A pair may be of any
    two neighbours within a run.
    """
    none = SYMBOLS - 1  # no rank: ranks are below PAIRS_A_ROUND
    flat, runs = flat.astype(np.uint16), lengths[lengths > 0]
    last = np.zeros(len(flat), dtype=bool)  # the last symbol of a run
    last[np.cumsum(runs) - 1] = True
    weight = None if weights is None else np.repeat(weights, lengths)
    rules = np.empty((0, 2), dtype=np.int64)
    while True:
        room = min(PAIRS_A_ROUND, SYMBOLS - vocabulary - len(rules))
        if room <= 0 or len(flat) < 2:
            break
        key = (flat[:-1].astype(np.uint32) << 16) | flat[1:]
        blocks = [slice(i, min(i + BLOCK, len(key))) for i in range(0, len(key), BLOCK)]
        heavy = np.zeros(1 << 20)
        for x in blocks:
            inside = ~last[x]
            heavy += np.bincount(_bucket(key[x][inside]), weights=None if weight is None else weight[x][inside], minlength=1 << 20)
        bar = max(LEAST_COUNT, np.partition(heavy, -2 * room)[-2 * room])
        wide = heavy >= bar
        at = np.concatenate([np.flatnonzero(~last[x] & wide[_bucket(key[x])]) + x.start for x in blocks])
        if not len(at):
            break
        key = key[at]
        ordered = np.sort(key)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        pairs = ordered[first]
        if weight is None:
            count = np.diff(first, append=len(ordered))
        else:
            count = np.bincount(np.searchsorted(pairs, key), weights=weight[at])
        del ordered
        order = np.argsort(-count, kind="stable")[:room]
        order = order[count[order] >= LEAST_COUNT]
        if not len(order):
            break
        by_key = np.sort(order)
        rank = np.empty(len(by_key), dtype=np.uint16)
        rank[np.searchsorted(by_key, order)] = np.arange(len(order))
        taken = pairs[by_key]
        place = np.minimum(np.searchsorted(taken, key), len(taken) - 1)
        prio = np.full(len(flat) + 2, none, dtype=np.uint16)  # by the place of a pair's left symbol, one on
        prio[at + 1] = np.where(taken[place] == key, rank[place], none)
        del key, at, place
        here = prio[1:-1]
        chosen = np.flatnonzero((here < none) & (here < prio[:-2]) & (here <= prio[2:]))
        used = np.flatnonzero(np.bincount(here[chosen]))  # pairs that always lost to heavier ones make no rule
        fresh = np.zeros(SYMBOLS, dtype=np.uint16)
        fresh[used] = vocabulary + len(rules) + np.arange(len(used))
        made = pairs[order[used]].astype(np.int64)
        rules = np.concatenate([rules, np.stack([made // SYMBOLS, made % SYMBOLS], axis=1)])
        flat[chosen] = fresh[here[chosen]]
        last[chosen] = last[chosen + 1]
        keep = np.ones(len(flat), dtype=bool)
        keep[chosen + 1] = False
        flat, last = flat[keep], last[keep]
        weight = None if weight is None else weight[keep]
    grown = np.zeros(len(lengths), dtype=np.int64)
    grown[lengths > 0] = np.diff(np.flatnonzero(last) + 1, prepend=0)
    return flat, grown, rules


def _bucket(key: np.ndarray) -> np.ndarray:
    """20 bits of a pair."""
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(12)


def id_stream(segments: Segments, end_id: int) -> np.ndarray:
    """The ids of all documents, each with its end id, made in blocks."""
    counts = segments.token_counts() + 1
    stream = np.empty(int(counts.sum()), dtype=np.uint16)
    ends = np.cumsum(counts)
    hole = np.ones(len(stream), dtype=bool)
    hole[ends - 1] = False
    flat = np.empty(len(stream) - len(counts), dtype=np.uint16)
    at = 0
    for i in range(0, len(segments.codes), BLOCK):
        codes = segments.codes[i : i + BLOCK]
        part = ragged_take(segments.flat, segments.starts[codes], segments.lengths[codes])
        flat[at : at + len(part)] = part
        at += len(part)
    stream[hole] = flat
    stream[ends - 1] = end_id
    return stream


def expansions(rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, starts, lengths) of every symbol's ids; a rule refers to earlier symbols alone."""
    runs: list[np.ndarray] = []
    for left, right in rules.tolist():
        runs.append(np.concatenate([np.array([x], np.uint32) if x < vocabulary else runs[x - vocabulary] for x in (left, right)]))
    flat = np.concatenate([np.arange(vocabulary, dtype=np.uint32), *runs])
    lengths = np.concatenate([np.ones(vocabulary, np.int64), np.asarray([len(x) for x in runs], np.int64)])
    return flat, np.cumsum(lengths) - lengths, lengths


def encode_shard(segments: Segments, doc_ids: list[int | None], vocabulary: int, end_id: int) -> bytes:
    """The bytes of a shard: grammar, symbols and index of its documents."""
    if max(vocabulary, end_id + 1) > SYMBOLS:
        raise ValueError(f"ids up to {max(vocabulary - 1, end_id)} do not fit {SYMBOLS} symbols")
    counts = segments.token_counts() + 1
    symbols, lengths, rules = grow_grammar(id_stream(segments, end_id), counts, None, vocabulary)
    _, _, grown = expansions(rules, vocabulary)
    blocks = {
        "rules": rules.astype("<u2"),
        "lengths": grown[vocabulary:].astype("<u4"),
        "symbols": symbols.astype("<u2"),
        "docs": np.asarray([x or 0 for x in doc_ids], dtype="<i8"),
        "nulls": np.asarray([x is None for x in doc_ids], dtype="u1"),
        "symbol_starts": np.concatenate(([0], np.cumsum(lengths))).astype("<i8"),
        "id_starts": np.concatenate(([0], np.cumsum(counts))).astype("<i8"),
    }
    import zstandard

    packed = {k: zstandard.ZstdCompressor(level=1).compress(v.tobytes()) for k, v in blocks.items()}
    header = json.dumps({"vocabulary": vocabulary, "blocks": [[k, len(packed[k]), blocks[k].dtype.str] for k in blocks]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed.values()])


class Shard:
    """A shard file: decodes any document by itself, or all of them at once."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        size = struct.unpack("<I", data[4:8])[0]
        header = json.loads(data[8 : 8 + size])
        at, blocks = 8 + size, {}
        for name, length, kind in header["blocks"]:
            raw = zstandard.ZstdDecompressor().decompress(data[at : at + length])
            blocks[name], at = np.frombuffer(raw, dtype=kind), at + length
        self.vocabulary = header["vocabulary"]
        self.rules = blocks["rules"].reshape(-1, 2).astype(np.int64)
        self.symbols, self.symbol_starts, self.id_starts = blocks["symbols"], blocks["symbol_starts"], blocks["id_starts"]
        self.doc_ids = [None if n else int(x) for x, n in zip(blocks["docs"], blocks["nulls"])]
        self.flat, self.starts, self.lengths = expansions(self.rules, self.vocabulary)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of documents first to last, last excluded."""
        symbols = self.symbols[self.symbol_starts[first] : self.symbol_starts[last]].astype(np.int64)
        return ragged_take(self.flat, self.starts[symbols], self.lengths[symbols])

    def document(self, k: int) -> np.ndarray:
        return self.ids(k, k + 1)


def _filesystem(path: str):
    """File system and place of a path; the schemes of Hadoop's S3 clients are Arrow's ``s3``."""
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _write_whole(folder: str, name: str, data: bytes) -> str:
    """Write under a name of this attempt's own, then move: a retried task leaves a whole file."""
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{root}/{name}")
    return f"{folder}/{name}"


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    end_id: int = 2, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode whole texts, in ascending order of ids, to shard files under ``path``.

    Returns the manifest: part, shard, path, n_docs, n_tokens; (part, shard) orders the shards.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), worker_encoder(vocabulary)
        for shard, (ids, texts) in enumerate(text_chunks(batches, shard_bytes)):
            ids = ids.to_pylist()
            segments = encoder.encode(texts)
            data = encode_shard(segments, ids, len(encoder.opens), end_id)
            name = f"part-{part:06d}-{shard:05d}.qrp"
            tokens = int(segments.token_counts().sum()) + len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, shard, _write_whole(path, name, data), len(ids), tokens, len(data))],
                names=["part", "shard", "path", "n_docs", "n_tokens", "n_bytes"],
            )

    order = [F.col("id").asc_nulls_first(), F.col("row").asc()]
    # as many parts as the session asks for, and more where they would hold over PART_BYTES of input
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = sized.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    manifest = placed.sortWithinPartitions(*order).select("id", "text").mapInArrow(
        run, "part long, shard long, path string, n_docs long, n_tokens long, n_bytes long"
    )
    return written(manifest, "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: id, start (ids before it), n_tokens, ids (uint32, little-endian).

    The running sum over the manifest has one row a shard.
    """
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // 16))  # a few shards a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = _filesystem(path)
                with system.open_input_stream(place) as source:
                    shard = Shard(source.read())
                at, n = 0, len(shard.doc_ids)
                while at < n:  # about a million ids at a time
                    to = max(at + 1, int(np.searchsorted(shard.id_starts, shard.id_starts[at] + (1 << 20), side="right")) - 1)
                    bounds = shard.id_starts[at : to + 1]
                    data = shard.ids(at, to).astype("<u4").tobytes()
                    offsets = pa.py_buffer(((bounds - bounds[0]) * 4).astype(np.int32).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[at:to], pa.int64()),
                            pa.array(start + bounds[:-1], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.Array.from_buffers(pa.binary(), to - at, [None, offsets, pa.py_buffer(data)]),
                        ],
                        names=["id", "start", "n_tokens", "ids"],
                    )
                    at = to

    spread = placed.select("path", "before").repartition(parts, "path")
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to shards and read them back."""
    return read_shards(write_shards(docs, path or scratch_path(spark, "token-ids"), **options))
