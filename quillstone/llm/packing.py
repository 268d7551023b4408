"""Harmonic packing of token ids into sequences of one capacity.

Lengths fall into reciprocal-capacity classes: class k takes pieces of at most capacity / k, and k of
them fill a sequence. A document gives full sequences of its own and a tail. As documents may be cut
freely, the tail is cut at the largest whole reciprocal, floor(capacity / k), and so on with what is left;
pieces of class k then have exactly the class's length, and k of them leave less than k slots of padding.
Every worker fills the sequences of each class by itself in one pass. What is left open at its end, under k
pieces a class, is merged: workers by groups, class by class, and the last partial sequences of a group
by first fit over all classes. A group holds at most ``GROUP`` workers' rests, whatever the input.

Defined results: null texts are empty and become the end id alone; each row is a document of its own, also with
repeated ids; ids are whole numbers, what Spark cannot cast to one is an error; other columns are dropped; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tokens import default_vocabulary, ragged_take, release_memory, text_chunks, worker_encoder
from quillstone.session import batches_of, written

CAPACITY = 1024
#: text that a worker encodes at a time; it takes about 30 times as much memory
CHUNK_BYTES = 2 << 20
#: text that the JVM sends a worker at a time; both hold it, the JVM up to twice
BATCH_BYTES = 4 << 20
#: workers whose open sequences one task merges
GROUP = 128
#: a sequence id is a worker's or group's number times this, plus a counter
STRIDE = 1 << 36


def reciprocal_cuts(capacity: int) -> list[list[int]]:
    """The piece lengths of every tail length below ``capacity``."""
    cuts: list[list[int]] = [[]]
    for tail in range(1, capacity):
        k = -(-capacity // tail)  # the smallest class whose length, capacity / k, is within the tail
        piece = capacity // k
        cuts.append([piece, *cuts[tail - piece]])
    return cuts


def class_count(length: int, capacity: int) -> int:
    """How many pieces of a length one sequence takes."""
    return capacity // length


def cut_documents(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces, in order."""
    table = reciprocal_cuts(capacity)
    number = np.asarray([len(x) for x in table])
    full, tail = counts // capacity, counts % capacity
    pieces = full + number[tail]
    document = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    wide = np.zeros((capacity, max(1, number.max())), dtype=np.int64)
    for i, x in enumerate(table):
        wide[i, : len(x)] = x
    rest = np.maximum(nth - full[document], 0)
    length = np.where(nth < full[document], capacity, wide[tail[document], np.minimum(rest, wide.shape[1] - 1)])
    ends = np.cumsum(length)
    first = np.cumsum(pieces) - pieces
    start = ends - length - (ends - length)[first[document]] if len(document) else ends
    return document, start, length


class ClassFiller:
    """Fills sequences of each class in turn; keeps a counter of pieces per class."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next, self.open = capacity, worker * STRIDE, {}

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence id and offset of each piece, in order."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            k = class_count(length, self.capacity)
            current, held = self.open.get(length, (None, 0))
            position = held + np.arange(len(at))
            group = position // k
            ids = self.next + np.arange(int(group[-1]) + 1)
            if held:  # group 0 is the sequence that was open
                ids = np.concatenate(([current], ids[:-1]))
                self.next -= 1
            self.next += len(ids)
            sequence[at], offset[at] = ids[group], (position % k) * length
            total = held + len(at)
            self.open[length] = (int(ids[-1]), total % k) if total % k else (None, 0)
        return sequence, offset

    def still_open(self) -> list[int]:
        return [sequence for sequence, held in self.open.values() if held]


PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, worker long, sequence_id long, offset long, open boolean"


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces in the sequences that their worker gave them; ids as uint32, little-endian.

    Pieces of a sequence not yet full are held back, under k of each class, and come last, marked open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, encoder = TaskContext.get().partitionId(), worker_encoder(vocabulary)
        filler, held = ClassFiller(capacity, worker), None
        for ids, texts in text_chunks(batches, CHUNK_BYTES):
            table = _pieces(encoder.encode(texts), ids, filler, end_id, capacity, worker)
            if held is not None:
                table = pa.concat_tables([held, table])
            waits = np.isin(table["sequence_id"].to_numpy(), np.asarray(filler.still_open(), np.int64))
            held = table.filter(pa.array(waits))
            yield from table.filter(pa.array(~waits)).to_batches(max_chunksize=1 << 14)
        if held is not None:
            at = held.schema.get_field_index("open")
            yield from held.set_column(at, "open", pa.array(np.ones(len(held), bool))).to_batches(max_chunksize=1 << 14)
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def _pieces(segments, ids: pa.Array, filler: ClassFiller, end_id: int, capacity: int, worker: int) -> pa.Table:
    counts = segments.token_counts() + 1
    codes = np.insert(segments.codes, segments.ends, len(segments.starts))
    flat = np.append(segments.flat[: int(segments.starts[-1] + segments.lengths[-1])], np.uint32(end_id))
    starts, lengths = np.append(segments.starts, len(flat) - 1), np.append(segments.lengths, 1)
    stream = ragged_take(flat, starts[codes], lengths[codes]).astype("<u4")
    document, start, length = cut_documents(counts, capacity)
    sequence, offset = filler.place(length)
    bounds = pa.py_buffer((np.concatenate(([0], np.cumsum(length))) * 4).astype(np.int64))
    return pa.table({
        "doc_id": ids.take(pa.array(document)),
        "start": start,
        "length": length,
        "doc_tokens": counts[document],
        "ids": pa.Array.from_buffers(pa.large_binary(), len(length), [None, bounds, pa.py_buffer(stream)]).cast(pa.binary()),
        "worker": np.full(len(length), worker, np.int64),
        "sequence_id": sequence,
        "offset": offset,
        "open": np.zeros(len(length), bool),
    })


def _merge(capacity: int):
    """Sequences for the open rests of one group of workers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py() if hasattr(key[0], "as_py") else int(key[0])
        table = table.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        lengths = table["length"].to_numpy()
        filler = ClassFiller(capacity, 0)
        sequence, offset = filler.place(lengths)
        rest = np.isin(sequence, np.asarray(filler.still_open(), np.int64))
        # rests of all classes, long ones first: the fullest sequence with room takes the piece
        room: list[int] = []
        first = filler.next
        for i in np.flatnonzero(rest).tolist():
            length = int(lengths[i])
            fits = [(left, j) for j, left in enumerate(room) if left >= length]
            j = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(capacity)
            sequence[i], offset[i] = first + j, capacity - room[j]
            room[j] -= length
        # negative ids tell these sequences from the workers' own
        final = -1 - (group * STRIDE + sequence)
        table = table.set_column(table.schema.get_field_index("sequence_id"), "sequence_id", pa.array(final))
        return table.set_column(table.schema.get_field_index("offset"), "offset", pa.array(offset))

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    end_id: int = 0, capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` ids.

    Returns doc_id, start, length, doc_tokens, ids (uint32, little-endian), sequence_id, offset. Each id of a
    document, its end id included, lies in one piece; a sequence's pieces follow each other from offset 0.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        pieces = written(tokenised_pieces(docs, id_col, text_col, vocabulary or default_vocabulary(), end_id, capacity), "pieces")
    group = F.floor(F.col("worker") / GROUP).alias("group")
    merged = pieces.where("open").groupBy(group).applyInArrow(_merge(capacity), PIECE)
    return pieces.where("NOT open").unionByName(merged).drop("worker", "open")
