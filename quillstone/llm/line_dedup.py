"""Substring dedup by hashing lines and their sentences: each repeated passage stays where it ranks first.

A text is cut into units: lines, cut again after sentence ends and before a capital that follows a word without one, so that a
passage put into the middle of a line has units of its own. Pieces of fewer than ``MIN_UNIT_WORDS`` words join a neighbour of their
line, short lines the short lines after them; a short line between long ones is a unit by itself, so every word lies in a unit. In
scripts without spaces each Han or kana character is a word, as are four letters of Thai, Lao, Khmer and Burmese. A unit is
normalised (lower case, one space between words) and gets a 128-bit digest. Digests are grouped over all texts (partial minima before
the shuffle); the occurrence of the least (rank, start) is kept and every other is a repeat. Repeats of a text that follow each
other without a unit between them make up a run; runs of at least ``min_words`` words are removed, so that a stray common sentence
stays. The removed spans are kept as code point offsets in the original text.

Only digests are shuffled in the grouping; occurrences of one digest are spread over salts before they meet its first
occurrence. The texts are shuffled only where the documents with removals are too many to broadcast.

Defined results: null texts stay null, empty ones empty, both without spans; ties of rank are broken by row order, so of repeated
rows the first stays; a text that repeats within itself keeps its first occurrence; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tokens import release_memory
from quillstone.session import checkpointed, numbered, written

MIN_UNIT_WORDS = 4
MIN_WORDS = 30
#: occurrences of one digest that one task joins
SALT_ROWS = 50_000
#: documents with removals up to this number are broadcast with their spans, if these are few as well
BROADCAST_SPANS = 200_000

CAPITALS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isupper() or chr(c).istitle())
#: a boundary: after a sentence end, or before a capital (what stands before it is looked at in ``pieces``)
BOUNDARY = re.compile(rf"""[.!?…؟।]["'”’»)\]]* +|[。！？｡]["'”’」』）]*|(?<= )(?=[{CAPITALS}])""")
#: scripts without spaces: characters that count as words, and letters that do by four
CHARACTERS = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LETTERS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")


def word_count(text: str) -> int:
    if text.isascii():
        return len(text.split())
    rest, characters = CHARACTERS.subn(" ", text)
    rest, letters = LETTERS.subn(" ", rest)
    return characters + -(-letters // 4) + len(rest.split())


def pieces(text: str, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, words) of the pieces of a line."""
    for m in BOUNDARY.finditer(text, at, stop):
        end = m.end()
        if m.start() == end:
            before = text[text.rfind(" ", at, end - 1) + 1 or at]
            if end == at or before.isupper() or before.istitle():
                continue
        if end > at:
            yield at, end, word_count(text[at:end])
            at = end
    if stop > at:
        yield at, stop, word_count(text[at:stop])


def joined(found: Iterable[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Pieces of at least ``least`` words: short ones join each other, or the piece before if a long one follows."""
    out: list[tuple[int, int, int]] = []
    start, words = -1, 0
    for begin, end, n in found:
        if start >= 0 and n >= least and out:
            out[-1] = (out[-1][0], begin, out[-1][2] + words)
            start = -1
        start, words = (begin, n) if start < 0 else (start, words + n)
        if words >= least:
            out.append((start, end, words))
            start, words = -1, 0
        else:
            last = end
    if start >= 0:
        out[-1:] = [(out[-1][0], last, out[-1][2] + words)] if out else [(start, last, words)]
    return out


def units_of(text: str, least: int = MIN_UNIT_WORDS) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of the units, which cover all words. A unit of fewer than ``least`` words is short lines that none follows."""
    start, short, at = 0, 0, 0

    def unit(begin: int, end: int, words: int) -> tuple[int, int, int, str]:
        return begin, end, words, " ".join(text[begin:end].split()).lower()

    while at < len(text):
        stop = text.find("\n", at) + 1 or len(text)
        units = joined(pieces(text, at, stop), least)
        if units[0][2] < least:  # a short line
            short += units[0][2]
            if short >= least:
                yield unit(start, stop, short)
                short, start = 0, stop
        else:
            if short:
                yield unit(start, at, short)
            yield from (unit(*u) for u in units)
            short, start = 0, stop
        at = stop
    if short:
        yield unit(start, at, short)


#: nth counts the units of a text, before the words ahead of a unit
UNIT = "row long, rank long, nth long, start long, end long, before long, words long, digest binary"


def unit_digests(ranked: DataFrame, least: int) -> DataFrame:
    """A row for each unit of ``ranked`` (row, rank, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = [x.split()[0] for x in UNIT.split(", ")]

        def out(found: list) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:7]] + [pa.array(columns[7], pa.binary())], names=names)

        found: list = []
        for batch in batches:
            for row, rank, text in zip(*(batch.column(i) for i in range(3))):
                value = text.as_py()
                if not value:
                    continue
                before = 0
                for nth, (start, end, words, norm) in enumerate(units_of(value, least)):
                    found.append((row.as_py(), rank.as_py(), nth, start, end, before, words, xxhash.xxh3_128_digest(norm)))
                    before += words
                if len(found) >= 20_000:
                    yield out(found)
                    found = []
        if found:
            yield out(found)
        found = []
        release_memory()

    return ranked.mapInArrow(run, UNIT)


def repeated_spans(ranked: DataFrame, min_words: int = MIN_WORDS, least: int = MIN_UNIT_WORDS) -> DataFrame:
    """row and spans (start, end, words; by start) of the runs to remove from ``ranked`` (row, rank, text)."""
    units = written(unit_digests(ranked, least), "units")
    order = F.struct("rank", "row", "start")
    # the least occurrence and the count of every digest that occurs twice
    groups = units.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = checkpointed(groups)
    hot = checkpointed(groups.where(F.col("n") > SALT_ROWS).select("digest", F.ceil(F.col("n") / SALT_ROWS).alias("salts")))
    if not hot.isEmpty() and hot.count() <= BROADCAST_SPANS:
        # occurrences of a frequent digest are spread over salts; with too many such digests the adaptive skew join splits them
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SALT_ROWS) - 1)))
        marked = units.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod("row", F.coalesce("salts", F.lit(1).cast("long"))))
        met = marked.join(salted, ["digest", "salt"])
    else:
        met = units.join(groups, "digest")
    repeats = met.where(~((F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start"))))
    # runs of repeats that follow each other; a group is one document
    slim = repeats.select("row", F.struct("nth", "start", "end", "before", "words").alias("u"))
    listed = slim.groupBy("row").agg(F.sort_array(F.collect_list("u")).alias("us"))
    spans = listed.select("row", F.filter(runs(F.col("us")), lambda r: r["words"] >= min_words).alias("spans"))
    return spans.where(F.size("spans") > 0)


def runs(units: Column) -> Column:
    """(start, end, words) of runs of units with consecutive nth: first and last units are picked, and paired."""

    def of(us: Column) -> Column:
        first = F.filter(us, lambda u, i: (i == 0) | (F.get(us, i - 1)["nth"] + 1 != u["nth"]))
        last = F.filter(us, lambda u, i: (i == F.size(us) - 1) | (F.get(us, i + 1)["nth"] - 1 != u["nth"]))
        return F.zip_with(first, last, lambda a, b: F.struct(
            a["start"].alias("start"), b["end"].alias("end"), (b["before"] + b["words"] - a["before"]).alias("words")
        ))

    return F.transform(F.array(units), of)[0]


def without(text: Column, spans: Column) -> Column:
    """``text`` less the spans."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(parts, "")


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS,
    least: int = MIN_UNIT_WORDS,
) -> DataFrame:
    """``docs`` with repeated passages removed: ``doc`` (the row as it came), ``text`` (what is left) and ``spans``.

    The rank of a text is ``rank_col``, or else its id; smaller ranks keep their passages, null ranks come last.
    """
    rows = numbered(docs)
    held = F.col("doc").getField
    rank = F.coalesce(held(rank_col or id_col).cast("long"), F.lit((1 << 63) - 1))
    ranked = rows.select("row", rank.alias("rank"), held(text_col).alias("text"))
    spans = checkpointed(repeated_spans(ranked, min_words, least))
    size = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    small = size.n <= BROADCAST_SPANS and size.spans <= BROADCAST_SPANS
    found = spans.withColumnRenamed("row", "_row").withColumnRenamed("spans", "_spans")
    joined = rows.select("doc", held(text_col).alias("_text"), F.col("row").alias("_at")).join(F.broadcast(found) if small else found, F.col("_at") == F.col("_row"), "left")
    left = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(without(F.col("_text"), F.col("_spans")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,words:bigint>>")
    return joined.select("doc", left.alias("text"), F.coalesce("_spans", none).alias("spans"))
