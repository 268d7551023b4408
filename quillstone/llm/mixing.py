"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Each source gets a target in words and so a rate (target over size). A document is taken
floor(rate) times, and its fractional rest is a copy probability. Pairs of documents then play for
word mass: one's probability rises, the other's falls, by the same number of words and at odds that
keep every expectation, until one of the two is integral. The one left fractional plays on. Since
each play keeps the words of its source, only the last residual of a source departs from the target:
it is rounded to the nearer side, so a source misses its target by half a document at most.

The plays run over a reduction tree. Documents of a source are laid out by falling size and cut into
blocks of about ``BLOCK``; a block is one fold over a small array that leaves one residual; the
residuals make up the blocks of the next level. A source of any size is thus split over many tasks,
and no task holds more than a few blocks' worth of one group. The layout needs no global sort:
sizes are counted per source, and documents of equal size, whose order is of no account, are
spread over blocks by hash.

Defined results
    * null and wordless texts have size 0 and are taken 0 times;
    * null sources form one source, ordered last for the weights;
    * an empty table gives an empty result; sources without words have target 0;
    * repeated ids are separate documents; a rerun over the same files draws the same copies, whatever the splits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.text_units import word_count
from quillstone.session import checkpointed, numbered

BLOCK = 64
#: sources up to this number are broadcast (a row is under 200 bytes); more are joined by shuffle
BROADCAST_SOURCES = 20_000
#: rows of two longs up to this number are broadcast (16 MB); more are joined by shuffle
BROADCAST_ROWS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target of each source: ``share`` of all words by weight, none above ``cap`` times its size.

    The excess of capped sources goes to the others by weight. With sources sorted by size over
    weight this has a closed form: the first k are capped, the rest share what these leave. ``sizes`` has one
    row a source; the two windows run over those rows alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    level = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("weight").over(onward))
        .withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.max(F.when(F.col("_fits"), F.col("_level"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return level.select("source", "source_size", "n_docs", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(2**53)


def _snapped(p: Column) -> Column:
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _play(seed: int):
    """One step of the fold: the carrier meets the next document; the one left integral is done."""

    def step(state: Column, new: Column) -> Column:
        old, done = state["carrier"], state["done"]
        ratio = old["size"] / new["size"]

        def settle(play: Column) -> Column:
            p_old = _snapped(F.when(play["up"], old["p"] + play["a"]).otherwise(old["p"] - play["b"]))
            p_new = _snapped(F.when(play["up"], new["p"] - play["a"] * ratio).otherwise(new["p"] + play["b"] * ratio))
            pair = F.struct(
                F.struct(old["size"].alias("size"), old["row"].alias("row"), p_old.alias("p")).alias("old"),
                F.struct(new["size"].alias("size"), new["row"].alias("row"), p_new.alias("p")).alias("new"),
            )
            return _let(pair, lambda x: F.when(
                (x["new"]["p"] == 0) | (x["new"]["p"] == 1),
                F.struct(x["old"].alias("carrier"), F.array_append(done, x["new"]).alias("done")),
            ).otherwise(F.struct(x["new"].alias("carrier"), F.array_append(done, x["old"]).alias("done"))))

        moves = F.struct(F.least(1 - old["p"], new["p"] / ratio).alias("a"), F.least(old["p"], (1 - new["p"]) / ratio).alias("b"))
        play = _let(moves, lambda m: F.struct(
            m["a"].alias("a"), m["b"].alias("b"),
            (_uniform(F.lit(seed), old["row"], new["row"]) * (m["a"] + m["b"]) < m["b"]).alias("up"),
        ))
        return _let(play, settle)

    return step


def pivotal_round(units: DataFrame, seed: int, most: int) -> DataFrame:
    """Round p of every unit to 0 or 1.

    ``units``: source, size (over 0), row (unique), p strictly between 0 and 1, position (the unit's block).
    ``most``: the units of the largest source. Returns row and p.
    """
    levels = max(1, math.ceil(math.log(max(most, 2), BLOCK)) + 1)
    decided: list[DataFrame] = []
    unit = F.struct(F.col("size"), F.col("row"), F.col("p"))
    for level in range(levels):
        last = level == levels - 1
        keys = ["source"] if last else ["source", "position"]
        items = F.reverse(F.sort_array(F.collect_list(unit)))
        blocks = units.groupBy(*keys).agg(items.alias("items"))
        start = F.struct(F.col("items")[0].alias("carrier"), F.slice("items", 1, 0).alias("done"))
        folded = F.aggregate(F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))), start, _play(seed + level))
        blocks = checkpointed(blocks.select(*keys, folded.alias("x")))
        decided.append(blocks.select(F.explode("x.done").alias("u")).select("u.row", "u.p"))
        rest = blocks.select(*keys, "x.carrier.size", "x.carrier.row", "x.carrier.p")
        if last:
            decided.append(rest.select("row", F.round("p").alias("p")))
        else:
            units = rest.withColumn("position", F.floor(F.col("position") / BLOCK))
    return reduce(DataFrame.unionByName, decided)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """How often each document enters a mix whose sources meet their targets.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    words, none above ``cap`` times its own. Returns the id, source, size, source_size, target,
    copies, taken (copies times size) and row (the number that ``session.numbered`` gives), a row for each row
    of ``docs``, whose other columns are dropped.
    """
    return _mix(numbered(docs), id_col, text_col, source_col, weights, share, cap, seed)


def _mix(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5, cap: float = 2.0, seed: int = 20,
) -> DataFrame:
    """``mix`` of numbered rows."""
    doc = F.col("doc")
    sized = rows.select(doc.getField(id_col).alias(id_col), doc.getField(source_col).alias("source"), word_count(doc.getField(text_col)).alias("size"), "row")
    sized = checkpointed(sized)  # small rows; the texts are read once

    cells = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = checkpointed(source_targets(totals, weights, share, cap))
    known = targets.agg(F.count("*"), F.max("n_docs")).first()
    few = known[0] <= BROADCAST_SOURCES
    named = F.broadcast(targets) if few else targets

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sized.join(named.drop("n_docs").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rated = rated.withColumn("whole", F.floor(rate + 1e-12)).withColumn("p", _snapped(F.greatest(rate - F.col("whole"), F.lit(0.0))))

    # blocks: documents of a source by falling size; a cell (one size) of many documents is spread by hash
    ahead = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.where("size > 0").withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    cells = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.floor(F.col("ahead") / BLOCK).alias("first"), F.ceil(F.col("n") / BLOCK).alias("span"))
    playing = rated.where("size > 0 AND p > 0 AND p < 1").select("source", "size", "row", "p")
    playing = playing.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    units = playing.select("source", "size", "row", "p", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("span"))).alias("position"))
    drawn = pivotal_round(units, seed, known[1] or 0).withColumnRenamed("p", "drawn")

    copies = F.col("whole") + F.when((F.col("p") > 0) & (F.col("p") < 1), F.coalesce("drawn", F.lit(0.0))).otherwise(F.col("p")).cast("long")
    return (
        rated.join(drawn, "row", "left")
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(id_col, "source", "size", "source_size", "target", "copies", "taken", "row")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns as they came."""
    rows = numbered(docs)
    drawn = checkpointed(_mix(rows, **options).where("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies")))
    taken = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn
    repeated = rows.join(taken, F.col("row") == F.col("_row")).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select("doc.*")
