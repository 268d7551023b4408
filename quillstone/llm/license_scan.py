"""Licence scan by ordered signatures, in DataFrame operations alone.

A text is normalised to lower-cased words (ASCII) with one space between. The base phrases are found as words that stand one
after the other. Beyond these, some hundreds of patterns (``license_rules``) run, each only on texts that hold its keyword; a first
look for the few parts that every match must hold spares most texts even that. Overlapping detections are settled by order, the
best first: a detection goes if one that stayed overlaps it and has a lower priority number, or has the same one and holds it whole. What
a suppressed detection overlaps is not suppressed by it. The whole scan is a projection: no text is shuffled.

``score`` is 0 without detections, and else 1 - product(1 - s), s being 0.9 for a detection that names a version, 0.6 for
others, each counted once a label.

Defined results: null texts are empty, with no words and no labels; base labels stay whatever the signatures find; of detections with the same span
and priority the first label stays; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.license_rules import RULES
from quillstone.llm.text_units import appended

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: every match of a signature holds one of these (checked in tests/llm)
GATE = (
    "licen", "gpl", "apache", "bsd", " cc ", "cc0", "creative commons", "creativecommons", "reserved", "copyright", "public domain",
    "publicdomain", "permission", "redistribution", "endorse", "wtfpl", "beerware", "cecill", "cddl", "eupl", "gfdl", " mpl",
    "exception", "openrail", "mulan", "proprietary", "distribute", "reproduced", "commercial use", "not evil", "expat", "disclaimer",
    "commons clause", "mit no attribution",
)


def normalised(text: Column) -> Column:
    """Words, ASCII letters lower-cased, with one space between and one at either end; one space for none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def word_total(norm: Column) -> Column:
    return (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long")


def phrase_places(norm: Column, phrases: dict[str, str]) -> Column:
    """Array of (at, label) for all places where a phrase's words stand, words counted from 0."""

    def of(words: Column) -> Column:
        found = []
        for phrase, label in phrases.items():
            parts = phrase.split(" ")
            starts = F.filter(
                F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("w"))),
                lambda x: (x["w"] == parts[0]) & F.forall(F.array(*(F.coalesce(F.get(words, x["at"] + k) == p, F.lit(False)) for k, p in enumerate(parts))), lambda y: y),
            )
            places = F.transform(starts, lambda x: F.struct(x["at"].cast("long").alias("at"), F.lit(label).alias("label")))
            has = F.array_contains(words, parts[0])
            found.append(F.when(has, places).otherwise(F.slice(places_none(), 1, 0)))
        return F.concat(*found)

    return F.transform(F.array(F.split(F.trim(norm), " ")), of)[0]


def places_none() -> Column:
    return F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("label")))


def rule_table() -> Column:
    """The signatures as one constant array."""
    return F.array(*(
        F.struct(F.lit(label).alias("label"), F.lit(order).alias("order"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern"))
        for label, order, keyword, pattern in RULES
    ))


def no_hits() -> Column:
    return F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("order"), F.lit("").alias("label"))), 1, 0)


def detections(norm: Column) -> Column:
    """Array of (start, end, order, label): all matches of the signatures, in code points of ``norm``."""

    def matches(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        # the text between matches gives their places
        between = F.split(norm, rule["pattern"])
        pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, text: F.struct(F.length(gap).alias("gap"), F.length(text).alias("len")))
        start = F.struct(F.lit(0).alias("at"), F.slice(F.array(no_hits()), 1, 0).alias("done"), no_hits().alias("last"))

        def step(state: Column, pair: Column) -> Column:
            begin = state["at"] + pair["gap"]
            hit = F.struct(begin.alias("start"), (begin + pair["len"]).alias("end"), rule["order"].alias("order"), rule["label"].alias("label"))
            done, last = appended(state["done"], state["last"], hit)
            return F.struct((begin + pair["len"]).alias("at"), done.alias("done"), last.alias("last"))

        return F.aggregate(pairs, start, step, lambda s: F.flatten(F.array_append(s["done"], s["last"])))

    live = F.filter(rule_table(), lambda rule: F.contains(norm, rule["keyword"]))
    return F.array_distinct(F.flatten(F.transform(live, matches)))


def clusters(hits: Column) -> Column:
    """Detections in groups of which none overlaps another; words that share the space between them do not overlap."""
    none = F.slice(F.array(no_hits()), 1, 0)
    start = F.struct(F.lit(0).alias("far"), F.slice(F.array(none), 1, 0).alias("done"), none.alias("last"), no_hits().alias("open"))

    def step(state: Column, hit: Column) -> Column:
        done, last = appended(state["done"], state["last"], state["open"])
        apart = hit["start"] >= state["far"] - 1
        return F.struct(
            F.greatest(state["far"], hit["end"]).alias("far"), F.when(apart, done).otherwise(state["done"]).alias("done"),
            F.when(apart, last).otherwise(state["last"]).alias("last"), F.when(apart, F.array(hit)).otherwise(F.array_append(state["open"], hit)).alias("open"),
        )

    return F.aggregate(F.array_sort(hits), start, step, lambda s: F.array_append(F.flatten(F.array_append(s["done"], s["last"])), s["open"]))


def best_of(cluster: Column) -> Column:
    """The detections of a cluster that stay, taken in order of priority, length, place and label."""
    key = F.transform(cluster, lambda h: F.struct(h["order"].alias("order"), (h["start"] - h["end"]).alias("less"), h["start"].alias("start"), h["label"].alias("label")))

    def step(kept: Column, k: Column) -> Column:
        y = F.struct(k["start"].alias("start"), (k["start"] - k["less"]).alias("end"), k["order"].alias("order"), k["label"].alias("label"))

        def suppresses(x: Column) -> Column:
            overlap = (x["start"] < y["end"] - 1) & (y["start"] < x["end"] - 1)
            return overlap & ((x["order"] < y["order"]) | ((x["start"] <= y["start"]) & (y["end"] <= x["end"])))

        return F.when(F.exists(kept, suppresses), kept).otherwise(F.array_append(kept, y))

    return F.aggregate(F.array_sort(key), no_hits(), step)


def unsuppressed(hits: Column) -> Column:
    """Detections that no better one suppresses. A cluster of one is done."""
    settle = lambda c: F.when(F.size(c) > 1, best_of(c)).otherwise(c)
    return F.flatten(F.transform(clusters(hits), settle))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections of each row.

    ``detections`` lists (label, order, start, end) in code points of the normalised text.
    """
    rows = docs.select(F.col(id_col).alias(id_col), normalised(F.col(text_col)).alias("norm"))
    phrase = F.lit(False)
    for text in BASE:
        phrase = phrase | F.contains(F.col("norm"), F.lit(f" {text} "))
    gate = F.lit(False)
    for part in GATE:
        gate = gate | F.contains(F.col("norm"), F.lit(part))
    no_places = F.slice(places_none(), 1, 0)
    found = F.transform(F.array("norm"), lambda n: F.transform(F.array(detections(n)), unsuppressed)[0])[0]
    seen = rows.select(
        id_col,
        word_total(F.col("norm")).alias("n_words"),
        F.when(phrase, F.transform(F.array("norm"), lambda n: phrase_places(n, BASE))[0]).otherwise(no_places).alias("places"),
        F.when(gate, found).otherwise(no_hits()).alias("detections"),
    )
    places = F.transform("places", lambda p: p["at"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    names = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    doubt = F.aggregate(names, F.lit(1.0), lambda s, label: s * F.when(label.rlike("-[0-9]"), 0.1).otherwise(0.4))
    return seen.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(names, ",").alias("labels"), F.round(1 - doubt, 9).alias("score"), "detections",
    )
