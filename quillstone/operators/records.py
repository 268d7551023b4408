"""Records of a study: fields out of attributes, entities with conditions, leaves as rows and back, notes, reviews, metrics.

A record is one struct (``types.STUDY_RECORD``). Its leaves become rows by one projection, without a shuffle, and evidence returns to them by one shuffle on the document.

Defined results: null records have no leaves; blank values are no leaves; entities are numbered by first appearance in their document; of extractions with equal keys the
first gives the label; attributes a field does not know are ignored; an empty table gives no rows. Documents that share an id count as one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.parse import parse_bool, parse_float, parse_int, parse_list, value_text
from quillstone.functions.text import dedupe_key, enum_text, first_label, mapped, null_token
from quillstone.functions.types import EVIDENCE, FAMILY_WORDS, FIELDS, Field, entity_type, value_type

PARSERS = {"long": parse_int, "double": parse_float, "boolean": parse_bool, "text": null_token}
#: what names an entity in a context, best first, and the word before it
LABELS = {
    "group": ("cohort ", "group ", ("cohort_label", "medical_condition")), "task": ("task ", "task ", ("task_name", "task_description")),
    "analysis": ("analysis ", "analysis ", ("analysis_label", "contrast_formula")),
    "modality": ("modality ", "modality ", ("modality_family", "sequence_name", "voxel_size", "manufacturer")),
}


def fields_of(entity: str) -> list[Field]:
    return [f for f in FIELDS if f.entity == entity]


def evidence_span(document_id: Column, text: Column, start: Column, end: Column, status: Column, index: Column, group: Column | None = None) -> Column:
    """One span of evidence for an extraction."""
    interval = F.when(start.isNotNull() & end.isNotNull(), F.struct(start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos")))
    none = F.lit(None)
    values = [F.lit("text"), none, text, interval, status, index, none if group is None else group, document_id, none]
    return F.struct(*(v.cast(f.dataType).alias(f.name) for v, f in zip(values, EVIDENCE.fields)))


def valued(value: Column, kind: str, evidence: Column) -> Column:
    """A value with its evidence; null for no value, and for one without evidence."""
    held = value_type(kind)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.fields[2:]]
    made = F.struct(value.cast(held["value"].dataType).alias("value"), evidence.cast(held["evidence"].dataType).alias("evidence"), *rest)
    return F.when(value.isNotNull() & (F.size(evidence) > 0), made)


def unwrapped(value: Column, kind: str = "text") -> Column:
    """The text of a value with evidence; null for blank ones."""
    return F.nullif(F.trim(value_text(value["value"], kind)), F.lit(""))


def list_of(raw: Column) -> Column:
    """A list written as JSON, or as text with separators; null tokens give null."""
    said = null_token(raw)
    listed = F.when(said.startswith("["), F.from_json(said, "array<string>"))
    clean = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(clean, parse_list(said))


def canonical(value: Column, field: Field) -> Column:
    """The allowed value that text means; null for none."""
    table = {" ".join(re.sub("([a-z0-9])([A-Z])", r"\1 \2", a.replace("_", " ").replace("/", " ")).lower().split()): a for a in field.allowed}
    table |= {a.lower(): a for a in field.allowed}
    if field.name == "modality_family":
        table |= FAMILY_WORDS | {"f mri": "fMRI"}
    return F.coalesce(mapped(F.lower(F.trim(value)), table), mapped(enum_text(value), table))


def project(extractions: DataFrame, entity: str) -> DataFrame:
    """document_id, entity_id, a column for each field of the entity, and notes on what was dropped.

    ``extractions``: document_id, entity_id, idx, attributes (map of text) and evidence; the first of each entity counts.
    """
    first = Window.partitionBy("document_id", "entity_id").orderBy("idx")
    rows = extractions.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    columns, notes = [], []
    said = lambda f, what: F.concat(F.coalesce(F.concat("entity_id", F.lit(": ")), F.lit("")), F.lit(f"Invalid {entity}.{f.name}: "), what)
    for f in fields_of(entity):
        raw = F.try_element_at("attributes", F.lit(f.name))
        if f.many:
            listed = list_of(raw)
            good = F.filter(F.transform(listed, lambda x: canonical(x, f)), lambda x: x.isNotNull()) if f.allowed else listed
            made = F.transform(good, lambda x: valued(x, "text", F.col("evidence")))
            columns.append(F.when(F.size(made) > 0, made).alias(f.name))
            if f.allowed:
                bad = F.filter(listed, lambda x: canonical(x, f).isNull())
                notes.append(F.when(F.size(bad) > 0, said(f, F.concat(F.array_join(bad, ", "), F.lit(" not allowed")))))
            continue
        value = canonical(null_token(raw), f) if f.allowed else PARSERS[f.kind](null_token(raw))
        columns.append(valued(value, f.kind, F.col("evidence")).alias(f.name))
        if f.allowed or f.kind != "text":
            notes.append(F.when(null_token(raw).isNotNull() & value.isNull(), said(f, F.concat(null_token(raw), F.lit(" not allowed" if f.allowed else f" is no {f.kind}")))))
    return rows.select("document_id", "entity_id", *columns, F.array_compact(F.array(*notes) if notes else F.array().cast("array<string>")).alias("notes"))


def study_metadata(extractions: DataFrame) -> DataFrame:
    """The first extraction's study fields of each document; documents whose fields are all empty have no row."""
    found = project(extractions.withColumn("entity_id", F.lit(None).cast("string")), "study")
    return found.where(reduce(lambda a, b: a | b, (F.col(f.name).isNotNull() for f in fields_of("study"))))


def tasks(extractions: DataFrame) -> DataFrame:
    """document_id, entity_id (T1, ...), label, evidence and conditions (id, label), ids running through the document.

    ``extractions``: document_id, idx, extraction_text, attributes and evidence (array). Equal names are one task; a task's equal conditions are one.
    """
    name = F.coalesce(null_token(F.try_element_at("attributes", F.lit("task_name"))), F.col("extraction_text"))
    rows = extractions.select("document_id", "idx", name.alias("label"), list_of(F.try_element_at("attributes", F.lit("conditions"))).alias("said"), "evidence")
    rows = rows.withColumn("key", dedupe_key(F.col("label"))).withColumn("alone", F.when(F.col("key").isNull(), F.col("idx")))
    grouped = rows.groupBy("document_id", "key", "alone").agg(
        F.min("idx").alias("first_idx"), F.min_by("label", "idx").alias("label"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("idx", "evidence"))), lambda x: x["evidence"])).alias("evidence"),
    )
    grouped = grouped.withColumn("entity_id", F.concat(F.lit("T"), F.row_number().over(Window.partitionBy("document_id").orderBy("first_idx")).cast("string")))
    said = rows.select("document_id", "key", "alone", "idx", F.posexplode("said").alias("pos", "condition"))
    same = [F.col("document_id"), F.col("key"), F.col("alone"), F.coalesce(dedupe_key(F.col("condition")), F.concat_ws(" ", "idx", "pos"))]
    once = said.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("idx", "pos"))).where("_n = 1").drop("_n")
    own = grouped.select(F.col("document_id").alias("_d"), F.col("key").alias("_k"), F.col("alone").alias("_a"), "first_idx")
    placed = once.join(own, F.col("document_id").eqNullSafe(F.col("_d")) & F.col("key").eqNullSafe(F.col("_k")) & F.col("alone").eqNullSafe(F.col("_a")))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("first_idx", "idx", "pos"))
    listed = placed.withColumn("n", number).groupBy(F.col("document_id").alias("_d"), F.col("first_idx").alias("_f")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "condition"))), lambda x: F.struct(F.concat(F.lit("C"), x["n"].cast("string")).alias("id"), x["condition"].alias("label"))).alias("conditions")
    )
    met = grouped.join(listed, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("first_idx") == F.col("_f")), "left")
    return met.select("document_id", "entity_id", "label", "first_idx", "evidence", "conditions")


def numbered_conditions(tasks: DataFrame) -> DataFrame:
    """``tasks`` (document_id, pos, conditions: id and label) with ids where conditions have none, by one counter through the document."""
    size = F.coalesce(F.size(F.filter("conditions", lambda c: c.isNotNull())), F.lit(0))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    rows = tasks.select("*", before)
    made = F.transform("conditions", lambda c, i: F.struct(F.coalesce(F.nullif(F.trim(c["id"]), F.lit("")), F.concat(F.lit("C"), (F.col("before") + i + 1).cast("string"))).alias("id"), c["label"].alias("label")))
    return rows.withColumn("conditions", made).drop("before")


def combined_passes(passes: list[DataFrame]) -> DataFrame:
    """Extractions (document_id, idx, ...) of several passes, renumbered in the order of passes."""
    both = reduce(lambda a, b: a.unionByName(b), (p.withColumn("_pass", F.lit(i)) for i, p in enumerate(passes)))
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("_pass", "idx")) - 1).drop("_pass")


# leaves


def _entities(record: Column) -> dict[str, Column]:
    return {
        "study": F.array(record["study"]), "group": record["demographics"]["groups"], "task": record["tasks"],
        "condition": F.flatten(F.transform(record["tasks"], lambda t: F.coalesce(t["conditions"], F.array().cast(T.ArrayType(entity_type("condition")))))),
        "modality": record["modalities"], "analysis": record["analyses"],
    }


def leaves(records: DataFrame, record: str = "record") -> DataFrame:
    """document_id, entity, entity_id, field, ordinal, value (as text) and evidence of every value that is not blank."""

    def leaf(entity: str, item: Column, f: Field, value: Column, ordinal: Column) -> Column:
        return F.struct(
            F.lit(entity).alias("entity"), item["id"].alias("entity_id"), F.lit(f.name).alias("field"), ordinal.cast("int").alias("ordinal"),
            unwrapped(value, f.kind).alias("value"), value["evidence"].alias("evidence"),
        )

    def of(entity: str, item: Column) -> Column:
        one = [leaf(entity, item, f, item[f.name], F.lit(0)) for f in fields_of(entity) if not f.many]
        many = [F.transform(item[f.name], lambda v, i: leaf(entity, item, f, v, i)) for f in fields_of(entity) if f.many]
        parts = [F.array(*one), *(F.coalesce(m, F.slice(F.array(one[0]), 1, 0)) for m in many)]
        return F.filter(F.concat(*parts), lambda x: x["value"].isNotNull())

    all_ = [F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda item: of(e, item))) for e, items in _entities(F.col(record)).items()]
    # one frame an entity: each is a projection of the record
    return reduce(DataFrame.unionByName, (records.select("document_id", F.inline(found)) for found in all_))


def _key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def attach(records: DataFrame, found: DataFrame, record: str = "record") -> DataFrame:
    """``records`` (document_id, record) with evidence (document_id, entity, entity_id, field, ordinal, evidence) in their leaves; others keep what they have."""
    spans = found.groupBy("document_id", _key(F.col("entity"), F.col("entity_id"), F.col("field"), F.col("ordinal")).alias("k")).agg(F.flatten(F.collect_list("evidence")).alias("e"))
    table = spans.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "e"))).alias("_found"))

    def with_evidence(entity: str, item: Column) -> Column:
        def put(value: Column, f: Field, ordinal: Column) -> Column:
            new = F.try_element_at("_found", _key(F.lit(entity), item["id"], F.lit(f.name), ordinal))
            return F.when(value.isNotNull(), value.withField("evidence", F.coalesce(new.cast(T.ArrayType(EVIDENCE)), value["evidence"])))

        made = item
        for f in fields_of(entity):
            value = item[f.name]
            item_f = F.transform(value, lambda v, i: put(v, f, i)) if f.many else put(value, f, F.lit(0))
            made = made.withField(f.name, item_f)
        if entity == "task":
            made = made.withField("conditions", F.transform(item["conditions"], lambda c: with_evidence("condition", c)))
        return made

    r = F.col(record)
    rebuilt = r.withField("study", F.when(r["study"].isNotNull(), with_evidence("study", r["study"])))
    rebuilt = rebuilt.withField("demographics", F.when(r["demographics"].isNotNull(), F.struct(F.transform(r["demographics"]["groups"], lambda g: with_evidence("group", g)).alias("groups"))))
    for name, entity in (("tasks", "task"), ("modalities", "modality"), ("analyses", "analysis")):
        rebuilt = rebuilt.withField(name, F.transform(r[name], lambda x: with_evidence(entity, x)))
    return records.join(table, "document_id", "left").withColumn(record, rebuilt).drop("_found")


def field_counts(leaf_rows: DataFrame) -> DataFrame:
    """Values, and values with evidence, of each document and entity kind."""
    return leaf_rows.groupBy("document_id", "entity").agg(F.count("*").alias("n_values"), F.count_if(F.size("evidence") > 0).alias("n_with_evidence"))


def contexts(leaf_rows: DataFrame) -> DataFrame:
    """document_id, entity, entity_id and context: how a hypothesis names the entity."""
    wanted = leaf_rows.where((F.col("ordinal") == 0) & reduce(lambda a, b: a | b, ((F.col("entity") == e) & F.col("field").isin(*names) for e, (_, _, names) in LABELS.items())))
    ids = leaf_rows.where(F.col("entity").isin(*LABELS)).groupBy("document_id", "entity", "entity_id").agg(F.lit(1).alias("_one"))
    held = wanted.groupBy("document_id", "entity", "entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("said"))
    label = None
    for entity, (word, id_word, names) in LABELS.items():
        one = F.coalesce(first_label(*(F.try_element_at("said", F.lit(n)) for n in names), prefix=word), F.concat(F.lit(id_word), F.nullif(F.trim("entity_id"), F.lit(""))))
        label = F.when(F.col("entity") == entity, one) if label is None else label.when(F.col("entity") == entity, one)
    return ids.join(held, ["document_id", "entity", "entity_id"], "left").select("document_id", "entity", "entity_id", label.alias("context"))


def with_evidence(records: DataFrame, sentences: DataFrame, catalog: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with evidence found for every leaf: leaves as rows, the cascade, and back. A name is not judged by the name itself."""
    from quillstone.operators.evidence import find_evidence

    rows = leaves(records, record).drop("evidence")
    named = rows.join(contexts(rows), ["document_id", "entity", "entity_id"], "left")
    own = F.col("field").isin("task_name", "analysis_label")
    values = named.withColumn("context", F.when(~own, F.col("context")))
    found = find_evidence(values, sentences, catalog)
    span = F.struct(
        F.lit("text").alias("source"), "section", "extraction_text", F.struct(F.col("start").cast("int").alias("start_pos"), F.col("end").cast("int").alias("end_pos")).alias("char_interval"),
        "alignment_status", F.lit(None).cast("int").alias("extraction_index"), F.lit(None).cast("int").alias("group_index"), "document_id", F.lit(None).cast("string").alias("locator"),
    )
    listed = found.groupBy("document_id", "entity", "entity_id", "field", "ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", span.alias("s")))), lambda x: x["s"]).alias("evidence"))
    return attach(records, listed, record)


# types


def pruned(kind: T.StructType, keep: list[str]) -> T.StructType:
    """The named fields of a type, values without their wrapping, ids nullable: what a model is asked for."""

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType))
        if isinstance(t, T.StructType) and "value" in t.names and "evidence" in t.names:
            return t["value"].dataType
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in t.fields]) if isinstance(t, T.StructType) else t

    return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in kind.fields if f.name in keep])


def json_schema(kind: T.DataType, most_items: int | None = None) -> dict:
    """The JSON schema of a type, every key required and nullable."""
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)} | ({"maxItems": most_items} if most_items else {})
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": kind.names, "additionalProperties": False}
    name = {"string": "string", "bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean"}[kind.simpleString()]
    return {"type": [name, "null"]}


def or_null(value: Column, parts: list[Column]) -> Column:
    """Null where all parts are null or empty."""
    return F.when(reduce(lambda a, b: a | b, (F.coalesce(p.isNotNull(), F.lit(False)) for p in parts)), value)


# review


def containing(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """``points`` (key, at) with the name of the first interval (key, start, end, name; both ends belong to it) that holds them; null for none.

    A join on the key with the interval as a condition: a key's points meet its own intervals alone.
    """
    joined = points.withColumn("_p", F.monotonically_increasing_id()).alias("p")
    met = joined.join(intervals.alias("i"), (F.col(f"p.{key}") == F.col(f"i.{key}")) & F.col("p.at").between(F.col("i.start"), F.col("i.end")), "left")
    best = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("i.start").asc_nulls_last(), F.col("i.end"), F.col("i.name")))
    return met.withColumn("_n", best).where("_n = 1").select("p.*", F.col("i.name").alias("name")).drop("_p")


def display_order(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` (key, start, end) with place: by start, longer ones first, so that tags nest."""
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start", F.col("end").desc())))


def edited(spans: DataFrame, edits: DataFrame, docs: DataFrame) -> DataFrame:
    """``spans`` (document_id, span_id, start, end) after edits (document_id, span_id, start, end, removed): a valid new interval wins, invalid ones are marked; text follows.

    ``docs``: document_id and text.
    """
    e = edits.select("document_id", "span_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.coalesce("removed", F.lit(False)).alias("_removed"))
    both = spans.join(e, ["document_id", "span_id"], "left").where("NOT coalesce(_removed, false)").join(docs, "document_id")
    valid = (F.col("_s") >= 0) & (F.col("_s") <= F.col("_e")) & (F.col("_e") <= F.length("text"))
    asked = F.col("_s").isNotNull() | F.col("_e").isNotNull()
    use = asked & F.coalesce(valid, F.lit(False))
    start, end = F.when(use, F.col("_s")).otherwise(F.col("start")), F.when(use, F.col("_e")).otherwise(F.col("end"))
    return both.select(
        "document_id", "span_id", start.alias("start"), end.alias("end"), (asked & ~use).alias("rejected"), F.substring("text", (start + 1).cast("int"), (end - start).cast("int")).alias("extraction_text")
    )


def metrics(leaf_rows: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """One row a document: n_values, coverage and missing rate of evidence, precision, recall and F1 against ``truth`` (the same keys and value), linked share of entities.

    ``links``: document_id and entity_id of entities that some link names.
    """
    key = ["document_id", "entity", "entity_id", "field", "ordinal"]
    right = leaf_rows.join(truth.select(*key, F.col("value").alias("_true")), key, "full")
    hit = F.count_if(F.col("value") == F.col("_true"))
    counted = right.groupBy("document_id").agg(
        F.count("value").alias("n_values"), F.count("_true").alias("n_true"), hit.alias("n_right"), F.count_if(F.size("evidence") > 0).alias("n_with_evidence")
    )
    ents = leaf_rows.where("entity_id IS NOT NULL").select("document_id", "entity_id").distinct().join(links.select("document_id", "entity_id").distinct().withColumn("_l", F.lit(1)), ["document_id", "entity_id"], "left")
    linked = ents.groupBy("document_id").agg((F.count("_l") / F.count("*")).alias("linking_rate"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    scored = counted.withColumn("precision", part("n_right", "n_values")).withColumn("recall", part("n_right", "n_true"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    scored = scored.withColumn("evidence_coverage_ratio", part("n_with_evidence", "n_values")).withColumn("evidence_missing_rate", F.when(F.col("n_values") > 0, 1 - F.col("evidence_coverage_ratio")))
    return scored.withColumn("field_f1_score", f1).join(linked, "document_id", "left")
