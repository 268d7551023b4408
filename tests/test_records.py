"""Fields out of attributes, leaves as rows and back, reviews and metrics."""

import json

from pyspark.sql import functions as F

from quillstone.functions.types import STUDY_RECORD, entity_type, field_catalog
from quillstone.operators import records, sentences

EXTRACTION = "document_id string, entity_id string, idx long, extraction_text string, attributes map<string,string>"


def extractions(spark, rows):
    made = spark.createDataFrame(rows, EXTRACTION)
    span = records.evidence_span(F.col("document_id"), F.col("extraction_text"), F.lit(1), F.lit(4), F.lit("match_exact"), F.col("idx"))
    return made.withColumn("evidence", F.array(span))


def test_fields_of_all_entities(spark):
    rows = extractions(spark, [
        ("d", "G1", 1, "x", {"count": "1,024 people", "age_mean": "about 31.5", "population_role": " Patient ", "all_right_handed": "yes", "inclusion_criteria": '["a", " b "]', "cohort_label": "n/a", "more": "?"}),
        ("d", "G1", 2, "x", {"count": "7"}), ("d", "G2", 3, "x", {"population_role": "alien", "count": "many"}), ("e", "G1", 4, "x", None),
    ])
    found = {(r.document_id, r.entity_id): r for r in records.project(rows, "group").collect()}
    one = found["d", "G1"]
    assert (one["count"].value, one.age_mean.value, one.population_role.value, one.all_right_handed.value) == (1024, 31.5, "patient", True) and one.cohort_label is None
    assert [x.value for x in one.inclusion_criteria] == ["a", "b"] and one["count"].evidence[0].char_interval.end_pos == 4 and not one.notes
    assert found["d", "G2"].notes == ["G2: Invalid group.population_role: alien not allowed", "G2: Invalid group.count: many is no long"] and found["e", "G1"]["count"] is None
    task = records.project(extractions(spark, [("d", "T1", 0, "x", {"task_design": "blocked; Event-Related, EventRelated|odd", "task_name": "Go"})]), "task").first()
    assert [x.value for x in task.task_design] == ["Blocked", "EventRelated"] and task.notes == ["T1: Invalid task.task_design: Event-Related, odd not allowed"]
    scan = records.project(extractions(spark, [("d", "M1", 0, "x", {"modality_family": "DTI", "field_strength_tesla": "3T"})]), "modality").first()
    assert scan.modality_family.value == "DiffusionMRI" and scan.field_strength_tesla.value == 3.0
    assert records.project(extractions(spark, [("d", "A1", 0, "x", {"reporting_scope": "whole brain"})]), "analysis").first().reporting_scope.value == "WholeBrain"
    study = records.study_metadata(extractions(spark, [("d", None, 2, "x", {"study_type": "review"}), ("d", None, 1, "x", {"study_type": "meta analysis"}), ("e", None, 1, "x", {"study_type": "?"})]))
    assert [(r.document_id, r.study_type.value) for r in study.collect()] == [("d", "MetaAnalysis")]


def test_tasks_and_conditions(spark):
    rows = extractions(spark, [
        ("d", None, 0, "N-back", {"conditions": "2-back; 0-back"}), ("d", None, 1, "other", {"task_name": "n-BACK", "conditions": "2-Back, rest"}), ("d", None, 2, "Stroop", {"conditions": '["rest"]'}),
        ("d", None, 3, None, None), ("d", None, 4, " ", None), (None, None, 0, "x", None), (None, None, 1, "X", None),
    ])
    found = [(r.document_id, r.entity_id, r.label, [(c.id, c.label) for c in r.conditions or []], len(r.evidence)) for r in records.tasks(rows).orderBy("document_id", "first_idx").collect()]
    assert found[0][:4] == (None, "T1", "x", []) and [x for x in found if x[0]] == [
        ("d", "T1", "N-back", [("C1", "2-back"), ("C2", "0-back"), ("C3", "rest")], 2), ("d", "T2", "Stroop", [("C4", "rest")], 1), ("d", "T3", None, [], 1), ("d", "T4", " ", [], 1)]
    held = spark.createDataFrame([("d", 0, [("C9", "a"), (None, "b")]), ("d", 1, None), ("d", 2, [(" ", "c")])], "document_id string, pos int, conditions array<struct<id:string,label:string>>")
    assert [[c.id for c in r.conditions or []] for r in records.numbered_conditions(held).orderBy("pos").collect()] == [["C9", "C2"], [], ["C3"]]
    passes = records.combined_passes([rows.where("idx < 2").select("document_id", "idx", "extraction_text"), rows.where("idx = 0").select("document_id", "idx", "extraction_text")])
    assert [(r.idx, r.extraction_text) for r in passes.where("document_id = 'd'").orderBy("idx").collect()] == [(0, "N-back"), (1, "other"), (2, "N-back")]


RECORD = {
    "study": {"id": "S", "study_objective": {"value": "to see"}}, "demographics": {"groups": [{"id": "G1", "count": {"value": 24}, "medical_condition": {"value": "healthy adults"}, "inclusion_criteria": [{"value": "a"}, {"value": " "}, {"value": "adults only"}]}]},
    "tasks": [{"id": "T1", "task_name": {"value": "N-back"}, "conditions": [{"id": "C1", "condition_label": {"value": "rest"}}]}],
}


def test_leaves_and_back(spark):
    rows = spark.createDataFrame([("d", json.dumps(RECORD)), ("e", "{}"), ("f", None)], "document_id string, j string").select("document_id", F.from_json("j", STUDY_RECORD).alias("record"))
    leaves = records.leaves(rows)
    found = {(r.entity, r.entity_id, r.field, r.ordinal): r.value for r in leaves.collect()}
    assert found == {("study", "S", "study_objective", 0): "to see", ("group", "G1", "count", 0): "24", ("group", "G1", "medical_condition", 0): "healthy adults", ("group", "G1", "inclusion_criteria", 0): "a",
                     ("group", "G1", "inclusion_criteria", 2): "adults only", ("task", "T1", "task_name", 0): "N-back", ("condition", "C1", "condition_label", 0): "rest"}
    assert {(r.entity, r.entity_id): r.context for r in records.contexts(leaves).collect()} == {("group", "G1"): "cohort healthy adults", ("task", "T1"): "task N-back"}
    docs = spark.createDataFrame([("d", "We wanted to see.  The 24 healthy\nadults came: adults only. In the N-back task they had a rest.")], "document_id string, text string")
    text = docs.first().text
    back = records.with_evidence(rows, sentences.sentences(docs, raw=True), field_catalog(spark))
    assert sorted(r.document_id for r in back.collect()) == ["d", "e", "f"] and back.schema["record"].dataType.simpleString() == rows.schema["record"].dataType.simpleString()
    held = {(r.field, r.ordinal): r.evidence for r in records.leaves(back).collect()}
    assert all(text[e.char_interval.start_pos : e.char_interval.end_pos] == e.extraction_text for spans in held.values() for e in spans or [])
    assert held["medical_condition", 0][0].extraction_text == "healthy\nadults" and held["condition_label", 0][0].extraction_text == "rest" and held["inclusion_criteria", 2]
    counts = {r.entity: (r.n_values, r.n_with_evidence) for r in records.field_counts(records.leaves(back)).collect()}
    assert counts["task"] == (1, 1) and counts["group"][0] == 4


def test_types_asked_of_a_model():
    kind = records.pruned(entity_type("task"), ["id", "task_name", "conditions"])
    assert kind.simpleString() == "struct<id:string,task_name:string,conditions:array<struct<id:string,condition_label:string>>>"
    schema = records.json_schema(kind)
    assert schema["required"] == ["id", "task_name", "conditions"] and schema["properties"]["task_name"] == {"type": ["string", "null"]}


def test_reviews(spark):
    points = spark.createDataFrame([("d", 5), ("d", 10), ("d", 99), (None, 5)], "k string, at long")
    intervals = spark.createDataFrame([("d", 0, 10, "a"), ("d", 10, 20, "b"), (None, 0, 9, "c")], "k string, start long, end long, name string")
    assert sorted((r.at, r.name or "") for r in records.containing(points, intervals, "k").where("k = 'd'").collect()) == [(5, "a"), (10, "a"), (99, "")]
    spans = spark.createDataFrame([("d", 1, 0, 4), ("d", 2, 0, 9), ("d", 3, 2, 3)], "document_id string, span_id int, start int, end int")
    assert [r.span_id for r in records.display_order(spans, "document_id").orderBy("place").collect()] == [2, 1, 3]
    edits = spark.createDataFrame([("d", 1, 1, 3, None), ("d", 2, 5, 2, None), ("d", 3, None, None, True)], "document_id string, span_id int, start int, end int, removed boolean")
    docs = spark.createDataFrame([("d", "abcdefghij")], "document_id string, text string")
    found = {r.span_id: (r.start, r.end, r.rejected, r.extraction_text) for r in records.edited(spans, edits, docs).collect()}
    assert found == {1: (1, 3, False, "bc"), 2: (0, 9, True, "abcdefghi")}
