import pandas as pd
from pyspark.sql import functions as F

from quillstone.functions import parse, text
from quillstone.functions.types import EDGES, FAMILY_WORDS, STUDY_RECORD, field_catalog
from quillstone.operators import entities, evidence, models, sentences, spans
from quillstone.sources import sinks
from quillstone.streaming.incremental import process_stream


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_text_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, text.collapse(a), a=" a  b\n\tc ") == "a b c"
    assert [one(spark, text.null_token(a), a=x) for x in (" N/A ", "none", "x ", None)] == [None, None, "x", None]
    assert one(spark, text.tokens(a), a="Don't É stop-2") == ["don't", "stop", "2"]
    assert one(spark, text.is_reference_heading(a), a="## References and Notes:") and not one(spark, text.is_reference_heading(a), a="referenced")
    assert one(spark, text.enum_text(a), a="EventRelated_x/y") == "event related x y"
    assert one(spark, text.filled(a, value=b), a="v is {value}.", b="3") == "v is 3."
    assert one(spark, text.table_number(a), a="Tbl. 12: x") == "12"
    assert one(spark, text.mentions(a, b), a="MRI fMRI MRI, (MRI) a.c", b="MRI") == 3
    families = one(spark, F.array(*(text.mapped(text.enum_text(F.lit(x)), FAMILY_WORDS) for x in ("functional MRI", "DTI", "xray"))), a="")
    assert families == ["fMRI", "DiffusionMRI", None]


def test_parsing(spark):
    a = F.col("a")
    assert [one(spark, parse.parse_int(a), a=x) for x in ("1,234 people", "-3", "abc", None)] == [1234, -3, None, None]
    assert one(spark, parse.parse_float(a), a="about 2.5 s") == 2.5
    assert one(spark, parse.parse_list(a), a="a; b|c,") == ["a", "b", "c"] and one(spark, parse.parse_list(a), a="n/a") is None
    assert [one(spark, parse.value_text(a, "double"), a=x) for x in (24.0, 0.5, 1234567.0, 0.0)] == ["24", "0.5", "1.23457e+06", "0"]


def test_sections_and_references(spark):
    docs = spark.createDataFrame([("d", "One. Two here.\n# Methods\nWe did. It worked.\n| a | b |\n| --- | --- |\n| 1 | 2 |\n# References\nSmith.")], "document_id string, text string")
    rows = {(r.section, r.source_type, r.record) for r in sentences.section_records(docs).collect()}
    assert rows == {("Document", "sentence", "One."), ("Document", "sentence", "Two here."), ("Methods", "sentence", "We did."), ("Methods", "sentence", "It worked."),
                    ("Methods", "table", "| a | b |\n| --- | --- |\n| 1 | 2 |")}
    marks = spark.createDataFrame([("d", 0, "Document"), ("d", 10, "Methods")], "document_id string, start long, title string")
    items = spark.createDataFrame([("d", 0), ("d", 9), ("d", 10)], "document_id string, start long")
    assert [r.section for r in sentences.with_section(items, marks).orderBy("start").collect()] == ["Document", "Document", "Methods"]
    lines = [f"line {i}" for i in range(30)] + ["# References:"] + [f"{i}. Author (1999). doi: x" for i in range(9)]
    kept = sentences.strip_references(spark.createDataFrame([("a", "\n".join(lines)), ("b", "\n".join([*lines, "# Appendix A", "more"])), ("c", "short\nReferences")], "document_id string, text string"))
    found = {r.document_id: r for r in kept.collect()}
    assert found["a"].text == "\n".join(lines[:30]) and found["b"].text == "\n".join([*lines[:30], "# Appendix A", "more"]) and not found["c"].stripped


def test_entities(spark):
    rows = spark.createDataFrame([("d", 0, "Healthy controls"), ("d", 1, "healthy  controls"), ("d", 2, "Patients"), ("d", 3, None), ("d", 4, None)], "document_id string, idx long, label string")
    found = [(r.entity_id, r.label, r.n_mentions) for r in entities.group_mentions(rows, F.col("label")).orderBy("first_idx").collect()]
    assert found == [("G1", "Healthy controls", 2), ("G2", "Patients", 1), ("G3", None, 1), ("G4", None, 1)]
    ids = spark.createDataFrame([("d", 0, None), ("d", 1, "G1"), ("d", 2, None)], "document_id string, pos long, id string")
    assert [r.id for r in entities.fill_ids(ids, "document_id", "pos", "id", "G").orderBy("pos").collect()] == ["G2", "G1", "G3"]
    stub = spark.createDataFrame([(1, None, "x")], "k long, a string, b string")
    fill = spark.createDataFrame([(1, "new", "new")], "k long, a string, b string")
    assert entities.fill_fields(stub, fill, ["k"], ["a", "b"]).first()[:] == (1, "new", "x")


def test_spans_and_chunks(spark):
    assert spans.collapse_map("a  b\nc") == ("a b c", [0, 1, 3, 4, 5])
    assert spans.match_span("xx hello", "hello") == (3, 8, "match_exact") and spans.match_span("the hallo world", "hello world")[2] == "match_fuzzy" and spans.match_span("a", "zzz") is None
    out, places = spans.expand("use MRI, fMRI", [("MRI", "magnetic imaging"), ("fMRI", "functional MRI")])
    assert out == "use magnetic imaging, functional MRI" and len(places) == len(out) and places == sorted(places)
    assert spans.find_abbreviations("magnetic resonance imaging (MRI) and some (text)") == [("MRI", "magnetic resonance imaging")]
    body = "# A\n" + "w " * 30 + "\n\n" + "v " * 30 + "\n# B\nshort one"
    for start, chunk in spans.chunk_text(body, 40, 5):
        assert body[start : start + len(chunk)] == chunk and len(chunk.split()) <= 40
    assert [c.strip()[:3] for _, c in spans.chunk_text(body, 40, 5)] == ["# A", "v v", "# B"]


def test_evidence_cascade(spark):
    said = [("d", 0, "Twenty four patients took part.", 0), ("d", 1, "Their mean age was 31.5 years.", 32), ("d", 2, "Scans were made at 3 tesla.", 63)]
    rows = spark.createDataFrame(said, "document_id string, sentence_id int, sentence string, start long")
    values = spark.createDataFrame([("d", "group", "G1", "cohort_label", 0, "patients took part", ""), ("d", "group", "G1", "medical_condition", 0, "zebra", ""), ("d", "study", "S", "study_objective", 0, " ", "")],
                                   "document_id string, entity string, entity_id string, field string, ordinal int, value string, context string")
    found = evidence.find_evidence(values, rows, field_catalog(spark)).collect()
    assert [(r.field, r.start, r.end, r.alignment_status, r.stage) for r in found] == [("cohort_label", 12, 30, "match_exact", "single")]
    models.register_model("support", lambda premises, hypotheses: premises.str.contains("tesla"))
    try:
        found = evidence.find_evidence(values.where("value = 'zebra'"), rows, field_catalog(spark)).collect()
        assert [(r.extraction_text, r.stage) for r in found] == [("Scans were made at 3 tesla.", "model")]
    finally:
        models.register_model("support", None)


def test_confirm_and_models(spark):
    docs = spark.createDataFrame([("d", "# Methods\nThe study includes group patients. Nothing else.")], "document_id string, text string")
    asked = spark.createDataFrame([("d", "group", "patients"), ("d", "task", "zebra race")], "document_id string, entity_type string, entity string")
    found = {r.entity: r for r in evidence.confirm(asked, sentences.section_records(docs)).collect()}
    assert found["patients"].confirmed and not found["zebra race"].confirmed and found["patients"].section_title == "Methods"
    models.register_model("entail", lambda p, h: pd.DataFrame({"entailment": [1.0] * len(p), "neutral": 0.0, "contradiction": 0.0}))
    try:
        assert all(r.confirmed for r in evidence.confirm(asked, sentences.section_records(docs)).collect())
    finally:
        models.register_model("entail", None)


def test_record_round_trip_and_sinks(spark, tmp_path):
    data = '{"study": {"id": "S", "study_type": {"value": "Review", "evidence": [{"source": "text", "char_interval": {"start_pos": 1, "end_pos": 4}}]}}, "links": {"group_task": [{"source_id": "G1", "target_id": "T1"}]}}'
    rows = spark.createDataFrame([("d", data)], "document_id string, j string").select("document_id", F.from_json("j", STUDY_RECORD).alias("r"))
    sinks.write_records(rows, str(tmp_path / "out"), ["document_id"])
    back = spark.read.json(str(tmp_path / "out"))
    assert back.first().r.study.study_type.value == "Review" and set(STUDY_RECORD["links"].dataType.names) == set(EDGES)
    more = spark.createDataFrame([("d",), ("e",)], "document_id string")
    assert [r[0] for r in sinks.not_done(more, back, ["document_id"]).collect()] == ["e"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "One. Two."), ("b", "Three.")], "document_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        process_stream(spark, str(tmp_path / "in"), "document_id string, text string", sentences.sentences, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
