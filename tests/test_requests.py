"""Requests with retries, alignment, names, mentions, caches and abbreviation files."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import models, requests
from quillstone.sources import bundles, sinks

PROMPT = requests.Prompt("group", "Find groups.", ("count", "cohort_label"), examples=({"text": "24 men", "attributes": {"count": "24", "odd": 1}},), overrides={"count": "a number"})


def test_prompts(tmp_path):
    said = PROMPT.text("the text", "G1")
    assert "- count: a number" in said and '"count": "24"' in said and "odd" not in said and said.endswith("Only about: G1\nthe text")
    (tmp_path / "group.json").write_text(json.dumps({"version": 1, "entity": "group", "extraction_class": "Group", "prompt_description": "x", "fields": ["count"], "examples": []}))
    assert requests.read_prompts(str(tmp_path), ["group"])["group"].fields == ("count",)
    with pytest.raises(FileNotFoundError):
        requests.read_prompts(str(tmp_path), ["task"])


def test_errors_that_pass_are_tried_again():
    said, waits = iter([RuntimeError("429 Too Many"), RuntimeError("server overloaded"), "ok"]), []

    def call():
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    assert requests.attempt(call, sleep=waits.append) == ("ok", None, 3) and len(waits) == 2 and waits[0] <= 2 and waits[1] <= 4

    def bad():
        raise ValueError("bad request")

    assert requests.attempt(bad, sleep=waits.append)[1:] == ("ValueError: bad request", 1)


def test_alignment():
    text = "Twenty-four healthy  adults (mean age 31) took part in the study."
    assert requests.align(text, "HEALTHY  adults") == (12, 27, "match_exact")
    a, b, status = requests.align(text, "mean age 31) took part in a trial of medicine and other things", 0.3)
    assert status == "match_lesser" and text[a:b].startswith("mean age")
    a, b, status = requests.align(text, "tok part in the studies")
    assert status == "match_fuzzy" and text[a:b] == "took part in the study."
    assert requests.align(text, "zebra race on ice") is None and requests.align("", "x") is None and requests.align(text, " ") is None


def test_requests_as_rows(spark):
    docs = spark.createDataFrame([("d", "24 healthy men came."), ("e", None), ("f", "fail")], "document_id string, text string")
    asked = requests.asked(docs, {"group": PROMPT}, passes=2)
    assert asked.count() == 4

    def model(prompt):
        if prompt.endswith("fail"):
            raise ValueError("no")
        return json.dumps({"extractions": [{"extraction_class": "Group", "extraction_text": "healthy men", "attributes": {"count": 24, "tags": ["a"]}}]})

    models.register_model("request", model)
    try:
        answers = requests.answered(asked)
        rows = answers.collect()
        assert sum(r.error == "ValueError: no" for r in rows) == 2 and sum(r.answer is not None for r in rows) == 2
        found = requests.extracted(answers, docs).collect()
        assert [(r.document_id, r.start, r.end, r.attributes) for r in found] == [("d", 3, 14, {"count": "24", "tags": '["a"]'})] * 2
    finally:
        models.register_model("request", None)
    assert {r.error for r in requests.answered(asked).collect()} == {"no model"}


def test_names_mentions_and_records(spark):
    names = spark.createDataFrame([("d", "task", 0, "N-back"), ("d", "task", 1, "n-BACK "), ("d", "task", 2, " "), ("d", "group", 3, "N-back")], "document_id string, kind string, pos int, name string")
    edges = spark.createDataFrame([("d", "x", 0, "a", "b"), ("d", "x", 1, "A", "B"), ("d", "x", 2, "a", None)], "document_id string, kind string, pos int, source string, target string")
    a, b = requests.names_and_edges(names, edges)
    assert sorted(r.pos for r in a.collect()) == [0, 3] and [r.pos for r in b.collect()] == [0]
    docs = spark.createDataFrame([("d", "one two three. \n\n" * 3 + "MRI here")], "document_id string, text string")
    models.register_model("ner", lambda text: [("scan", "MRI", 0.9, text.find("MRI"), text.find("MRI") + 3), ("scan", "x", 0.1, 0, 1)] if "MRI" in text else [])
    try:
        r = requests.entity_mentions(docs, 4, 1).collect()
        assert len(r) == 1 and docs.first().text[r[0].start : r[0].end] == "MRI"
    finally:
        models.register_model("ner", None)
    held = spark.createDataFrame([("d", '{"a":1}'), ("e", '{"a":2}')], "document_id string, record string")
    told = spark.createDataFrame([("d", '{"corrected":{"a":3},"changes":["a"]}')], "document_id string, answer string")
    assert {r.document_id: (r.record, r.verified) for r in requests.verified(held, told).collect()} == {"d": ('{"a":3}', True), "e": ('{"a":2}', False)}


def test_caches_and_abbreviations(spark, tmp_path):
    rows = spark.createDataFrame([("m", "h1", "s1", [1.0])], "model string, document_hash string, sentence_hash string, vector array<double>")
    sinks.write_vectors(rows, str(tmp_path / "v"))
    asked = spark.createDataFrame([("h1", "s1"), ("h1", "s2"), ("h2", "s1")], "document_hash string, sentence_hash string")
    held, lacks = sinks.cached_vectors(asked, spark.read.parquet(str(tmp_path / "v")), "m")
    assert held.count() == 1 and lacks.count() == 2 and sinks.cached_vectors(asked, rows, "other")[1].count() == 3
    sinks.write_ordered(spark.range(50).select((49 - F.col("id")).alias("n")).repartition(5), str(tmp_path / "o"), ["n"])
    lines = [json.loads(x)["n"] for f in sorted((tmp_path / "o").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == list(range(50))
    pairs = [("MRI", "magnetic imaging"), ("mri", "MRI"), ("x", "long"), ("ab", "long"), ("AB", "long"), ("Q1", "a|b"), ("  ", "y"), ("ok", None)]
    value = json.dumps([{"short": s, "long": x} for s, x in pairs])
    files = spark.createDataFrame([("d", value), ("e", "no json"), ("f", json.dumps({"abbreviations": [{"short": "EEG", "long": "waves"}]})), ("g", None)], "document_id string, value string")
    assert sorted((r.document_id, r.short) for r in bundles.abbreviation_pairs(files).collect()) == [("d", "AB"), ("d", "MRI"), ("f", "EEG")]
