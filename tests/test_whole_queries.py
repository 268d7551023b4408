"""Queries over all rows against brute force."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quillstone.operators import retrieval
from quillstone.plans import catalog

BASE = "/root/testdata/sf0.01"


def table(name):
    return pq.read_table(f"{BASE}/{name}.parquet").to_pylist()


def test_every_passage_in_every_document(spark):
    asked, docs = table("benchmark"), table("documents")
    wanted = {(b["item_id"], d["doc_id"], d["text"].find(b["text"])) for b in asked for d in docs if b["text"] in (d["text"] or "")}
    found = catalog.QUERIES["q_span_exact"](spark, BASE).collect()
    assert {(r.item_id, r.doc_id, r.start) for r in found} == wanted and len(found) == len(wanted) > 20
    assert all(r.end - r.start == len(asked[r.item_id]["text"]) for r in found if asked[r.item_id]["item_id"] == r.item_id)


def test_exact_spans_of_cut_words_and_short_passages(spark):
    body = "one two  three\nfour five six seven eight nine ten"
    docs = spark.createDataFrame([(1, body), (1, body), (2, None), (3, ""), (None, "x" + body)], "doc_id long, text string")
    passages = ["ne two  three\nfour five six seven eigh", "wo", " two", "", None, "one two three four five six seven eight", body]
    rows = spark.createDataFrame(list(enumerate(passages)), "item_id long, asked string")
    found = sorted((r.item_id, r.doc_id or 0, r.span.start) for r in retrieval.exact_spans(docs, rows).collect())
    assert found == [(0, 0, 2), (0, 1, 1), (0, 1, 1), (1, 0, 6), (1, 1, 5), (1, 1, 5), (2, 0, 4), (2, 1, 3), (2, 1, 3), (6, 0, 1), (6, 1, 0), (6, 1, 0)]


def test_mentions_in_documents_of_all_languages(spark):
    docs = table("documents")
    wanted = {d["doc_id"]: len(re.findall(r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])", d["text"])) for d in docs}
    found = {r.doc_id: r.n_the for r in catalog.QUERIES["q_term_mentions"](spark, BASE).collect()}
    assert found == wanted and len(found) == len(docs) and any(wanted[d["doc_id"]] for d in docs if d["lang"] != "en")


def test_lists_of_odd_texts(spark, tmp_path):
    texts = [None, "", " ", ";", "none", " N/A ", "NULL", "na", "a; b|c,", "\u00a0a\u3000;\u2003", "\u2003", "\ta\n, b", "none;null", ",,x\u200b", "\u2028a;"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    wanted = connection.sql(catalog.ORACLE_SQL["q_split_list"]).fetchall()
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        found = [tuple(r) for r in catalog.QUERIES["q_split_list"](spark, str(tmp_path)).collect()]
        spark.conf.unset("spark.sql.ansi.enabled")
        assert sorted(found) == sorted(wanted)
