import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import license_scan, ppm_language, queries, topk_search
from quillstone.llm.license_rules import RULES
from tests.llm.conftest import SCHEMA, awkward_rows


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 500)  # several rounds
    monkeypatch.setattr(topk_search, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (220, 5)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, vector array<long>").repartition(7)
    found = topk_search.top_k(df.where("vec_id % 20 = 0"), df, "vec_id", "vector", 7).collect()
    for q in range(0, 220, 20):
        scores = sorted((-int(np.dot(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q)[:7]
        assert [(-r.score, r.id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == scores


def test_top_k_awkward(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [inf, 0.0]), (5, [1.0, 0.5]), (6, [0.25]), (None, [1.0, 1.0]), (7, []), (5, [1.0, 0.5]), (100, [-1.0, 2.0])]
    raw = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash")).withColumn("id", F.lit(1))
    df = raw.where(topk_search.usable(F.col("embedding"))).select("*", topk_search.quantised(F.col("embedding")).alias("vector"))
    found = topk_search.top_k(df.where("vec_id % 100 = 0"), df, "vec_id", "vector", 10).collect()
    assert [(r.id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0] == [(5, 1310720), (5, 1310720), (6, 262144), (7, 0), (100, 0)]
    none = df.where("vec_id < 0")
    assert topk_search.top_k(none, df, "vec_id", "vector").count() == 0 and topk_search.top_k(none, none, "vec_id", "vector").count() == 0


def test_tiles_keep_ties_by_id():
    rng = np.random.default_rng(9)
    queries, q_ids = rng.integers(-2, 3, (5, 4)), np.array([3, 40, 41, 500, 3])
    ids, vectors = rng.permutation(90), rng.integers(-2, 3, (90, 4))
    best = topk_search.BestLists(q_ids, queries, 6)
    for at in range(0, 90, 13):
        best.add(ids[at : at + 13], vectors[at : at + 13])
    for i, (scores, held) in enumerate(best.lists):
        right = sorted((-int(s), int(x)) for x, s in zip(ids, vectors @ queries[i]) if x != q_ids[i])[:6]
        assert [(-int(s), int(x)) for s, x in zip(scores, held)] == right


def test_large_products_stay_exact():
    big = np.full((1, 3), 2**28, dtype=np.int64)
    assert topk_search._products(big, big)[0, 0] == 3 * 2**56


def brute_bits(trees, data: bytes) -> float:
    """Code length by walking from the longest context down."""
    total, padded = 0.0, b"\0" * 3 + data
    for i in range(3, len(padded)):
        symbol, bits = padded[i], 0.0
        for order in (3, 2, 1, 0):
            seen = trees.get(padded[i - order : i] if order else b"", None) if order else trees.get(b"")
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                bits -= math.log2(seen[symbol] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
        total += bits
    return total


def trees_of(texts):
    trees = {}
    for t in texts:
        padded = b"\0" * 3 + ppm_language.text_bytes(t)
        for i in range(3, len(padded)):
            for order in range(4):
                key = padded[i - order : i] if order else b""
                trees.setdefault(key, {}).setdefault(padded[i], 0)
                trees[key][padded[i]] += 1
    return trees


def test_code_lengths_are_exact():
    teach = {"en": ["the cat sat on the mat", "a dog and the cat"], "fr": ["le chat est là", "un chien et le chat"]}
    counts = {}
    for lang, texts in teach.items():
        counts[lang] = np.unique(ppm_language.gram_keys([ppm_language.text_bytes(t) for t in texts]), return_counts=True)
    model = ppm_language.build_model(counts)
    data = [ppm_language.text_bytes(x) for x in ("the chat", "un the zzz", "é", "qqq the cat là 日本")]
    bits = ppm_language.code_lengths(model, data)
    for k, lang in enumerate(model.langs):
        trees = trees_of(teach[lang])
        for row, text in enumerate(data):
            assert abs(bits[row, k] - brute_bits(trees, text)) < 1e-6, (lang, text)
    # a long text in parts, and texts that share a part
    for chunk in (1, 4, 7):
        assert np.allclose(ppm_language.code_lengths(model, data, chunk), bits)


def test_every_context_of_the_sample_is_kept():
    rng = np.random.default_rng(3)
    data = [bytes(rng.integers(97, 123, 40_000).astype(np.uint8))]
    model = ppm_language.build_model({"a": np.unique(ppm_language.gram_keys(data), return_counts=True)})
    assert len(model.trees[0].contexts[3]) > 15_000
    text = [data[0][5000:5200]]
    assert abs(ppm_language.code_lengths(model, text)[0, 0] - brute_bits(trees_of([data[0].decode()]), text[0])) < 1e-6


def test_language_held_out_and_awkward(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = ppm_language.identify(docs).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert n.a > 0.97
    rows = ppm_language.identify(awkward).collect()
    assert len(rows) == len(awkward_rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5)) and all(0 <= r.score <= 1 for r in rows)
    assert ppm_language.identify(empty).count() == 0
    assert {r.lang_pred for r in ppm_language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def needs(pattern: str) -> str:
    """A pattern without what may be absent from a match."""
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\((?:\?:)?[^()]*\)[?*]", "~", pattern)
    return pattern.replace("(?= )", " ").replace("licen[sc]e", "license")


def test_every_signature_passes_the_gate():
    assert len(RULES) > 250
    assert not [r for r in RULES if not any(g in r[2] or g in needs(r[3]) for g in license_scan.GATE)]


def a_match(parsed, rng):
    """A text that a parsed pattern matches; optional parts, branches and characters are drawn."""
    out = ""
    for op, what in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(what)
        elif kind == "ANY":
            out += "x"
        elif kind == "IN":
            of, value = rng.choice(what)
            out += chr(value) if str(of) == "LITERAL" else chr(rng.randint(*value))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, part = what
            out += "".join(a_match(part, rng) for _ in range(rng.randint(least, min(most, least + 2))))
        elif kind == "SUBPATTERN":
            out += a_match(what[3], rng)
        elif kind == "BRANCH":
            out += a_match(rng.choice(what[1]), rng)
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
    return out


def test_every_match_holds_the_keyword_and_passes_the_gate():
    rng = random.Random(5)
    for _, _, keyword, pattern in RULES:
        parsed = re._parser.parse(pattern)
        for _ in range(60):
            text = a_match(parsed, rng) + " "
            assert re.search(pattern, text), (pattern, text)
            assert keyword in text and any(g in text for g in license_scan.GATE), (pattern, text)


def test_notices_with_their_optional_parts(spark):
    cases = {"Under a BSD-style license.": "bsd", "Under the MIT/X11 licence.": "mit", "All rights are reserved.": "reserved", "Do not copy or distribute.": "do-not-distribute"}
    found = scanned(spark, list(cases))
    assert {t: found[i].labels for i, t in enumerate(cases)} == cases


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(docs).collect()}


def test_signatures(spark):
    cases = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "All rights reserved.": "reserved", "SPDX-License-Identifier: BSD 3-Clause": "bsd-3-clause", "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
        "Mozilla Public License 2.0": "mpl-2.0", "nothing of the kind": "", "mit der Zeit": "",
    }
    found = scanned(spark, list(cases))
    assert {t: found[i].labels for i, t in enumerate(cases)} == cases


def brute_settled(norm):
    """All matches, taken best first, against those already taken; by Python's own regular expressions."""
    found = {(m.start(), m.end(), order, label) for label, order, keyword, pattern in RULES if keyword in norm for m in re.finditer(pattern, norm)}
    kept = []
    for start, end, order, label in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[3])):
        over = [k for k in kept if k[0] < end - 1 and start < k[1] - 1]
        if not any(k[2] < order or (k[0] <= start and end <= k[1]) for k in over):
            kept.append((start, end, order, label))
    return sorted(kept)


def test_detections_against_brute_force(spark):
    rng = random.Random(11)
    parsed = [re._parser.parse(p) for _, _, _, p in RULES]
    texts = ["".join(a_match(rng.choice(parsed), rng) + rng.choice(["", " ", " word"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["gpl " * 3000, " ".join(a_match(rng.choice(parsed), rng) for _ in range(1500)), "GNU GPL v3 or later general public license 3.0.1", "cc by cc by sa 4.0 creative commons attribution"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text RLIKE '(?i)licen|reserved|copyright|cc by'")
    texts += [r.text for r in docs.collect()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in license_scan.scan(rows).collect():
        text = texts[r.doc_id]
        norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", f" {text.translate(lower)} ")
        right = brute_settled(norm)
        assert sorted((d.start, d.end, d.order, d.label) for d in r.detections) == right, text[:200]
        names = sorted({x[3] for x in right} | set(filter(None, brute_scan(text)[4].split(","))))
        score = 1 - math.prod(0.1 if re.search("-[0-9]", x) else 0.4 for x in names)
        assert r.labels == ",".join(names) and abs(r.score - score) < 1e-8


def test_a_suppressed_detection_suppresses_nothing(spark):
    hits = [(0, 20, 1, "a"), (10, 30, 5, "b"), (22, 40, 9, "c"), (60, 70, 5, "d"), (62, 68, 5, "e"), (60, 70, 5, "f")]
    rows = spark.createDataFrame([(hits,), ([],)], "hits array<struct<start:int,end:int,order:int,label:string>>")
    found = [[h.label for h in r.x] for r in rows.select(license_scan.unsuppressed(F.col("hits")).alias("x")).collect()]
    assert [sorted(x) for x in found] == [["a", "c", "d"], []]


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_against_brute_force(spark, awkward, empty):
    texts = [None, "", "CC BY CC-BY ccby cc by", "all rights reserved all rights all rights reserved", "İCC by café-cc BY", "general public license general public license!", "...", "a"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200)
    texts += [r.text for r in docs.collect()]
    for i, r in scanned(spark, texts).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(texts[i]), texts[i]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.scan(awkward).count() == len(awkward_rows()) and license_scan.scan(empty).count() == 0


def test_queries_are_complete():
    numbers = sorted(int(re.match(r"op(\d+)_", name).group(1)) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
