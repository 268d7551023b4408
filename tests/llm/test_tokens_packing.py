import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import packing, repair, tokens
from quillstone.llm.tokens import Encoder, default_vocabulary, ragged_take
from quillstone.session import written
from tests.llm.conftest import awkward_rows

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
ODD = [None, "", " ", "  ", "a  b", " x", "x ", "a\n b", "a \n b", "\n", "naïve x　y z", "x\ty  ", "<|endoftext|> hi", "é" * 50, "don't we'll  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(default_vocabulary())
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("cache", [0, 3, 10_000])
def test_encoder_equals_the_library(library, cache):
    encoder = Encoder(default_vocabulary(), cache)
    for texts in (ODD, [r[1] for r in awkward_rows()], ODD[::-1], []):
        s = encoder.encode(pa.array(texts, pa.string()))
        ids, ends = ragged_take(s.flat, s.starts[s.codes], s.lengths[s.codes]), np.cumsum(s.token_counts())
        for text, a, b in zip(texts, np.append(0, ends), ends):
            assert ids[a:b].tolist() == library(text), text


def test_library_calls_are_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "CALL_BYTES", 500)
    encoder, calls = Encoder(default_vocabulary()), []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            calls.append(sum(map(len, texts[:-1])))
            return real.encode_batch_fast(texts, **options)

    real, encoder.library = encoder.library, Watched()
    texts = [f"w{i} of\n {i}  x" for i in range(200)] + [" ".join(f"v{i}" for i in range(3000))]
    s = encoder.encode(pa.array(texts))
    ids, ends = ragged_take(s.flat, s.starts[s.codes], s.lengths[s.codes]), np.cumsum(s.token_counts())
    assert [ids[a:b].tolist() for a, b in zip(np.append(0, ends), ends)] == [library(t) for t in texts]
    assert max(calls) < 500


WORKER = """
import random, resource, pyarrow as pa
from quillstone.llm import packing, tokens
rng = random.Random(3)
texts = pa.array([" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(1000)) for _ in range(1500)])
batch = pa.record_batch([pa.array(range(1500)), texts], names=["id", "text"])
encoder, filler = tokens.Encoder(tokens.default_vocabulary()), packing.ClassFiller(1024, 0)
for ids, chunk in tokens.text_chunks(iter([batch]), packing.CHUNK_BYTES):
    packing._pieces(encoder.encode(chunk), ids, filler, 0, 1024, 0)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_memory_of_a_packing_worker():
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(packing.__file__)) + "/..")
    assert int(out.stdout) < 420, out.stderr


def test_grammar_round_trip_and_random_access(library):
    texts = [r[1] for r in awkward_rows()] + ["the cat sat on the mat. " * 300]
    encoder = Encoder(default_vocabulary())
    shard = repair.Shard(repair.encode_shard(encoder.encode(pa.array(texts)), list(range(len(texts))), 50257, 2))
    for i in reversed(range(len(texts))):
        assert shard.document(i).tolist() == library(texts[i]) + [2]
    assert len(shard.rules) and len(shard.symbols) < shard.id_starts[-1]


def test_overlapping_pairs():
    flat, lengths, rules = repair.grow_grammar(np.full(101, 5), np.array([1, 100]), np.array([1.0, 40.0]), 256)
    grown, starts, size = repair.expansions(rules, 256)
    assert lengths.sum() == len(flat)
    assert ragged_take(grown, starts[flat], size[flat]).tolist() == [5] * 101


def test_grammar_grows_until_no_pair_is_frequent():
    rng = np.random.default_rng(6)
    flat = rng.integers(0, 6, 6000)
    out, lengths, rules = repair.grow_grammar(flat, np.full(60, 100), np.ones(60), 256)
    pairs = {}
    at = 0
    for n in lengths:
        for a, b in zip(out[at : at + n], out[at + 1 : at + n]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
        at += n
    assert len(rules) and max(pairs.values()) < 2 * repair.LEAST_COUNT
    grown, starts, size = repair.expansions(rules, 256)
    assert np.array_equal(ragged_take(grown, starts[out], size[out]), flat)


def test_rules_cross_word_starts(library):
    phrase = "licensed under the terms of the agreement between all parties\n"
    texts = [phrase * k for k in (0, 1, 8, 40)]
    encoder = Encoder(default_vocabulary())
    shard = repair.Shard(repair.encode_shard(encoder.encode(pa.array(texts)), [1, 2, 3, 4], 50257, 2))
    for i, text in enumerate(texts):
        assert shard.document(i).tolist() == library(text) + [2]
    assert np.diff(shard.symbol_starts)[3] < 40  # under a symbol a phrase of ten words


def test_ids_beyond_the_symbols_are_an_error():
    encoder = Encoder(default_vocabulary())
    with pytest.raises(ValueError):
        repair.encode_shard(encoder.encode(pa.array(["a"])), [1], 70_000, 2)
    with pytest.raises(ValueError):
        repair.encode_shard(encoder.encode(pa.array(["a"])), [1], 50_257, 65_536)


def test_file_of_awkward_rows(spark, awkward, library, tmp_path):
    rows = repair.round_trip(spark, awkward, f"file://{tmp_path}", shard_bytes=5000).collect()
    expected = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.id for r in sorted(rows, key=lambda r: r.start)] == [r[0] for r in expected]
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    found = sorted((r.id or -1, zlib.crc32(bytes(r.ids))) for r in rows)
    assert found == sorted((r[0] or -1, zlib.crc32(np.array(library(r[1]) + [2], "<u4").tobytes())) for r in expected)


def test_pack_awkward_rows(awkward, library):
    rows = packing.pack(awkward).collect()
    by_seq, total = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(library(x[1])) + 1 for x in awkward_rows())
    whole = {r.doc_id: r.doc_tokens for r in rows}
    assert whole[6] == len(library(awkward_rows()[6][1])) + 1
    parts = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 6)
    assert b"".join(x for _, x in parts) == np.array(library(awkward_rows()[6][1]) + [0], "<u4").tobytes()


def test_packing_bounds_the_batches(spark, awkward, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "written", lambda df, label: seen.append(spark.conf.get(NAME)) or written(df, label))
    before = spark.conf.get(NAME)
    assert packing.pack(awkward).count() and seen == [str(packing.BATCH_BYTES)] and spark.conf.get(NAME) == before


def test_cuts_cover_every_length():
    counts = np.arange(1, 3000)
    document, start, length = packing.cut_documents(counts, 1024)
    assert np.array_equal(np.bincount(document, weights=length).astype(int), counts)
    assert (length > 0).all() and (length <= 1024).all()
    first = np.flatnonzero(np.diff(document, prepend=-1))
    assert (start[first] == 0).all()


def test_little_padding(spark, sf):
    d = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    n = d.agg(F.count("*").alias("s"), F.sum("n").alias("t")).first()
    assert n.t / (1024 * n.s) > 0.97


def test_empty_tables(spark, empty, tmp_path):
    assert repair.round_trip(spark, empty, f"file://{tmp_path}/x").count() == 0
    assert packing.pack(empty).count() == 0
