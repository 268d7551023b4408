"""Language identification by prediction by partial matching, under frozen statistics.

Each language has a byte context tree of orders 0 to 3. A byte is coded in the longest context that the language has seen: with probability
c / (n + d), n being the context's bytes and d its distinct ones, or after an escape of d / (n + d) in the context one byte shorter;
below order 0 all 256 bytes are alike. As the statistics are frozen, the code length of a byte depends on its context alone; so a batch
of texts looks each of its distinct (context, byte) pairs up once a language, and a text's length is a sum over its bytes. The
language of the shortest code wins; the score is its posterior among the learned languages, each as likely before.

The trees are sorted arrays of what was seen, with every context of the sample, none left out. They are fitted to about ``SAMPLE`` labelled texts of each
language, or, with many languages, about ``ALL_SAMPLES`` of all; texts are drawn by hash and taken whole. So the broadcast model is bounded
by the bytes of that sample: 16 bytes at most for each of its distinct (context, byte) pairs, an order and language each. Every text is scored
whole, a long one in parts that carry their context.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text if no language was learned; ties go to the
first language in code point order; null languages teach nothing; null ids count as the empty text in the split; repeated rows are scored each;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, ALL_SAMPLES = 4000, 200_000
ORDER = 3
CHUNK_BYTES = 1 << 21
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def text_bytes(text: str) -> bytes:
    """What is coded of a text; zeros stand before its first byte."""
    return text.lower().encode()


def gram_keys(data: list[bytes]) -> np.ndarray:
    """(order-3 context, byte) of every byte of the texts, as one number each."""
    return padded_keys([b"\0" * ORDER + x for x in data])


def padded_keys(parts: list[bytes]) -> np.ndarray:
    """The same of parts that begin with the context of their first byte."""
    joined = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    if len(joined) <= ORDER:
        return np.empty(0, np.int64)
    key = joined[:-3] << 24 | joined[1:-2] << 16 | joined[2:-1] << 8 | joined[3:]
    lengths = np.asarray([len(x) for x in parts], dtype=np.int64)
    wanted = np.ones(len(joined), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    for k in range(ORDER):
        wanted[starts + k] = False
    return key[wanted[ORDER:]].astype(np.int64)


def count_grams(training: DataFrame) -> DataFrame:
    """lang, gram and n over ``training`` (lang, text); each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text_bytes(text))
            for lang, data in by_lang.items():
                gram, n = np.unique(gram_keys(data), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    return training.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """One language: for each order the sorted (context, byte) pairs with their bits, and the sorted contexts with the bits of an escape."""

    pairs: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]


def build_tree(gram: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of gram counts (order-3 context and byte); shorter contexts sum up longer ones."""
    tree = Tree([], [], [], [])
    for order in range(ORDER + 1):
        pair, place = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        number = np.bincount(place, weights=n)
        context, at = np.unique(pair >> 8, return_inverse=True)
        whole, kinds = np.bincount(at, weights=number), np.bincount(at)
        tree.pairs.append(pair.astype(np.uint32))
        tree.bits.append(np.log2((whole + kinds)[at] / number))
        tree.contexts.append(context.astype(np.uint32))
        tree.escapes.append(np.log2((whole + kinds) / kinds))
    return tree


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    langs = sorted(counts, key=lambda x: x.encode())
    return Model(langs, [build_tree(*counts[x]) for x in langs])


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys."""
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return place, sorted_keys[place] == keys


def pair_bits(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """Bits of each (order-3 context, byte) pair."""
    bits, left = np.zeros(len(keys)), np.arange(len(keys))
    for order in range(ORDER, -1, -1):
        asked = (keys[left] & ((1 << 8 * (order + 1)) - 1)).astype(np.uint32)
        place, there = _found(tree.pairs[order], asked)
        bits[left[there]] += tree.bits[order][place[there]]
        left, asked = left[~there], asked[~there]
        place, there = _found(tree.contexts[order], asked >> 8)
        bits[left[there]] += tree.escapes[order][place[there]]
    bits[left] += 8
    return bits


def code_lengths(model: Model, texts: list[bytes], chunk: int = CHUNK_BYTES) -> np.ndarray:
    """Bits of each text (not empty) in each language."""
    total = np.zeros((len(texts), len(model.langs)))
    parts, of, held = [], [], 0

    def count() -> None:
        code, distinct = pd.factorize(padded_keys(parts))
        order = np.argsort(distinct)  # neighbours are looked up near each other
        lengths = np.asarray([len(x) - ORDER for x in parts])
        starts = np.cumsum(lengths) - lengths
        for k, tree in enumerate(model.trees):
            bits = np.empty(len(distinct))
            bits[order] = pair_bits(tree, distinct[order])
            np.add.at(total[:, k], of, np.add.reduceat(bits[code], starts))

    for i, text in enumerate(texts):
        padded = b"\0" * ORDER + text
        for at in range(0, len(text), chunk):
            part = padded[at : at + chunk + ORDER]
            if parts and held + len(part) > chunk + ORDER:
                count()
                parts, of, held = [], [], 0
            parts.append(part)
            of.append(i)
            held += len(part)
    if parts:
        count()
    return total


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, all_samples: int = ALL_SAMPLES) -> Model | None:
    """Trees of the languages of ``docs`` outside the held-out quarter."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language; reads no text
    if not sizes:
        return None
    each = min(sample, max(1, all_samples // len(sizes)))
    lot = F.shiftrightunsigned(F.xxhash64("id", "text"), 11).cast("double") / float(2**53)
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(each / n))))
    drawn = usable.where((F.length("text") > 0) & (lot < share[F.col("lang")]))
    table = count_grams(drawn).toArrow()  # at most one row for each byte of the sample
    langs, gram, n = table["lang"].combine_chunks().dictionary_encode(), table["gram"].to_numpy(), table["n"].to_numpy()
    if not len(table):
        return None
    index = langs.indices.to_numpy()
    return build_model({name: (gram[index == k], n[index == k]) for k, name in enumerate(langs.dictionary.to_pylist())})


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score and bits (code length of the best language) of each row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = shared.value
        langs, scores, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        at = [i for i, x in enumerate(texts) if x and LETTER.search(x)] if known else []
        if at:
            total = code_lengths(known, [text_bytes(texts[i]) for i in at])
            best = total.argmin(axis=1)
            least = total[np.arange(len(at)), best]
            scores[at] = 1 / np.exp2(np.maximum(least[:, None] - total, -1000.0)).sum(axis=1)
            bits[at] = least
            for i, k in zip(at, best.tolist()):
                langs[i] = known.langs[k]
        return langs, scores, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0), dtype=np.int64))
            at = 0
            while at < len(batch):
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
                part = batch.slice(at, to - at)
                langs, scores, bits = score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs), pa.array(scores), pa.array(bits)],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits"],
                )
                at = to

    return kept.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on ``docs`` and predict each of its rows."""
    return predict(docs, fit(docs, id_col, text_col, lang_col, **options), id_col, text_col)
