"""Host-level quality rules: document counts, rule failures by host, shrunken host verdicts.

Each document is counted once, over its whole text. Rules turn the counts into failures; failures are summed by host
(partial sums before the shuffle, one row a host after it); a beta prior fitted to the hosts' rates by moments
pulls the rates of hosts with few documents to the common rate; a host is rejected when the shrunken rate of any rule
is above that rule's limit, and its verdict is joined back to its documents.

Defined results: null texts have no words and fail the base rule; null hosts form one host; an empty table gives no
rows; extra columns are dropped; repeated ids stay separate rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.text_units import WORD
from quillstone.session import checkpointed

#: hosts up to this number are broadcast (a row is under 300 bytes); more are joined by shuffle
BROADCAST_HOSTS = 20_000

SYMBOLS = "#*$%&|<>"

#: rule: (failure of a document, highest shrunken rate a host may have)
RULES: dict[str, tuple[str, float]] = {
    "short": ("n_words < 50", 0.5),
    "repetitive": ("100 * n_repeat_words > 50 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "duplicate_lines": ("n_dup_lines > 0 AND 3 * n_dup_lines > n_lines", 0.5),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 10 * n_words", 0.5),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def count_text(text: str | None, find=re.compile(WORD).findall) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = find(text)
    n = len(words)
    lines = [line for line in text.split("\n") if line and find(line)]
    symbols = sum(map(text.count, SYMBOLS))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[str, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
    if len(code) < 2_000_000:  # three codes fit a 63-bit key
        key = (ids[:-2] * len(code) + ids[1:-1]) * len(code) + ids[2:]
    else:
        pair = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * len(code) + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.isin(key, twice)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= found
    return int(covered.sum())


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Id, host and counts of each document."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            rows = [count_text(x) for x in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "host", *names]
            )

    return kept.mapInArrow(run, f"doc_id {fields['doc_id']}, host {fields['host']}, {COUNTS}")


def beta_prior(failed: Column, n: Column) -> tuple[Column, Column]:
    """(alpha, beta) as aggregates over hosts, by the moments of their failure rates.

    The spread between hosts beyond that of sampling sets the prior's weight; the weight lies within 1 and 10,000.
    """
    mean = F.sum(failed) / F.sum(n)
    # expected square of (rate - mean), weighted by documents: mean (1 - mean) (hosts / N) + variance (1 - hosts / N)
    square = F.sum(failed * failed / n) / F.sum(n) - mean * mean
    share = F.count("*") / F.sum(n)
    variance = F.try_divide(square - mean * (1 - mean) * share, 1 - share)
    weight = F.when((variance > 0) & (mean > 0) & (mean < 1), mean * (1 - mean) / variance - 1).otherwise(F.lit(10_000.0))
    weight = F.least(F.greatest(F.coalesce(weight, F.lit(10_000.0)), F.lit(1.0)), F.lit(10_000.0))
    return mean * weight, (1 - mean) * weight


def host_verdicts(counts: DataFrame, rules: dict[str, tuple[str, float]] = RULES) -> DataFrame:
    """One row a host: documents, shrunken rate of each rule, and whether the host is rejected."""
    sums = [F.sum(F.when(F.expr(rule), 1).otherwise(0)).alias(f"failed_{name}") for name, (rule, _) in rules.items()]
    hosts = checkpointed(counts.groupBy("host").agg(F.count("*").alias("n"), *sums))
    priors = []
    for name in rules:
        alpha, beta = beta_prior(F.col(f"failed_{name}").cast("double"), F.col("n").cast("double"))
        priors += [alpha.alias(f"alpha_{name}"), beta.alias(f"beta_{name}")]
    prior = hosts.agg(*priors)  # one row
    rates = {
        name: (F.col(f"failed_{name}") + F.col(f"alpha_{name}")) / (F.col("n") + F.col(f"alpha_{name}") + F.col(f"beta_{name}"))
        for name in rules
    }
    shrunk = hosts.crossJoin(F.broadcast(prior)).select("host", "n", *(rate.alias(f"rate_{name}") for name, rate in rates.items()))
    rejected = F.lit(False)
    for name, (_, limit) in rules.items():
        rejected = rejected | (F.col(f"rate_{name}") > limit)
    return shrunk.withColumn("host_rejected", rejected)


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    rules: dict[str, tuple[str, float]] = RULES,
) -> DataFrame:
    """Counts, base_failed and kept of each document; kept is false where the base rule fails or the host is rejected."""
    counts = checkpointed(document_counts(docs, id_col, text_col, host_col))
    verdicts = host_verdicts(counts, rules).withColumnRenamed("host", "_host").drop("n")
    verdicts = checkpointed(verdicts)
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    judged = counts.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    failed = F.expr(BASE_FAILED)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce("host_rejected", F.lit(False)))
