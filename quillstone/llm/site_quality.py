"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

A logistic model over counts of the text gives each document a probability of being good. The model is fitted to at
most ``SAMPLE`` labelled documents (those with the smallest hashes of their ids). Everything else covers all rows:
good mass is summed by host and by path within the host, labels standing in for probabilities where there are any. The
beta priors come from the moments of the rates, so a sparse host is drawn to the common rate and a sparse path to its
host. A document's own mass, its label where it has one, is left out of its site's rate. The posterior log-odds are the document's plus the site's
in excess of the common rate's.

The texts are read once for their counts, which are kept with a row number; all else works on these small rows. Only ids, labels and grouped sums
are shuffled. A verdict meets its text again by the row number, in place while the rejected rows fit a broadcast.

Defined results: null and empty texts have zero counts and are judged by these; null hosts or paths form one group; repeated labels of
a document count by their mean, null labels and labels without a document not at all; without labels of both kinds all documents are kept;
repeated rows are judged each; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.host_rules import beta_prior
from quillstone.session import checkpointed, numbered

SAMPLE = 20_000
#: sites up to this number are broadcast (a row is under 200 bytes); more are joined by shuffle
BROADCAST_SITES = 20_000
#: rejected rows of one long up to this number are broadcast (16 MB at most); more are joined by shuffle
BROADCAST_ROWS = 500_000


def _among(text: Column, characters: str) -> Column:
    """How many code points of ``text`` match the character class."""
    return F.regexp_count(text, F.lit(characters)).cast("double")


def base_counts(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.struct(
        F.length(text).cast("double").alias("chars"),
        F.size(words).cast("double").alias("words"),
        F.size(F.array_distinct(words)).cast("double").alias("distinct_words"),
        F.size(lines).cast("double").alias("lines"),
        F.size(F.array_distinct(lines)).cast("double").alias("distinct_lines"),
        _among(text, r"[#*$%&|<>{}\[\]~^=_\\/]").alias("symbols"),
        _among(text, "[.,;:!?]").alias("stops"),
        _among(text, "[0-9]").alias("digits"),
        _among(text, "[A-Z]").alias("capitals"),
        _among(text, r"\|").alias("bars"),
    )


def features(c: Column) -> Column:
    """Scale-free features of the counts ``c``."""
    n = F.greatest(c["words"], F.lit(1.0))
    size = F.log1p(c["words"])
    variety = c["distinct_words"] / n
    return F.array(
        size, size * size, c["chars"] / n, variety, variety * size, variety * variety,
        c["symbols"] / n, F.sqrt(c["symbols"] / n), c["bars"] / n, c["stops"] / n, c["digits"] / n, c["capitals"] / n,
        F.log1p(n / F.greatest(c["lines"], F.lit(1.0))), c["distinct_lines"] / F.greatest(c["lines"], F.lit(1.0)),
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method; constants where the labels are of one kind."""
    if len(y) == 0 or y.min(initial=1) == y.max(initial=0):
        return np.zeros(x.shape[1] if x.ndim == 2 else 0), 30.0 if len(y) == 0 or y.max() > 0 else -30.0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def document_odds(counts: Column, weights: list[float], intercept: float) -> Column:
    """Log-odds of the logistic model."""
    dot = F.aggregate(F.zip_with(features(counts), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)
    return F.greatest(F.least(dot, F.lit(30.0)), F.lit(-30.0))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def scores(
    rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE,
) -> DataFrame:
    """row, id, p_document, host_rate, path_rate, p_good and kept of rows that ``session.numbered`` gave."""
    held = F.col("doc").getField
    slim = checkpointed(rows.select("row", held(id_col).alias("_id"), held(host_col).alias("_host"), held(path_col).alias("_path"), base_counts(held(text_col)).alias("_counts")))
    truth = checkpointed(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(
        F.avg(F.col(label_col).cast("double")).alias("_label")
    ))
    known = slim.join(truth, F.col("_id") == F.col("_label_id"))
    # a share of hashes that gives a little more than the sample, so that tasks send the driver no more than it keeps
    lot = F.shiftrightunsigned(F.xxhash64("_id"), 11).cast("double") / float(2**53)
    share = min(1.0, 1.2 * sample / max(1, truth.count()))
    drawn = known.where(lot < share).orderBy(lot, "_id", "row").limit(sample)
    shown = drawn.select(features(F.col("_counts")).alias("x"), "_label").collect()
    x = np.asarray([r.x for r in shown], dtype=float).reshape(len(shown), len(shown[0].x) if shown else 0)
    weights, intercept = fit_logistic(x, np.asarray([r._label >= 0.5 for r in shown], dtype=float))
    odds = document_odds(F.col("_counts"), weights.tolist(), intercept) if len(weights) else F.lit(float(intercept))

    # good mass by path and host: the label where there is one, else the model's probability; rows without an id need no label
    judged = slim.select("row", "_id", "_host", "_path", (1 / (1 + F.exp(-odds))).alias("p_document"))
    met = judged.where("_id IS NOT NULL").join(truth, F.col("_id") == F.col("_label_id"), "left").drop("_label_id")
    met = met.unionByName(judged.where("_id IS NULL").withColumn("_label", F.lit(None).cast("double")))
    mass = checkpointed(met.withColumn("_good", F.coalesce("_label", "p_document")).drop("_label"))
    paths = checkpointed(mass.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.sum("_good").alias("good")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    alpha, beta = beta_prior(F.col("good"), F.col("n"))
    host_prior = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), (alpha + beta).alias("weight")).first()
    path_weight = paths.agg((alpha + beta).alias("weight")).first().weight
    if not host_prior.n:
        common, host_weight, path_weight = 0.5, 1.0, 1.0
    else:
        common, host_weight = host_prior.good / host_prior.n, host_prior.weight
    sites = paths.withColumnRenamed("n", "path_n").withColumnRenamed("good", "path_good").join(
        hosts.select(F.col("_host").alias("_h"), F.col("n").alias("host_n"), F.col("good").alias("host_good")),
        F.col("_host").eqNullSafe(F.col("_h")),
    ).drop("_h")
    sites = checkpointed(sites.withColumnRenamed("_host", "_site_host").withColumnRenamed("_path", "_site_path"))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)

    scored = mass.join(sites, F.col("_host").eqNullSafe(F.col("_site_host")) & F.col("_path").eqNullSafe(F.col("_site_path")), "left")
    # a document's own mass is left out of its site's rates
    host_rate = (F.greatest(F.col("host_good") - F.col("_good"), F.lit(0.0)) + host_weight * common) / (F.col("host_n") - 1 + host_weight)
    scored = scored.withColumn("host_rate", F.least(host_rate, F.lit(1.0)))
    path_rate = (F.greatest(F.col("path_good") - F.col("_good"), F.lit(0.0)) + path_weight * F.col("host_rate")) / (F.col("path_n") - 1 + path_weight)
    scored = scored.withColumn("path_rate", F.least(path_rate, F.lit(1.0)))
    base = math.log(max(common, 1e-6) / max(1 - common, 1e-6))
    final = _logit(F.col("p_document")) + _logit(F.col("path_rate")) - base
    scored = scored.withColumn("p_good", 1 / (1 + F.exp(-final)))
    return scored.select("row", F.col("_id").alias("id"), "p_document", "host_rate", "path_rate", "p_good", (F.col("p_good") >= threshold).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc`` (the row as it came) beside its scores. Every text meets its own row, so the texts are shuffled; see :func:`kept_documents`."""
    rows = numbered(docs)
    found = scores(rows, labels, **options).withColumnRenamed("row", "_row")
    return rows.join(found, F.col("row") == F.col("_row")).drop("row", "_row", "id")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept; all columns as they came."""
    rows = numbered(docs)
    rejected = checkpointed(scores(rows, labels, **options).where("NOT kept").select(F.col("row").alias("_row")))
    gone = F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected
    return rows.join(gone, F.col("row") == F.col("_row"), "left_anti").select("doc.*")
