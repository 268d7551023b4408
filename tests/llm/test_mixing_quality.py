import re

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import host_rules, mixing, site_quality
from quillstone.llm.text_units import WORD
from tests.llm.conftest import SCHEMA, awkward_rows, prose


def expected_targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose(i, int(rng.integers(1, 200))), "en", f"s{min(i % 7, 4)}" if i % 11 else None, 0) for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = mixing.mix(docs).toPandas()
    sizes = {s: sum(len(re.findall(WORD, r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    targets = expected_targets(sizes)
    for s, part in found.groupby("source", dropna=False):
        s = None if not isinstance(s, str) else s
        assert abs(part.target.iloc[0] - targets[s]) < 1e-6 * targets[s]
        assert abs(part.taken.sum() - targets[s]) <= part["size"].max() / 2 + 1
    assert (found.taken <= 2 * found["size"]).all() and (found.taken == found.copies * found["size"]).all()
    again = mixing.mix(docs).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_expectations_are_kept(spark):
    units = spark.createDataFrame([("s", 10 + i % 5, i, 0.3, 0) for i in range(60)], "source string, size long, row long, p double, position long")
    drawn = [mixing.pivotal_round(units, seed, 60).toPandas().set_index("row").p for seed in range(25)]
    mean = np.mean([d.mean() for d in drawn])
    assert abs(mean - 0.3) < 0.05
    assert all(set(d) <= {0.0, 1.0} and len(d) == 60 for d in drawn)


def test_mix_awkward(awkward, empty):
    found = mixing.mix(awkward).toPandas()
    assert len(found) == len(awkward_rows()) and (found.taken <= 2 * found["size"]).all()
    assert found[found["size"] == 0].taken.sum() == 0
    assert mixing.mix(empty).count() == 0
    kept = mixing.mixed_documents(awkward)
    assert kept.columns == awkward.columns and kept.count() == found.copies.sum()
    assert mixing.mixed_documents(empty).count() == 0


def brute_counts(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)


def test_host_rule_counts():
    texts = [None, "", "a b c a b c d", "x | y\nx | y\n\n#\n#", "a a a a a", "a a a", " \n ", "one\ntwo\none", "p q r s p q r"]
    for text in texts + [r[1] for r in awkward_rows() if r[1] and len(r[1]) < 5000]:
        assert host_rules.count_text(text) == brute_counts(text), text


def test_host_verdicts(spark, awkward, empty):
    good = [(i, prose(i, 90), "en", "fine", 0) for i in range(40)]
    bad = [(100 + i, "| # " * 60, "en", "spam", 0) for i in range(40)]
    lone = [(200, prose(9, 90), "en", "lone", 0), (201, "short", "en", "tiny", 0)]
    found = host_rules.apply_rules(spark.createDataFrame(good + bad + lone, SCHEMA)).toPandas().set_index("doc_id")
    assert found.kept[:40].all() and not found.kept.loc[100:139].any() and found.kept[200] and not found.kept[201]
    assert host_rules.apply_rules(awkward).count() == len(awkward_rows())
    assert host_rules.apply_rules(empty).count() == 0


def test_beta_prior_of_equal_hosts(spark):
    hosts = spark.createDataFrame([(f"h{i}", 100, 10) for i in range(20)], "host string, n long, k long")
    alpha, beta = host_rules.beta_prior(F.col("k").cast("double"), F.col("n").cast("double"))
    row = hosts.agg(alpha.alias("a"), beta.alias("b")).first()
    assert abs(row.a / (row.a + row.b) - 0.1) < 1e-9 and abs(row.a + row.b - 10_000) < 1e-6


def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    shown = labels.where("doc_id % 2 = 0")
    found = site_quality.classify(docs, shown).select("doc.doc_id", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = found.agg(F.count("*").alias("n"), F.count_if(F.col("kept") == (F.col("quality") == 1)).alias("right"), F.count_if(~F.col("kept") & (F.col("quality") == 1)).alias("lost")).first()
    assert n.right / n.n > 0.98 and n.lost / n.n < 0.01


def test_sparse_site_is_shrunk(spark):
    rows = [(i, prose(i, 90) if i % 2 else "| # " * 60, "en", f"h{i % 10}", 0) for i in range(200)] + [(900, prose(3, 90), "en", "new", 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = site_quality.classify(spark.createDataFrame(rows, SCHEMA), labels).select("doc.doc_id", "host_rate", "kept").toPandas().set_index("doc_id").sort_index()
    assert found.kept[900] and abs(found.host_rate[900] - 0.5) < 0.1
    assert (found.kept[:200] == [i % 2 == 1 for i in range(200)]).all()


def brute_posteriors(rows, labels, p):
    """Posteriors of (id, host, path) rows by sums in Python, from the documents' own probabilities."""
    truth = {}
    for i, quality in labels:
        if i is not None and quality is not None:
            truth.setdefault(i, []).append(quality)
    good = [np.mean(truth[i]) if i in truth else q for (i, _, _), q in zip(rows, p)]

    def sums(key):
        out = {}
        for r, g in zip(rows, good):
            n, k = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, k + g
        return out

    def weight(groups):
        n, k = (np.array(x, float) for x in zip(*groups))
        mean, share = k.sum() / n.sum(), len(n) / n.sum()
        spread = ((k * k / n).sum() / n.sum() - mean**2 - mean * (1 - mean) * share) / (1 - share)
        return min(max(mean * (1 - mean) / spread - 1 if spread > 0 else 1e4, 1), 1e4)

    host, path = sums(lambda r: r[1]), sums(lambda r: r[1:])
    common, host_weight, path_weight = np.mean(good), weight(host.values()), weight(path.values())
    out = []
    for r, g, q in zip(rows, good, p):
        (hn, hk), (pn, pk) = host[r[1]], path[r[1:]]
        a = (hk - g + host_weight * common) / (hn - 1 + host_weight)
        b = (pk - g + path_weight * a) / (pn - 1 + path_weight)
        odds = q / (1 - q) * b / (1 - b) / (common / (1 - common))
        out.append((a, b, odds / (1 + odds)))
    return out


def test_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i if i % 17 else None, "| # " * 20 + prose(i, 20) if rng.random() < 0.4 else prose(i, int(rng.integers(20, 90))), [None, "en", "fr"][i % 3], f"h{int(rng.integers(0, 9)) ** 2 % 7}" if i % 13 else None, 0) for i in range(300)]
    shown = [(i, int(rng.random() < 0.5) if i % 4 else int("|" not in rows[i][1])) for i in range(0, 300, 2)] + [(8, 0), (8, 1), (10, None), (None, 1)]
    labels = spark.createDataFrame(shown, "doc_id long, quality int")
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", k long").repartition(3)
    found = sorted(site_quality.classify(docs, labels).collect(), key=lambda r: r.doc.k)
    wanted = brute_posteriors([(r[0], r[3], r[2]) for r in rows], shown, [r.p_document for r in found])
    for r, w in zip(found, wanted):
        assert np.allclose((r.host_rate, r.path_rate, r.p_good), w, atol=1e-6) and r.kept == (w[2] >= 0.5)
    kept = site_quality.kept_documents(docs, labels)
    assert sorted(r.k for r in kept.collect()) == [r.doc.k for r in found if r.kept] and kept.columns == docs.columns


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (7, 0, 0), (None, 1, 0), (99, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    found = site_quality.classify(awkward, labels)
    assert found.count() == len(awkward_rows()) and found.where("kept IS NULL").isEmpty()
    assert found.select("doc.*").columns == awkward.columns
    assert site_quality.classify(empty, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert site_quality.classify(awkward, none).where("NOT kept").isEmpty()
