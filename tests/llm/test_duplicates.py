import random

import numpy as np

from quillstone.llm import components, line_dedup, mixing, ngram_join
from tests.llm.conftest import SCHEMA, awkward_rows, prose


def grams(text, n=3):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_choose_bands():
    bands, rows = ngram_join.choose_bands(0.5, 0.98, 96)
    assert bands * rows <= 96 and 1 - (1 - 0.5**rows) ** bands >= 0.98


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for base in range(25):
        words = prose(base, rng.choice([4, 12, 60, 200])).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            copy = [w if rng.random() > 0.04 else f"z{rng.randrange(99)}" for w in words]
            texts += [" ".join(copy)] * rng.choice([1, 1, 3])
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    documents, links = ngram_join.near_duplicates(docs)
    rows = {r.id: r for r in documents.collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert all(rows[i].copy_of == first[t] for i, t in enumerate(texts))
    sets = {i: grams(texts[i]) for i in first.values()}
    wanted = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.5}
    by_row = {r.row: r.id for r in rows.values()}
    found = {tuple(sorted((by_row[r.a], by_row[r.b]))) for r in links.collect()}
    by_row_reps = {tuple(sorted((rows[a].copy_of, rows[b].copy_of))) for a, b in found}
    assert by_row_reps <= wanted and len(by_row_reps) >= 0.97 * len(wanted)
    label = {i: i for i in sets}
    for _ in range(50):
        for a, b in by_row_reps:
            label[a] = label[b] = min(label[a], label[b])
    assert all(rows[i].class_id == label[first[t]] for i, t in enumerate(texts))
    assert sum(r.kept for r in rows.values()) == len(set(label.values()))


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    words = prose(1, 200).split()
    texts = [" ".join(words[:i] + [f"new{i}"] + words[i + 1 :]) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    documents, links = ngram_join.near_duplicates(docs)
    assert links.count() == 30 * 29 // 2
    assert {(r.class_id, r.n_links) for r in documents.collect()} == {(0, 29)}


def test_pairs_verified_grow_with_the_texts(spark, monkeypatch):
    """A family of near-copies and short texts around one sentence: every link is counted, though few pairs are verified one by one."""
    monkeypatch.setattr(ngram_join, "FAMILY_BLOCK", 50)
    rng = random.Random(21)
    words, sentence = prose(7, 200).split(), [f"s{i}" for i in range(14)]
    texts = {" ".join(w if rng.random() > rate else f"z{rng.randrange(30)}" for w in words) for rate in (0.01, 0.04, 0.07, 0.1) for _ in range(60)}
    texts |= {" ".join([*sentence, *(f"t{i}x{k}" for k in range(10 + i % 9))]) for i in range(240)}
    texts = sorted(texts)
    verified, verify = [], ngram_join.verified_links

    def counting(prepared, pairs, *rest):
        verified.append(pairs.count())
        return verify(prepared, pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified_links", counting)
    documents, links = ngram_join.near_duplicates(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).coalesce(1))
    rows = documents.collect()
    sets = [grams(t) for t in texts]
    wanted = {(a, b): jaccard(sets[a], sets[b]) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.5}
    at = {r.row: r.id for r in rows}
    found = {(max(at[r.a], at[r.b]), min(at[r.a], at[r.b])): r.jaccard for r in links.collect()}
    assert len(wanted) > 10_000 and found == wanted and links.count() == len(wanted)
    assert all(r.n_links == sum(r.id in pair for pair in wanted) for r in rows)
    assert sum(verified) < len(wanted) / 4


def test_joined_copies_of_many_rows(spark, monkeypatch, awkward, empty):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 100)
    docs = spark.createDataFrame([(i, "the same words in every row", "en", "a", 0) for i in range(1200)], SCHEMA)
    documents, links = ngram_join.near_duplicates(docs)
    assert {(r.class_id, r.n_copies) for r in documents.collect()} == {(0, 1200)} and links.isEmpty()
    documents, _ = ngram_join.near_duplicates(awkward)
    rows = documents.collect()
    assert len(rows) == len(awkward_rows())
    assert {r.class_id for r in rows if r.id in (1, 2)} == {1} and all(r.kept for r in rows if r.id in (3, 4, 5))
    kept = ngram_join.keep_one_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows()) - 2
    assert ngram_join.keep_one_each(empty).count() == 0


def test_one_permutation_recall(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = prose(1000 + i, 150, 5000).split()
        copy = [w if rng.random() > 0.12 else f"z{rng.randrange(10**6)}" for w in words]
        rows += [(2 * i, " ".join(words), "en", "a", 0), (2 * i + 1, " ".join(copy), "en", "a", 0)]
    near = [i for i in range(150) if 0.5 <= jaccard(grams(rows[2 * i][1]), grams(rows[2 * i + 1][1]))]
    _, links = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert links.count() >= 0.95 * len(near) and len(near) > 30


def test_recall_of_short_texts_at_the_threshold(spark):
    """Pairs at Jaccard 1/2 exactly, of 5 to 44 words, and of about the size at which the kind of band changes."""
    texts, sizes = [], [2, 4, 6, 8, 14, 20, 28]
    for i in range(700):
        # two texts of 3m/2 + 2 words and grams that share the first m of 2m
        half = sizes[i % len(sizes)] // 2
        shared = [f"s{i}x{k}" for k in range(2 * half + 2)]
        texts += [" ".join([*shared, *(f"{side}{i}x{k}" for k in range(half))]) for side in "ab"]
    for i in range(100):
        # 60 grams within 90 to 120
        texts += [" ".join(f"t{i}x{k}" for k in range(n)) for n in (62, 92 + i % 31)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    sets = [grams(t) for t in texts]
    assert all(jaccard(sets[2 * i], sets[2 * i + 1]) == 0.5 for i in range(700)) and jaccard(sets[1400], sets[1401]) >= 0.5
    _, links = ngram_join.near_duplicates(docs)
    found = {min(r.a, r.b) // 2 for r in links.collect()}
    assert len(found & set(range(700))) >= 0.96 * 700 and len(found & set(range(700, 800))) >= 96


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    label = {v: v for e in edges for v in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.vertex: r.label for r in components.components(spark.createDataFrame([*edges, (5, None)], "a long, b long")).collect()}
    assert found == {v: x for v, x in label.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_units(text, least=4):
    """(start, end, words) of lines of ASCII text, cut at ". " and before capitals after small words; short ones joined. Written apart from the operator."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        cuts = [at] + [at + i for i in range(1, len(line)) if line[i - 1] == " " and (line[:i].rstrip(" ")[-1:] in ".!?" and line[i] != " " or line[i].isupper() and not line[:i].split(" ")[-2][:1].isupper())] + [at + len(line)]
        found = [[a, b, len(text[a:b].split())] for a, b in zip(cuts, cuts[1:])]
        units = []
        while found:  # short pieces wait for enough words, or for a long one, which sends them back
            unit = found.pop(0)
            while unit[2] < least and found and found[0][2] < least:
                unit = [unit[0], found[0][1], unit[2] + found.pop(0)[2]]
            if unit[2] < least and units:
                units[-1] = [units[-1][0], unit[1], units[-1][2] + unit[2]]
            elif unit[2] < least and found:
                found[0] = [unit[0], found[0][1], unit[2] + found[0][2]]
            else:
                units.append(unit)
        lines.append(units)
        at += len(line)
    out, short = [], None
    for units in lines:
        if units[0][2] >= least:
            out += ([short] if short else []) + units
            short = None
        else:
            short = [short[0] if short else units[0][0], units[0][1], (short[2] if short else 0) + units[0][2]]
            if short[2] >= least:
                out.append(short)
                short = None
    return [u for u in out + ([short] if short else []) if u[2]]


def brute_dedup(rows, min_words=30):
    """Passages removed from each of the (id, text) rows, in order of rank."""
    seen, out = set(), []
    for _, text in sorted(rows):
        runs, open_ = [], False
        for start, end, words in brute_units(text or ""):
            norm = " ".join(text[start:end].lower().split())
            if norm in seen and open_:
                runs[-1] = [runs[-1][0], end, runs[-1][2] + words]
            elif norm in seen:
                runs.append([start, end, words])
            open_ = norm in seen
            seen.add(norm)
        out.append([(a, b) for a, b, n in runs if n >= min_words])
    return out


def test_unique_short_lines_between_repeats_stay(spark):
    first, second = "Aa " + prose(300, 40).replace(".", ""), "Bb " + prose(301, 45).replace(".", "")
    texts = [f"{first}\nTotal due 40\n{second}\nSame end", f"{first}\nTotal due 51\n{second}\nSame end", f"Zz {prose(302, 9)}\n{first}\nTotal due 51\n{second}\nSame end"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert found[0] == texts[0] and found[1] == "Total due 51\n" and found[2] == f"Zz {prose(302, 9)}\n"


def test_passages_against_brute_force(spark):
    passage = ". ".join("P" + prose(50 + i, 9) for i in range(7)) + "."
    rows = [(i, f"{prose(i, 70)}\n{prose(i + 90, 40)}") for i in range(12)]
    rows[3] = (3, rows[3][1][:100] + " " + passage + " " + rows[3][1][100:])
    rows[7] = (7, rows[7][1] + "\n" + passage)
    rows[9] = (9, passage + " " + rows[9][1] + "\n" + passage)
    rows += [(20, rows[1][1]), (21, "Common line of five words.\n" + prose(77, 60)), (22, "Common line of five words.\n" + prose(78, 60))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    wanted = brute_dedup(rows)
    found = {r.doc.doc_id: r for r in line_dedup.dedup(docs).collect()}
    for k, (i, text) in enumerate(sorted(rows)):
        r = found[i]
        assert [(s.start, s.end) for s in r.spans] == wanted[k], i
        left, at = "", 0
        for s in r.spans:
            left, at = left + text[at : s.start], s.end
        assert r.text == left + text[at:]
    assert passage.split(". ")[3] in found[3].text and passage.split(". ")[3] not in found[7].text
    assert not found[20].text and not found[22].spans and not found[5].spans


def test_decisions_do_not_follow_the_splits(spark, tmp_path):
    """Documents and decisions are read in different splits, as when executors come and go."""
    texts = [prose(i % 40, 80) + f" end{i % 60}" for i in range(120)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    operators = [ngram_join.keep_one_each, mixing.mixed_documents, lambda d: line_dedup.dedup(d).select("doc.doc_id", "text")]
    found = []
    for before, after in ((1, 1), (1, 30), (30, 1)):
        for operator in operators:
            spark.conf.set("spark.sql.files.minPartitionNum", before)
            spark.conf.set("spark.sql.files.maxPartitionBytes", 134217728 if before == 1 else 3000)
            left = operator(docs)
            spark.conf.set("spark.sql.files.minPartitionNum", after)
            spark.conf.set("spark.sql.files.maxPartitionBytes", 134217728 if after == 1 else 3000)
            found.append(sorted(map(tuple, left.select("doc_id", "text").collect())))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[:3] == found[3:6] == found[6:] and all(found)


def test_hot_digest_and_awkward(spark, monkeypatch, awkward, empty):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 5)
    line = prose(4, 50).replace(".", "")
    docs = spark.createDataFrame([(i, line + f"\nEnd u{i}", "en", "a", 0) for i in range(40)], SCHEMA).repartition(4)
    rows = line_dedup.dedup(docs).collect()
    assert [r.doc.doc_id for r in rows if not r.spans] == [0]
    found = line_dedup.dedup(awkward)
    assert found.count() == len(awkward_rows()) and found.select("doc.*").columns == awkward.columns
    assert found.where("doc.text IS NULL AND text IS NOT NULL").isEmpty()
    assert line_dedup.dedup(empty).count() == 0


#: a repeated passage each: Cyrillic, capitals, German, Chinese, Thai, Devanagari, title case, a list of short lines
PASSAGES = {
    "ru": "Все права на этот текст принадлежат издателю и его авторам. Любое копирование без письменного согласия издателя запрещено законом. "
          "Читатель может сохранить одну копию для личного пользования, если он не меняет её содержания. За подробностями обращайтесь в нашу редакцию по обычной почте.",
    "caps": "THE SELLER MAKES NO WARRANTY OF ANY KIND WITH REGARD TO THIS MATERIAL. IN NO EVENT SHALL THE SELLER BE HELD LIABLE FOR ERRORS CONTAINED HEREIN OR FOR DAMAGES ARISING FROM ITS USE BY ANY PERSON.",
    "de": "Der Verkäufer haftet für Schäden der Ware nur, wenn der Käufer den Mangel binnen einer Woche der Leitung des Hauses anzeigt. Die Kosten der Rückgabe trägt der Käufer, "
          "sofern Ware und Rechnung der Bestellung entsprechen. Das Recht auf Minderung bleibt davon in jedem Fall unberührt.",
    "zh": "本网站的所有内容均受版权法保护。未经出版者书面许可，任何人不得复制、转载或以其他方式使用。如有疑问，请与编辑部联系。",
    "th": "เนื้อหาทั้งหมดในเว็บไซต์นี้ได้รับการคุ้มครองตามกฎหมายลิขสิทธิ์ ห้ามคัดลอกหรือเผยแพร่โดยไม่ได้รับอนุญาตเป็นลายลักษณ์อักษรจากผู้จัดพิมพ์ หากมีข้อสงสัยโปรดติดต่อกองบรรณาธิการตามที่อยู่ด้านล่าง",
    "hi": "इस लेख के सभी अधिकार प्रकाशक के पास सुरक्षित हैं। बिना लिखित अनुमति के कोई भी इसे नहीं छाप सकता। अधिक जानकारी के लिए कृपया हमारे कार्यालय से डाक द्वारा संपर्क करें और उत्तर की प्रतीक्षा करें।",
    "title": "Terms And Conditions Of Sale For All Goods Sold By The Company To Any Buyer At Any Place And Time Whether In Person Or By Post Or By Telephone Or By Any Other Means Known.",
    "list": "\n".join(f"{x} one {x}" for x in "abcdefghijkl"),
}


def test_words_of_all_scripts_count():
    for name, passage in PASSAGES.items():
        units = list(line_dedup.units_of(passage + "\n"))
        assert sum(u[2] for u in units) == line_dedup.word_count(passage) >= line_dedup.MIN_WORDS, name
        assert "".join((passage + "\n")[a:b] for a, b, _, _ in units) == passage + "\n", name


def test_repeated_passages_of_all_scripts_go(spark):
    own = {i: f"own{i} " + prose(900 + i, 40) for i in range(3 * len(PASSAGES))}
    rows = []
    for k, passage in enumerate(PASSAGES.values()):
        # a line of its own, and after a sentence within a line
        rows += [(3 * k, own[3 * k] + ".\n" + passage + "\n"), (3 * k + 1, own[3 * k + 1] + ".\n" + passage + "\n"), (3 * k + 2, own[3 * k + 2] + ". " + passage + "\n")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    found = {r.doc.doc_id: r for r in line_dedup.dedup(docs).collect()}
    for k, (name, passage) in enumerate(PASSAGES.items()):
        assert not found[3 * k].spans, name
        assert found[3 * k + 1].text == own[3 * k + 1] + ".\n", name
        if name != "list":
            assert found[3 * k + 2].text.startswith(own[3 * k + 2] + ".") and len(found[3 * k + 2].text) < len(own[3 * k + 2]) + len(passage) / 2, name


def test_short_pieces_join_within_bounds():
    text = "Yes. No. Yes. No. Yes. No. Yes. " * 20 + "a long enough piece of words. Ok. " + "The last one is long as well."
    units = list(line_dedup.units_of(text))
    assert "".join(text[a:b] for a, b, _, _ in units) == text and all(4 <= n <= 11 for _, _, n, _ in units)
    for odd in ("", "\n\n", " ", "A", "\nA b\n\nc", "。。", "A. B", " A"):
        for a, b, n, norm in line_dedup.units_of(odd):
            assert n >= 1 and norm
