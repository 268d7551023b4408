"""Near-duplicate texts: MinHash banding over word n-grams, pairs verified on their full n-gram sets.

DataFrame operations alone. Texts of equal words are collapsed into one class first, so copies cost one row each and
never meet in pairs. Signatures are made within a row, by one-permutation hashing: as many hash functions as a band has rows,
each giving one value for every band. Texts of few grams would have the same few values in all bands, so below ``FEW`` grams
every value has a hash function of its own; texts that may link to one of these have bands of both kinds. Bands are shuffled on
their hashes. Texts are first verified against the least row of each of their buckets; texts these links join are a family. Links within
a large family are counted from bits of its commonest grams, block against block, with no row a pair. Other pairs of a bucket
are made block against block too, so that a hot bucket spreads over many tasks, and dropped on the spot if their sizes and bits
rule the threshold out. What is left is verified once: n-gram sets are sent to blocks of at most about ``2 * BLOCK`` texts that share
a bucket, not once a pair. Groups are connected components of the verified links.

``choose_bands`` picks the widest bands that reach the wanted recall at the threshold within a number of hashes.

Defined results
    * words are lower-cased and parted at white space; a text of fewer than n words is one gram of them all;
    * null texts and texts without words stand alone, each its own class, without links;
    * class_id is the smallest id of the group; null ids come last in that order;
    * repeated ids stay separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.session import checkpointed, numbered, written

PRIME = (1 << 31) - 1
BLOCK = 64
BUCKET_BLOCK = 256
#: least members of a family whose pairs are counted at once, how many times the pairs of its buckets they may be, members of a block
FAMILY, FAMILY_PAIRS, FAMILY_BLOCK = 64, 2, 1024
#: longs of bits that stand for a text's grams
WORDS = 8
#: texts of fewer grams have independent minima
FEW = 64
#: rows of one long up to this number are broadcast (16 MB at most); more are joined by shuffle
BROADCAST_ROWS = 500_000
#: rows of one class that one task joins, and the classes of more rows that are broadcast (64 bytes each)
SALT_ROWS, BROADCAST_CLASSES = 50_000, 200_000


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, within ``hashes``, find a pair at ``threshold`` with ``recall``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def normalised(text: Column) -> Column:
    """Lower-cased words with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def grams_of(norm: Column, n: int) -> Column:
    """The set of word n-grams of a normalised text, as 64-bit fingerprints."""

    def of(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
        return F.when(F.size(words) >= n, F.array_distinct(windows)).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))

    # a lambda binds the words, which are then split once, wherever the optimiser moves this
    return F.transform(F.array(F.split(norm, " ")), of)[0]


def _prepared(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc = F.col("doc")
    return rows.select(doc.getField(id_col).cast("long").alias("id"), doc.getField(text_col).alias("text"), "row")


def _wordy(prepared: DataFrame) -> DataFrame:
    """Rows that have words, with their normalised texts."""
    some = prepared.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return some.select("id", "row", normalised(F.col("text")).alias("norm"))


def _key(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def one_permutation(grams: Column, bins: int, a: int, b: int) -> Column:
    """``bins`` MinHash values of a gram set by one hash function: the minimum of each part of the hash range.

    An empty part takes the minimum of the next part that has one, marked by the distance, going round at the end. The hash is
    universal over 31-bit fingerprints and stays below 2**62.
    """
    width = -(-PRIME // bins)
    part = lambda x: F.floor(x / width)
    long = lambda x: F.lit(x).cast("long")
    far = lambda x, distance: x + distance * PRIME

    def spread(least: Column) -> Column:
        def slots(x: Column, i: Column) -> Column:
            first = F.when(i == 0, long(0)).otherwise(part(F.get(least, i - 1)) + 1)
            return F.transform(F.sequence(first, part(x)), lambda s: far(x, part(x) - s))

        last = part(F.get(least, F.size(least) - 1))
        wrapped = F.transform(F.sequence(last + 1, long(bins - 1)), lambda s: far(F.get(least, F.lit(0)), bins - s + part(F.get(least, F.lit(0)))))
        parts = F.flatten(F.transform(least, slots))
        return F.when(last < bins - 1, F.concat(parts, wrapped)).otherwise(parts)

    def minima(hashes: Column) -> Column:
        least = F.filter(hashes, lambda x, i: (i == 0) | (part(x) != part(F.get(hashes, i - 1))))
        return F.transform(F.array(least), spread)[0]

    hashed = F.transform(grams, lambda g: (F.shiftrightunsigned(g, 33) * long(a) + long(b)) % long(PRIME))
    return F.transform(F.array(F.sort_array(hashed)), minima)[0]


def independent_bands(grams: Column, bands: int, rows: int, rng: random.Random) -> Column:
    """A hash of each band of minima by ``bands * rows`` hash functions; numbered after the bands by one permutation."""
    functions = F.array(*(F.struct(F.lit(b).alias("band"), F.array(*(
        F.struct(F.lit(rng.randrange(1, PRIME)).cast("long").alias("a"), F.lit(rng.randrange(PRIME)).cast("long").alias("b")) for _ in range(rows)
    )).alias("of")) for b in range(bands, 2 * bands)))

    def of(prints: Column) -> Column:
        least = lambda h: F.array_min(F.transform(prints, lambda x: (x * h["a"] + h["b"]) % F.lit(PRIME).cast("long")))
        return F.transform(functions, lambda f: F.xxhash64(f["band"], F.transform(f["of"], least)))

    return F.transform(F.array(F.transform(grams, lambda g: F.shiftrightunsigned(g, 33))), of)[0]


def band_hashes(grams: Column, bands: int, rows: int, seed: int, threshold: float) -> Column:
    """A hash of each band. Texts of ``FEW`` grams and more have bands by one permutation, smaller ones and those that may reach
    the threshold with a smaller one have independent bands, so that any pair meets in bands of one kind."""
    few = F.size(grams) < FEW
    reach = F.size(grams) <= math.floor((FEW - 1) / threshold)
    none = F.array().cast("array<bigint>")
    rng = random.Random(seed)
    by_parts = permutation_bands(grams, bands, rows, rng)
    return F.concat(F.when(few, none).otherwise(by_parts), F.when(reach, independent_bands(grams, bands, rows, rng)).otherwise(none))


def permutation_bands(grams: Column, bands: int, rows: int, rng: random.Random) -> Column:
    """Row r of all bands comes from hash function r, so a band's rows are independent."""

    def of(g: Column) -> Column:
        signatures = F.array(*(one_permutation(g, bands, rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(rows)))
        return F.transform(F.array(signatures), lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *(F.get(F.get(m, F.lit(r)), b) for r in range(rows)))
        ))[0]

    return F.transform(F.array(grams), of)[0]


def shared_bands(prepared: DataFrame, classes: DataFrame, n: int, bands: int, rows: int, seed: int, threshold: float) -> DataFrame:
    """band, rep, n and hub: the classes in each bucket of two and more, its size and its least row."""
    signed = _wordy(prepared).select("row", F.transform(F.array(grams_of(F.col("norm"), n)), lambda g: band_hashes(g, bands, rows, seed, threshold))[0].alias("bands"))
    signed = signed.join(classes.select(F.col("rep").alias("_rep")), F.col("row") == F.col("_rep"), "left_semi")
    placed = signed.select(F.col("row").alias("rep"), F.explode_outer("bands").alias("band"))
    placed = written(placed, "bands")
    buckets = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1")
    return written(placed.join(buckets, "band"), "buckets")


def gram_sets(prepared: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """row and grams of the texts that share a bucket."""
    rows = checkpointed(held.select(F.col("rep").alias("_row")).distinct())
    wanted = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    sets = _wordy(prepared.join(wanted, F.col("row") == F.col("_row"), "left_semi"))
    return written(sets.select("row", grams_of(F.col("norm"), n).alias("grams")), "grams")


def families(held: DataFrame, stars: DataFrame) -> DataFrame:
    """row, family and m (its members): texts of those families whose pairs are all counted at once.

    A family is a component of the links between texts and the hubs of their buckets. All pairs of a family are looked at where
    they are no more than a few times those that its buckets hold; wide families of few candidates stay with their buckets.
    """
    labels = components(stars)
    large = labels.groupBy("label").agg(F.count("*").alias("m")).where(F.col("m") >= FAMILY)
    member = checkpointed(labels.join(large, "label").select(F.col("vertex").alias("row"), F.col("label").alias("family"), "m"))
    met = held.join(member, F.col("rep") == F.col("row")).groupBy("family", "m", "band").agg(F.count("*").cast("double").alias("c"))
    met = met.groupBy("family", "m").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("met"))
    dense = met.where(F.col("m").cast("double") * (F.col("m") - 1) / 2 <= FAMILY_PAIRS * F.col("met")).select("family")
    return checkpointed(member.join(dense, "family", "left_semi"))


def _words(place: Column) -> list[Column]:
    """Aggregates: the bits of the places from 0 to ``64 * WORDS - 1``, as longs."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return [F.coalesce(F.bit_or(F.when(F.shiftright(place, 6) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)]


def _reaches(both: Column, sizes: Column, threshold: float) -> Column:
    return both / (sizes - both) >= threshold


def family_sets(grams: DataFrame, members: DataFrame) -> DataFrame:
    """family, m, row, size, w0, w1, .. and rare: a member's grams that others of the family have, the commonest as bits of the words."""
    each = grams.join(members, "row").select("family", "m", "row", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    each = written(each, "family")
    known = each.groupBy("family", "m", "gram").agg(F.count("*").alias("df")).where("df > 1")
    # a bounded number of grams can stand in every 64th member
    common = known.where(F.col("df") * 64 >= F.col("m"))
    order = Window.partitionBy("family").orderBy(F.col("df").desc(), "gram")
    common = common.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < 64 * WORDS)
    places = known.select("family", "gram").join(common.select("family", "gram", "place"), ["family", "gram"], "left")
    told = each.join(places, ["family", "gram"])
    rare = F.collect_list(F.when(F.col("place").isNull(), F.col("gram")))
    return written(told.groupBy("family", "m", "row", "size").agg(*_words(F.col("place")), rare.alias("rare")), "family_sets")


def _family_pairs(sets: DataFrame) -> tuple[DataFrame, Column]:
    """All pairs of rows a and b within families, block against block, and the grams they have in common among the commonest."""
    parts = F.ceil(F.col("m") / FAMILY_BLOCK)
    placed = sets.withColumn("part", F.pmod(F.xxhash64("row"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("row", "size", "rare", *(f"w{w}" for w in range(WORDS)))]
    left = placed.select("family", F.col("part").alias("here"), F.col("other").alias("there"), *side("a"))
    right = placed.select("family", F.col("other").alias("here"), F.col("part").alias("there"), *side("b"))
    both = sum((F.bit_count(F.col(f"w{w}_a").bitwiseAND(F.col(f"w{w}_b"))) for w in range(1, WORDS)), F.bit_count(F.col("w0_a").bitwiseAND(F.col("w0_b"))))
    return left.join(right, ["family", "here", "there"]), both


def family_degrees(sets: DataFrame, threshold: float) -> DataFrame:
    """vertex and n_links within its family. Rare grams are compared only where the common ones leave a pair open."""
    pairs, both = _family_pairs(sets)
    sizes = F.col("size_a") + F.col("size_b")
    most = both + F.least(F.size("rare_a"), F.size("rare_b"))
    linked = (
        F.when(_reaches(both, sizes, threshold), True).when(~_reaches(most, sizes, threshold), False)
        .otherwise(_reaches(both + F.size(F.array_intersect("rare_a", "rare_b")), sizes, threshold))
    )
    return pairs.where((F.col("row_a") != F.col("row_b")) & linked).groupBy(F.col("row_a").alias("vertex")).agg(F.count("*").alias("n_links"))


def family_links(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b and jaccard of the linked pairs within families."""
    pairs, common = _family_pairs(sets)
    both = common + F.size(F.array_intersect("rare_a", "rare_b"))
    found = pairs.where(F.col("row_a") < F.col("row_b")).select(
        F.col("row_a").alias("a"), F.col("row_b").alias("b"), (both / (F.col("size_a") + F.col("size_b") - both)).alias("jaccard")
    )
    return found.where(F.col("jaccard") >= threshold)


def candidate_pairs(held: DataFrame, grams: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a < b: rows that share a band and are not of one family; hub: the least row of such a bucket.

    In a bucket with a family's members all rows meet those outside its main family alone. Pairs that cannot reach the threshold are
    dropped as they are made: a bit that only one of two texts has stands for a gram that the other lacks.
    """
    tagged = held.join(members.select(F.col("row").alias("rep"), "family"), "rep", "left")
    main = tagged.where("family IS NOT NULL").groupBy("band", "family").agg(F.count("*").alias("c"))
    main = main.groupBy("band").agg(F.max(F.struct("c", "family")).alias("main")).select("band", "main.c", F.col("main.family").alias("main"))
    tagged = tagged.join(main, "band", "left").where("c IS NULL OR c < n")
    tagged = written(tagged.withColumn("outside", F.coalesce(F.col("family") != F.col("main"), F.lit(True))), "loose")
    each = grams.join(tagged.select(F.col("rep").alias("row")).distinct(), "row", "left_semi")
    each = each.select(F.col("row").alias("rep"), F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    bits = each.groupBy("rep", "size").agg(*_words(F.pmod("gram", F.lit(64 * WORDS).cast("long"))))
    parts = F.ceil(F.col("n") / BUCKET_BLOCK)
    placed = tagged.join(bits, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("rep", "size", "family", "outside", *(f"w{w}" for w in range(WORDS)))]
    left = placed.select("band", "hub", F.col("part").alias("here"), F.col("other").alias("there"), *side("a"))
    right = placed.where("outside").select("band", F.col("other").alias("here"), F.col("part").alias("there"), *side("b"))

    def lacking(s: str, t: str) -> Column:
        counts = [F.bit_count(F.col(f"w{w}_{s}").bitwiseAND(F.bitwise_not(F.col(f"w{w}_{t}")))) for w in range(WORDS)]
        return sum(counts[1:], counts[0])

    most = F.least(F.col("size_a") - lacking("a", "b"), F.col("size_b") - lacking("b", "a"))
    once = (F.col("rep_a") < F.col("rep_b")) | ~F.col("outside_a")
    apart = F.coalesce(F.col("family_a") != F.col("family_b"), F.lit(True))
    pairs = left.join(right, ["band", "here", "there"]).where(once & apart & _reaches(most, F.col("size_a") + F.col("size_b"), threshold))
    return pairs.groupBy(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).agg(F.min("hub").alias("hub"))


def verified_links(grams: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b and jaccard of the pairs whose full n-gram sets reach the threshold."""
    ends = pairs.select("hub", F.explode(F.array("a", "b")).alias("row")).distinct()
    parts = ends.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    place = lambda end: F.pmod(F.xxhash64(end), F.col("parts"))
    placed = pairs.join(parts, "hub").select("a", "b", F.xxhash64("hub", F.least(place("a"), place("b")), F.greatest(place("a"), place("b"))).alias("block"), "hub")
    placed = checkpointed(placed)
    needed = placed.select("block", F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = needed.join(grams, "row").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "grams"))).alias("sets"))
    work = placed.groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).join(sets, "block")

    def verify(pair: Column) -> Column:
        left, right = F.element_at("sets", pair["a"]), F.element_at("sets", pair["b"])
        return F.struct(
            pair["a"].alias("a"), pair["b"].alias("b"), F.size(F.array_intersect(left, right)).alias("both"), (F.size(left) + F.size(right)).alias("sum")
        )

    found = work.select(F.explode(F.transform("pairs", verify)).alias("p")).select("p.*")
    found = found.withColumn("jaccard", F.col("both") / (F.col("sum") - F.col("both")))
    return found.where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, recall: float = 0.98,
    hashes: int = 96, seed: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: row, id, class_id (smallest id of the group of near-duplicates), copy_of (smallest id among texts of equal words),
    n_copies, n_links (different texts linked to this one), kept (true for one row of each group).
    links: a, b (rows) and jaccard, for all linked pairs of different texts.
    ``row`` is the number that ``session.numbered`` gives a row of ``docs``.
    """
    return _near_duplicates(_prepared(numbered(docs), id_col, text_col), n, threshold, recall, hashes, seed)


def _near_duplicates(prepared: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.98, hashes: int = 96, seed: int = 4, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """``near_duplicates`` of rows (id, text, row). Unless ``counted``, links within families are neither counted nor given."""
    bands, rows = choose_bands(threshold, recall, hashes)
    norm = F.nullif(normalised(F.col("text")), F.lit(""))
    keyed = checkpointed(prepared.select("id", "row", _key(norm).alias("key")))
    classes = checkpointed(text_classes(keyed))
    held = shared_bands(prepared, classes, n, bands, rows, seed, threshold)
    grams = gram_sets(prepared, held, n)
    # each text against the hubs of its buckets: these links join the families
    spokes = checkpointed(held.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), "hub").distinct())
    stars = checkpointed(verified_links(grams, spokes, threshold))
    members = families(held, stars)
    links = checkpointed(verified_links(grams, candidate_pairs(held, grams, members, threshold), threshold))
    groups = components(links.select("a", "b").unionByName(stars.select("a", "b")))
    degree = links.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("n_links"))
    if counted and not members.isEmpty():
        sets = family_sets(grams, members)
        degree = degree.unionByName(family_degrees(sets, threshold)).groupBy("vertex").agg(F.sum("n_links").alias("n_links"))
        links = links.unionByName(family_links(sets, threshold))
    degree = checkpointed(degree)

    # the smallest id of each group speaks for it
    member = classes.join(groups, F.col("rep") == F.col("vertex"), "left").withColumn("label", F.coalesce("label", "rep"))
    first = F.struct(F.col("rep_id").isNull().alias("none"), F.col("rep_id").alias("id"), F.col("rep").alias("row"))
    heads = member.groupBy("label").agg(F.min(first).alias("head"))
    told = (
        member.select("key", "rep", "rep_id", "n_copies", "label").join(heads, "label").join(degree.withColumnRenamed("vertex", "rep"), "rep", "left")
        .select("key", "rep", F.col("rep_id").alias("copy_of"), "n_copies", F.col("head.id").alias("class_id"), F.col("head.row").alias("head"),
                F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    # rows without words are done; they would all meet in one task
    lone = keyed.where("key IS NULL").select(
        "row", "id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")
    )
    worded = keyed.where("key IS NOT NULL")
    hot = checkpointed(classes.where(F.col("n_copies") > SALT_ROWS).select("key", F.ceil(F.col("n_copies") / SALT_ROWS).alias("salts")))
    if not hot.isEmpty() and hot.count() <= BROADCAST_CLASSES:
        # rows of a class of many copies are spread over salts; with too many such classes the adaptive skew join splits them
        told = told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_copies") / SALT_ROWS) - 1)))
        worded = worded.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod("row", F.coalesce("salts", F.lit(1).cast("long"))))
        joined = worded.join(told, ["key", "salt"])
    else:
        joined = worded.join(told, "key")
    documents = joined.select("row", "id", "class_id", "copy_of", "n_copies", "n_links", (F.col("row") == F.col("head")).alias("kept"))
    return documents.unionByName(lone), links


def text_classes(keyed: DataFrame) -> DataFrame:
    """key, rep (row of the smallest id), rep_id and n_copies of each set of texts with equal words."""
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    grouped = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("n_copies"))
    return grouped.select("key", F.col("first.row").alias("rep"), F.col("first.id").alias("rep_id"), "n_copies")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns as they came."""
    rows = numbered(docs)
    found, _ = _near_duplicates(_prepared(rows, id_col, text_col), counted=False, **options)
    dropped = checkpointed(found.where("NOT kept").select(F.col("row").alias("_row")))
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return rows.join(gone, F.col("row") == F.col("_row"), "left_anti").select("doc.*")
