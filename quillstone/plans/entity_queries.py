"""Grouping, ids, links, fills, validation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import parse, text
from quillstone.operators import entities
from quillstone.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
    SELECT conv_id, turn, role FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(role)) ORDER BY turn) = 1
""")
def q_dedupe_first(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return entities.keep_first(rows, [F.col("conv_id"), text.dedupe_key(F.col("role"))], [F.col("turn")]).select("conv_id", "turn", "role")


@query("""
    SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value, count(*) AS n_mentions FROM events GROUP BY ALL
""")
def q_dedupe_argmax(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").withColumn("pos", F.col("event_id"))
    return entities.keep_best(rows, ["user_id", "event_type"], "value", "pos", "event_id").select("user_id", "event_type", "event_id", "value", "n_mentions")


@query("""
    WITH g AS (SELECT user_id, lower(trim(event_type)) AS k, min(event_id) AS first_idx, arg_min(event_type, event_id) AS label, count(*) AS n_mentions FROM events GROUP BY ALL)
    SELECT user_id, 'G' || row_number() OVER (PARTITION BY user_id ORDER BY first_idx) AS entity_id, label, first_idx, n_mentions FROM g
""")
def q_group_entities(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events")
    return entities.group_mentions(rows, F.col("event_type"), prefix="G", doc="user_id", order="event_id").drop("mentions")


@query("""
    WITH g AS (SELECT p_size, lower(trim(p_brand)) AS a, lower(trim(p_type)) AS b, min(p_partkey) AS first_idx, arg_min(p_brand, p_partkey) AS label, count(*) AS n_mentions
               FROM part GROUP BY ALL)
    SELECT p_size, 'M' || row_number() OVER (PARTITION BY p_size ORDER BY first_idx) AS entity_id, label, first_idx, n_mentions FROM g
""")
def q_composite_entities(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part")
    found = entities.group_mentions(rows, F.col("p_brand"), [F.col("p_brand"), F.col("p_type")], "M", "p_size", "p_partkey")
    return found.drop("mentions")


def _edges(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    part = items.select("l_orderkey", F.lit("order_part").alias("edge_type"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    supplier = items.select("l_orderkey", F.lit("part_supplier").alias("edge_type"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return part.unionByName(supplier)


@query("""
    WITH e AS (SELECT l_orderkey, 'order_part' AS edge_type, l_orderkey AS s, l_partkey AS t FROM lineitem
               UNION ALL SELECT l_orderkey, 'part_supplier', l_partkey, l_suppkey FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (edge_type = 'order_part') AS n_parts, count(*) FILTER (edge_type = 'part_supplier') AS n_suppliers,
           max(t) FILTER (edge_type = 'part_supplier') AS last_supplier
    FROM e WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY l_orderkey
""")
def q_edges_by_type(spark, sf_dir):
    lists = entities.edges_by_type(_edges(spark, sf_dir), ["order_part", "part_supplier"], "l_orderkey")
    last = F.array_max(F.transform("part_supplier", lambda e: e["target_id"]))
    return lists.select("l_orderkey", F.size("order_part").cast("long").alias("n_parts"), F.size("part_supplier").cast("long").alias("n_suppliers"), last.alias("last_supplier"))


@query("""
    SELECT edge_type, source_id, target_id FROM (
        SELECT DISTINCT 'order_part' AS edge_type, l_orderkey AS source_id, l_partkey AS target_id FROM lineitem
        UNION ALL SELECT DISTINCT 'part_supplier', l_partkey, l_suppkey FROM lineitem)
""")
def q_distinct_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_type", "source_id", "target_id").distinct()


@query("""
    SELECT p_partkey IS NOT NULL AS resolves, count(*) AS n FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey GROUP BY ALL
""")
def q_edge_integrity(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "part").where("p_size <= 40")
    return entities.edge_integrity(read_table(spark, sf_dir, "lineitem"), nodes, "l_partkey", "p_partkey").groupBy("resolves").agg(F.count("*").alias("n"))


@query("""
    SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.source END, 'label-' || l.quality) AS origin FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q_fill_prefer_existing(spark, sf_dir):
    stubs = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("origin"))
    fills = read_table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("origin"))
    return entities.fill_fields(stubs, fills, ["doc_id"], ["origin"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_skip_existing(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id").join(read_table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'G' || (o_orderkey % 4 + 1) END AS gid FROM orders),
    used AS (SELECT DISTINCT o_custkey, CAST(substr(gid, 2) AS BIGINT) AS n FROM r WHERE gid IS NOT NULL),
    miss AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM r WHERE gid IS NULL),
    free AS (SELECT o_custkey, n, row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS k FROM (
        SELECT DISTINCT o_custkey, unnest(generate_series(1, 200)) AS n FROM r) WHERE (o_custkey, n) NOT IN (SELECT o_custkey, n FROM used))
    SELECT r.o_custkey, r.o_orderkey, coalesce(gid, 'G' || free.n) AS gid
    FROM r LEFT JOIN miss USING (o_custkey, o_orderkey) LEFT JOIN free ON free.o_custkey = r.o_custkey AND free.k = miss.k
""")
def q_missing_ids(spark, sf_dir):
    given = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("G"), (F.col("o_orderkey") % 4 + 1).cast("string")))
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", given.alias("gid"))
    return entities.fill_ids(rows, "o_custkey", "o_orderkey", "gid", "G")


@query("""
    SELECT lang, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, round(count(l.doc_id) / count(*), 6) AS coverage,
           round(1 - count(l.doc_id) / count(*), 6) AS missing
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang
""")
def q_evidence_metrics(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    share = F.count("has") / F.count("*")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count("has").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"),
        F.round(share, 6).alias("coverage"), F.round(1 - share, 6).alias("missing"),
    )


@query("""
    SELECT doc_id, max(CASE WHEN k = 'quality' THEN v ELSE 0.0 END) AS quality, max(CASE WHEN k = 'toxic' THEN v ELSE 0.0 END) AS toxic, 0.0::DOUBLE AS neutral
    FROM (SELECT doc_id, 'quality' AS k, CAST(quality AS DOUBLE) AS v FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels) GROUP BY doc_id
""")
def q_label_pivot(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "k", "v").withColumn("v", F.col("v").cast("double"))
    return rows.groupBy("doc_id").pivot("k", ["quality", "toxic", "neutral"]).agg(F.max("v")).na.fill(0.0)


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS segment,
           concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'c' || c_custkey || ': Invalid customer.balance: negative' END,
                     CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c' || c_custkey || ': Invalid customer.segment: not allowed' END) AS warnings
    FROM customer
""")
def q_validate_warnings(spark, sf_dir):
    who = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    said = lambda field, why: F.concat(who, F.lit(f": Invalid customer.{field}: {why}"))
    balance, first = parse.checked(F.col("c_acctbal"), F.col("c_acctbal") >= 0, said("balance", "negative"))
    segment, second = parse.checked(F.col("c_mktsegment"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), said("segment", "not allowed"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", balance.alias("balance"), segment.alias("segment"), F.concat_ws("; ", first, second).alias("warnings"))


@query("""
    WITH refs AS (SELECT o_custkey, o_orderkey AS pos, 'Table ' || (o_orderkey % 3 + 1) AS ref FROM orders),
    tabs AS (SELECT c_custkey, unnest(['table 1', 'table-2', 'Table 3.']) AS alias, unnest([1, 2, 3]) AS table_no FROM customer),
    hit AS (SELECT c_custkey, table_no, min(pos) AS first_ref FROM tabs JOIN refs ON c_custkey = o_custkey
            AND regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(ref), '[^a-z0-9]+', '', 'g') GROUP BY ALL)
    SELECT tabs.c_custkey, CAST(tabs.table_no AS INTEGER) AS table_no, first_ref FROM tabs LEFT JOIN hit USING (c_custkey, table_no)
""")
def q_table_refs(spark, sf_dir):
    refs = read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.concat(F.lit("Table "), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("ref"))
    named = F.posexplode(F.array(F.lit("table 1"), F.lit("table-2"), F.lit("Table 3."))).alias("i", "alias")
    tables = read_table(spark, sf_dir, "customer").select("c_custkey", named).withColumn("table_no", F.col("i") + 1)
    keyed = refs.select(F.col("o_custkey").alias("c_custkey"), "pos", text.table_ref(F.col("ref")).alias("key"))
    hits = tables.withColumn("key", text.table_ref(F.col("alias"))).join(keyed, ["c_custkey", "key"]).groupBy("c_custkey", "table_no").agg(F.min("pos").alias("first_ref"))
    return tables.select("c_custkey", "table_no").join(hits, ["c_custkey", "table_no"], "left")
