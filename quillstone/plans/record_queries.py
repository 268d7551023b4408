"""Fields out of attributes, tasks with conditions, passes, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import parse
from quillstone.operators import records
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


@query("SELECT event_id, format('{:g}', value) AS said FROM events WHERE value IS NOT NULL")
def q_value_text(spark, sf_dir):
    return read_table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", parse.value_text(F.col("value"), "double").alias("said"))


@query("""
    SELECT c_custkey, c_custkey AS "count", CASE c_custkey % 4 WHEN 0 THEN 'patient' WHEN 1 THEN 'control' END AS role,
           CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS right_handed, CAST(c_custkey % 4 = 2 AS INT) + CAST(c_custkey % 3 = 2 AS INT) AS n_notes
    FROM customer
""")
def q_project_groups(spark, sf_dir):
    key = F.col("c_custkey")
    role = F.when(key % 4 == 0, " Patient").when(key % 4 == 1, "CONTROL").when(key % 4 == 2, "alien").otherwise("n/a")
    hand = F.when(key % 3 == 0, "yes").when(key % 3 == 1, "no").otherwise("maybe")
    said = F.create_map(F.lit("count"), F.concat(key.cast("string"), F.lit(" people")), F.lit("population_role"), role, F.lit("all_right_handed"), hand)
    none = F.lit(None).cast("long")
    span = records.evidence_span(key.cast("string"), F.col("c_name"), none, none, F.lit(None), none)
    rows = read_table(spark, sf_dir, "customer").select(key.alias("document_id"), F.lit("G1").alias("entity_id"), F.lit(0).alias("idx"), said.alias("attributes"), F.array(span).alias("evidence"))
    found = records.project(rows, "group")
    return found.select(
        F.col("document_id").alias("c_custkey"), F.col("`count`.value").alias("count"), F.col("population_role.value").alias("role"), F.col("all_right_handed.value").alias("right_handed"),
        F.size("notes").alias("n_notes"),
    )


@query("""
    WITH g AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS f FROM orders GROUP BY ALL),
    c AS (SELECT o_custkey, o_orderpriority AS p, o_orderstatus AS s, min(o_orderkey) AS k FROM orders GROUP BY ALL),
    n AS (SELECT c.*, f, row_number() OVER (PARTITION BY c.o_custkey ORDER BY f, k) AS n FROM c JOIN g ON c.o_custkey = g.o_custkey AND c.p = g.p),
    t AS (SELECT o_custkey, p, f, string_agg('C' || n || ':' || s, ' ' ORDER BY n) AS conditions FROM n GROUP BY ALL)
    SELECT o_custkey, 'T' || row_number() OVER (PARTITION BY o_custkey ORDER BY f) AS entity_id, p AS label, conditions FROM t
""")
def q_task_conditions(spark, sf_dir):
    said = F.create_map(F.lit("task_name"), F.col("o_orderpriority"), F.lit("conditions"), F.col("o_orderstatus"))
    none = F.lit(None).cast("long")
    span = records.evidence_span(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), none, none, F.lit(None), F.col("o_orderkey"))
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("idx"), F.lit("x").alias("extraction_text"), said.alias("attributes"), F.array(span).alias("evidence")
    )
    listed = F.array_join(F.transform("conditions", lambda c: F.concat(c["id"], F.lit(":"), c["label"])), " ")
    return records.tasks(rows).select(F.col("document_id").alias("o_custkey"), "entity_id", "label", listed.alias("conditions"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) - 1 AS idx FROM orders")
def q_combined_passes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("idx"), "o_orderkey")
    found = records.combined_passes([rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1")])
    return found.select(F.col("document_id").alias("o_custkey"), "o_orderkey", F.col("idx").cast("long").alias("idx"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 100 <= 30 THEN 'a' WHEN o_orderkey % 100 <= 60 THEN 'b' WHEN o_orderkey % 100 <= 80 THEN 'c' END AS name
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
""")
def q_interval_first(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    parts = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("name")) for a, b, n in ((0, 30, "a"), (30, 60, "b"), (50, 80, "c"))))
    points = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 100).alias("at"), "o_orderkey").join(customers, "k", "left_semi")
    return records.containing(points, customers.select("k", F.inline(parts)), "k").select("o_orderkey", "name")


@query("""
    SELECT l_orderkey, l_linenumber % 3 AS "start", l_partkey AS "end", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_partkey DESC) AS place FROM lineitem
""")
def q_display_order(spark, sf_dir):
    spans = read_table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("start"), F.col("l_partkey").alias("end"))
    return records.display_order(spans, "l_orderkey")
