"""Queries that keep tables in order: removal along foreign keys (K6), surrogate keys (K3), validation of semi-structured answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.cleanup import Reference, cleaned
from braidwork.operators.schemas import checked
from braidwork.plans.views import table
from braidwork.sources.sinks import ensure_nodes

#: Suppliers are sources, lineitems their articles, orders the clusters, customers the entities of clusters.
REFERENCES = [
    Reference("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Reference("lineitem", "l_orderkey", "orders", "o_orderkey", "with_any_child"),
    Reference("orders", "o_custkey", "customer", "c_custkey", "unless_shared"),
]
POINTERS = [Reference("customer", "canonical_id", "customer", "c_custkey")]


def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: every row of four tables and whether it goes with the suppliers whose name ends in 7: their lineitems, all orders with any of those
    with all their lineitems, and customers that only such orders have, unless a staying customer names them as canonical (every third names
    the one before)."""
    t = {n: table(spark, sf_dir, n) for n in ("supplier", "lineitem", "orders", "customer")}
    t["lineitem"] = t["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey")
    t["customer"] = t["customer"].select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") - 1).alias("canonical_id"))
    t["orders"], t["supplier"] = t["orders"].select("o_orderkey", "o_custkey"), t["supplier"].select("s_suppkey", "s_name")
    keys = {"supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_suppkey"], "orders": ["o_orderkey"], "customer": ["c_custkey"]}
    marked = {"supplier": t["supplier"].where(F.ilike("s_name", F.lit("%7")))}
    marked["lineitem"] = t["lineitem"].join(marked["supplier"], F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    stays, gone = cleaned(t, keys, marked, REFERENCES, POINTERS)
    out = None
    for name in ("supplier", "lineitem", "orders", "customer"):
        k = F.concat_ws("-", *keys[name])
        rows = stays[name].select(F.lit(name).alias("part"), k.alias("key"), F.lit(False).alias("removed")).union(t[name].join(gone[name], keys[name], "left_semi").select(F.lit(name), k, F.lit(True)))
        out = rows if out is None else out.union(rows)
    return out


def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: nodes for all parts, brands and suppliers, after those that are there for the parts with even keys; which known label or number each
    has. Numbers are dense, so they are compared as a range; the rerun adds none."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    known = p.where("p_partkey % 2 = 0").select((F.col("p_partkey") * 3).cast("long").alias("node_id"), F.lit("PART").alias("kind"), F.col("p_partkey").cast("long").alias("ref_id"), F.lit("old").alias("label"))
    wanted = p.select(F.lit("PART").alias("kind"), F.col("p_partkey").cast("long").alias("ref_id"), F.col("p_name").alias("label")).union(p.select(F.lit("BRAND"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long"), F.col("p_brand"))).union(s.select(F.lit("SUPPLIER"), F.col("s_suppkey").cast("long"), F.col("s_name")))
    once = ensure_nodes(known, wanted)
    twice = ensure_nodes(once, wanted)
    top = known.agg(F.max("node_id")).first()[0] or 0
    return twice.groupBy("kind", F.when(F.col("node_id") > top, "new").otherwise("known").alias("state")).agg(F.count("*").alias("nodes"), F.countDistinct("node_id").alias("ids"), F.min("label").alias("least_label"), F.countDistinct("ref_id").alias("refs"))


def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each turn's text put into an answer of one of four stages, by the turn's number with a fault of its own, and what is found in it."""
    c, k = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")), (F.col("conv_id") * 7 + F.col("turn") * 3) % 12
    words = F.filter(F.split("t", " "), lambda w: w != "")
    some = lambda n: F.slice(F.concat(words, F.array_repeat(F.lit("w"), 4)), 1, n)
    summary = F.to_json(F.struct(F.when(k == 1, some(2)).when(k == 2, some(4)).when(k == 3, F.array(F.lit("a"), F.lit(""), F.lit("b"))).otherwise(some(3)).alias("sentences")))
    entity = F.struct(F.when(k != 5, F.lit("s")).alias("surface"), F.lit("n").alias("normalized"), F.when(k == 4, F.lit("PLANET")).otherwise("ORG").alias("kind"), (F.length("t") / F.when(k == 6, F.lit(1.0)).otherwise(1e9)).alias("importance"), F.lit(True).alias("in_headline"), F.lit("SUBJECT").alias("role"))
    entities = F.to_json(F.struct(F.array_repeat(entity, F.when(k == 7, 21).otherwise(2)).alias("entities")))
    counter = F.to_json(F.struct(F.lit(False).alias("refuted"), F.col("t").alias("reason"), F.length("t").alias("adjusted_relevance")))
    stage = F.when(k <= 3, "SUMMARY").when(k <= 7, "ENTITY").when(k <= 9, "COUNTER").otherwise("SUMMARY")
    answers = c.select("conv_id", "turn", stage.alias("stage"), F.when(k <= 3, summary).when(k <= 7, entities).when(k <= 9, counter).when(k == 10, F.concat(F.lit("{"), "t")).otherwise(F.lit('["x"]')).alias("json"))
    return checked(answers).select("conv_id", "turn", "stage", "status", F.array_join("errors", "; ").alias("errors"))


QUERIES = {"cleanup": cleanup, "surrogate_keys": surrogate_keys, "schema_checks": schema_checks}

ORACLE_SQL = {
    "cleanup": """WITH sup AS (SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%7'),
ord AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM sup) AND l_orderkey IN (SELECT o_orderkey FROM orders)),
cand AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ord) EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ord)),
cus AS (SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT c FROM cand)), held AS (SELECT c_custkey - 1 AS c FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT c FROM cus))
SELECT 'supplier' AS part, CAST(s_suppkey AS VARCHAR) AS key, s_suppkey IN (SELECT s_suppkey FROM sup) AS removed FROM supplier
UNION ALL SELECT 'lineitem', concat_ws('-', l_orderkey, l_linenumber, l_suppkey), l_suppkey IN (SELECT s_suppkey FROM sup) OR l_orderkey IN (SELECT o_orderkey FROM ord) FROM lineitem
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), o_orderkey IN (SELECT o_orderkey FROM ord) FROM orders
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_custkey IN (SELECT c FROM cus) AND c_custkey NOT IN (SELECT c FROM held) FROM customer""",
    "surrogate_keys": """WITH k AS (SELECT 'PART' AS kind, p_partkey AS ref_id, 'old' AS label, 'known' AS state FROM part WHERE p_partkey % 2 = 0),
w AS (SELECT 'PART' AS kind, p_partkey AS ref_id, p_name AS label FROM part UNION ALL SELECT 'BRAND', CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), p_brand FROM part UNION ALL SELECT 'SUPPLIER', s_suppkey, s_name FROM supplier),
n AS (SELECT kind, ref_id, min(label) AS label, 'new' AS state FROM w WHERE (kind, ref_id) NOT IN (SELECT (kind, ref_id) FROM k) GROUP BY 1, 2), a AS (SELECT * FROM k UNION ALL SELECT * FROM n)
SELECT kind, state, count(*) AS nodes, count(*) AS ids, min(label) AS least_label, count(DISTINCT ref_id) AS refs FROM a GROUP BY 1, 2""",
    "schema_checks": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id * 7 + turn * 3) % 12 AS k FROM conversations),
u AS (SELECT *, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM c),
e AS (SELECT *, CASE k WHEN 1 THEN '$.sentences: too few elements' WHEN 2 THEN '$.sentences: too many elements' WHEN 3 THEN '$.sentences[1]: too short'
  WHEN 4 THEN '$.entities[0].kind: not one of the values; $.entities[1].kind: not one of the values' WHEN 5 THEN '$.entities[0].surface: not a string; $.entities[1].surface: not a string'
  WHEN 6 THEN CASE WHEN length(t) > 1 THEN '$.entities[0].importance: too large; $.entities[1].importance: too large' ELSE '' END WHEN 7 THEN '$.entities: too many elements' WHEN 10 THEN '$: not JSON' WHEN 11 THEN '$: not an object'
  WHEN 8 THEN concat_ws('; ', CASE WHEN units > 100 THEN '$.reason: too long' END, CASE WHEN length(t) > 100 THEN '$.adjusted_relevance: too large' END) WHEN 9 THEN concat_ws('; ', CASE WHEN units > 100 THEN '$.reason: too long' END, CASE WHEN length(t) > 100 THEN '$.adjusted_relevance: too large' END) ELSE '' END AS errors FROM u)
SELECT conv_id, turn, CASE WHEN k <= 3 THEN 'SUMMARY' WHEN k <= 7 THEN 'ENTITY' WHEN k <= 9 THEN 'COUNTER' ELSE 'SUMMARY' END AS stage, CASE WHEN errors = '' THEN 'OK' ELSE 'INVALID_JSON' END AS status, errors FROM e""",
}
