"""Graph queries that give tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.config import EDGE_LABELS
from braidwork.functions.scoring import graph_recall_score
from braidwork.operators import graph as G
from braidwork.operators.subgraph import Subgraph, assembled, with_evidence
from braidwork.plans.links import _WITH_WALK, ROUND, _walks
from braidwork.plans.market import score_sql
from braidwork.plans.scores import with_score
from braidwork.plans.views import table, view, with_views

#: The route's parameters here: 20 nodes and a score of 20.
NODES, SCORE = 20, 20


def cluster_graph_of(spark: SparkSession, sf_dir: str, max_nodes: int = NODES, min_score: int = SCORE) -> Subgraph:
    """The graphs of all clusters. A connection's path leads from its entity to its company, over the company's nation but for
    every third company; every 50th has none. Half of the entities have a record of their own."""
    key, sup = F.col("entity_id"), F.col("company_id").cast("long")
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("company_id"), "s_name", "n_name", "n_nationkey")
    c = with_score(view(spark, sf_dir, "connection").where("status <> 'PENDING'")).join(names, "company_id")
    step = lambda node, kind, label, edge: F.struct(node.cast("long").alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), edge.alias("edge_type"), F.lit(None).cast("string").alias("edge_label"))
    entity = step(key + 1000000, "ENTITY", F.concat(F.lit("e"), key), F.lit(None).cast("string"))
    concept = step(F.col("n_nationkey") + 2000, "CONCEPT", F.col("n_name"), F.when(key % 4 != 0, "RELATED_CONCEPT"))
    company = step(sup + 100000, "COMPANY", F.col("s_name"), F.when(sup % 3 == 0, "NAME_MATCH").when(sup % 2 == 0, "SUPPLY_CHAIN").otherwise("PERSON_OF"))
    path = F.when(F.col("id") % 50 == 0, F.slice(F.array(entity), 1, 0)).when(sup % 3 == 0, F.array(entity, company)).otherwise(F.array(entity, concept, company))
    connections = c.select(F.col("cluster_id").cast("long"), F.col("id").alias("connection_id"), "score", sup.alias("company_id"), F.lpad(sup.cast("string"), 6, "0").alias("ticker"), path.alias("path"))
    facts = view(spark, sf_dir, "edge").select(F.col("src").cast("long"), F.col("dst").cast("long"), "edge_type", "weight", (F.lit(0.2) + (F.col("edge_id") % 8) / 10).alias("confidence"), F.when(F.col("edge_id") % 3 == 0, F.concat(F.lit("doc-"), "edge_id")).alias("evidence"))
    refs = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select((F.col("p_partkey") + 1000000).cast("long").alias("node_id"), F.col("p_partkey").cast("long").alias("ref_id"))
    return assembled(connections, view(spark, sf_dir, "cluster").select(F.col("cluster_id").cast("long"), "headline"), facts, refs, max_nodes, min_score)


def cluster_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each cluster's graph."""
    return cluster_graph_of(spark, sf_dir).nodes


def cluster_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, numbered, with facts."""
    return cluster_graph_of(spark, sf_dir).edges.withColumn("weight", ROUND(F.col("weight"))).withColumn("confidence", ROUND(F.col("confidence")))


def cluster_graph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept connections as texts, with whether their cluster's graph leaves any out."""
    g = cluster_graph_of(spark, sf_dir)
    return g.clusters.join(g.texts, "cluster_id", "left").select("cluster_id", "kept", "truncated", "position", "connection_id", "text")


def path_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of three edges or fewer between nations and suppliers with path, rule, score and evidence; every 13th edge can't be looked up,
    nor can regions, so walks over them go."""
    nodes = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("node_id"), F.lit("CONCEPT").alias("kind"), F.col("n_name").alias("label"))
    nodes = nodes.union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 100000, F.lit("COMPANY"), F.col("s_name")))
    k = F.col("edge_id")
    edges = view(spark, sf_dir, "edge").where("edge_id % 13 <> 0").select("edge_id", "edge_type", "weight", (F.lit(0.2) + (k % 8) / 10).alias("confidence"), F.when(k % 2 == 0, "DART").otherwise("SEED").alias("origin"), F.when(k % 3 == 0, F.concat(F.lit("https://x.test/"), k)).alias("url"), F.when(k % 5 == 0, k.cast("string")).alias("doc_no"))
    w = with_evidence(_walks(spark, sf_dir), nodes, edges)
    rule = G.walk_rule(F.transform(F.slice("path", F.lit(2), F.size("path") - 1), lambda s: s["edge_type"]))
    shown = F.transform("evidence", lambda e: F.concat_ws("|", e["rule"], e["source"], e["label"], F.coalesce(e["url"], F.lit("-")), F.coalesce(e["doc_no"], F.lit("-"))))
    return w.select("start", F.array_join("nodes", ">").alias("nodes"), F.array_join(F.transform("path", lambda s: F.concat_ws("/", s["kind"], s["label"], s["edge_label"])), ">").alias("path"), F.array_join(shown, "; ").alias("evidence"), rule.alias("rule"), ROUND(graph_recall_score(rule, F.col("weight"))).alias("recall_score"), ROUND(F.array_min("edge_confidences")).alias("least_confidence"), ROUND(F.array_max("edge_weights")).alias("most_weight"))


QUERIES = {"cluster_graph_nodes": cluster_graph_nodes, "cluster_graph_edges": cluster_graph_edges, "cluster_graph_texts": cluster_graph_texts, "path_evidence": path_evidence}

_LABEL = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EDGE_LABELS.items()) + " END"
_GRAPH = with_views("connection", "cluster", "edge", recursive=True) + f""", sc AS (SELECT *, {score_sql("mr")} AS score FROM connection WHERE status <> 'PENDING'),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id, company_id, entity_id) AS n FROM sc),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n) AS k FROM rk WHERE n <= 200 AND score >= {SCORE}),
st AS (SELECT t.*, {{'node': 1000000 + entity_id, 'kind': 'ENTITY', 'label': 'e' || entity_id, 'type': NULL}} AS e, {{'node': 2000 + n_nationkey, 'kind': 'CONCEPT', 'label': n_name, 'type': CASE WHEN entity_id % 4 <> 0 THEN 'RELATED_CONCEPT' END}} AS m,
  {{'node': 100000 + company_id, 'kind': 'COMPANY', 'label': s_name, 'type': CASE WHEN company_id % 3 = 0 THEN 'NAME_MATCH' WHEN company_id % 2 = 0 THEN 'SUPPLY_CHAIN' ELSE 'PERSON_OF' END}} AS c FROM top t JOIN supplier ON s_suppkey = company_id JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT cluster_id, k, id, company_id, CASE WHEN id % 50 = 0 THEN [] WHEN company_id % 3 = 0 THEN [e, c] ELSE [e, m, c] END AS path FROM st),
q AS (SELECT *, list_transform(path, lambda s: CAST(s.node AS BIGINT)) AS ids FROM p),
fold AS (SELECT cluster_id, CAST(0 AS BIGINT) AS k, [CAST(-cluster_id AS BIGINT)] AS nodes, false AS kept, false AS missed FROM cluster
  UNION ALL SELECT f.cluster_id, q.k, CASE WHEN len(ids) > 0 AND len(nodes) + len(list_filter(ids, lambda x: NOT list_contains(nodes, x))) <= {NODES} THEN list_distinct(nodes || ids) ELSE nodes END,
    len(ids) > 0 AND len(nodes) + len(list_filter(ids, lambda x: NOT list_contains(nodes, x))) <= {NODES}, len(ids) > 0 AND len(nodes) + len(list_filter(ids, lambda x: NOT list_contains(nodes, x))) > {NODES} FROM fold f JOIN q ON q.cluster_id = f.cluster_id AND q.k = f.k + 1),
kept AS (SELECT q.*, row_number() OVER (PARTITION BY q.cluster_id ORDER BY q.k) AS pos FROM fold f JOIN q ON q.cluster_id = f.cluster_id AND q.k = f.k WHERE f.kept),
step AS (SELECT cluster_id, pos, i, path[i + 1] AS s, CASE WHEN i > 0 THEN path[i] END AS b, CASE WHEN path[i + 1].kind = 'COMPANY' AND i > 0 AND i = len(path) - 1 THEN company_id END AS own FROM kept, range(len(path)) r(i))"""
ORACLE_SQL = {
    "cluster_graph_nodes": _GRAPH + """, f AS (SELECT cluster_id, s.node AS node_id, arg_min({'pos': pos, 'i': i, 's': s, 'own': own}, (pos, i)) AS x FROM step GROUP BY 1, 2),
a AS (SELECT cluster_id, node_id, x.pos AS pos, x.i AS i, x.s.kind AS kind, CASE x.s.kind WHEN 'ENTITY' THEN CASE WHEN node_id % 2 = 0 AND node_id - 1000000 IN (SELECT p_partkey FROM part) THEN node_id - 1000000 ELSE node_id END ELSE coalesce(x.own, node_id) END AS ref_id, x.s.label AS label, lpad(CAST(x.own AS VARCHAR), 6, '0') AS ticker FROM f
  UNION ALL SELECT cluster_id, -cluster_id, 0, 0, 'NEWS', cluster_id, headline, NULL FROM cluster)
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY pos, i) AS INT) AS position, node_id, kind, CAST(ref_id AS BIGINT) AS ref_id, label, ticker, CASE kind WHEN 'NEWS' THEN 0 WHEN 'ENTITY' THEN 1 WHEN 'CONCEPT' THEN 2 ELSE 3 END AS lane FROM a""",
    "cluster_graph_edges": _GRAPH + f""", d AS (SELECT cluster_id, pos, i, CASE WHEN i > 0 THEN b.node ELSE -cluster_id END AS src, s.node AS dst, CASE WHEN i > 0 THEN coalesce(s.type, 'RELATED_CONCEPT') ELSE 'MENTIONS' END AS edge_type, CASE WHEN i = 0 THEN '언급' WHEN s.type IS NULL THEN '연관' ELSE {_LABEL.format("s.type")} END AS label FROM step),
o AS (SELECT cluster_id, src, dst, edge_type, min((pos, i)) AS place, arg_min(label, (pos, i)) AS label FROM d GROUP BY ALL)
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY place) AS INT) AS edge_id, o.src, o.dst, o.edge_type, floor(coalesce(weight, 0.5e0) * 1e6 + 0.5) / 1e6 AS weight,
  floor(coalesce(CASE WHEN edge.edge_id IS NOT NULL THEN 0.2e0 + (edge.edge_id % 8) / 10e0 END, 0.5e0) * 1e6 + 0.5) / 1e6 AS confidence, label, CASE WHEN edge.edge_id % 3 = 0 THEN 'doc-' || edge.edge_id END AS evidence
FROM o LEFT JOIN edge ON o.src = edge.src AND o.dst = edge.dst AND o.edge_type = edge.edge_type""".replace("GROUP BY ALL", "GROUP BY cluster_id, src, dst, edge_type"),
    "cluster_graph_texts": _GRAPH + """, t AS (SELECT cluster_id, CAST(count_if(kept) AS INT) AS kept, bool_or(missed) AS truncated FROM fold GROUP BY 1)
SELECT t.cluster_id, t.kept, t.truncated, CAST(pos AS INT) AS position, k.id AS connection_id, c.headline || ' → ' || array_to_string(list_transform(path, lambda s: s.label), ' → ') AS text FROM t JOIN cluster c ON c.cluster_id = t.cluster_id LEFT JOIN kept k ON k.cluster_id = t.cluster_id""",
    "path_evidence": _WITH_WALK.replace("[e.edge_type] AS types", "[e.edge_type] AS types, [e.edge_id] AS ids").replace("list_append(w.types, e.edge_type)", "list_append(w.types, e.edge_type), list_append(w.ids, e.edge_id)") + f""", node AS (SELECT 2000 + n_nationkey AS k, 'CONCEPT' AS kind, n_name AS label FROM nation UNION ALL SELECT 100000 + s_suppkey, 'COMPANY', s_name FROM supplier),
place AS (SELECT w.start, w.nodes, w.ids, w.weight, i, n.kind, n.label, lag(n.label) OVER (PARTITION BY w.nodes, w.ids ORDER BY i) AS past, e.edge_type AS t, {_LABEL.format("e.edge_type")} AS shown, e.edge_id, e.weight AS ew
  FROM walk w, range(1, len(w.nodes) + 1) r(i) JOIN node n ON n.k = w.nodes[i] LEFT JOIN edge e ON i > 1 AND e.edge_id = w.ids[i - 1] AND e.edge_id % 13 <> 0),
g AS (SELECT start, nodes, ids, weight, string_agg(concat_ws('/', kind, label, shown), '>' ORDER BY i) AS path, string_agg(concat_ws('|', t, CASE WHEN edge_id % 2 = 0 THEN 'DART' ELSE 'SEED' END, past || ' → ' || label || ' (' || shown || ')', CASE WHEN edge_id % 3 = 0 THEN 'https://x.test/' || edge_id ELSE '-' END, CASE WHEN edge_id % 5 = 0 THEN CAST(edge_id AS VARCHAR) ELSE '-' END), '; ' ORDER BY i) FILTER (i > 1) AS evidence,
  count(*) AS n, count(edge_id) AS m, min(0.2e0 + (edge_id % 8) / 10e0) AS lc, max(ew) AS mw, CASE WHEN bool_or(t = 'SUPPLY_CHAIN') THEN 'SUPPLY_DICT' WHEN bool_or(t = 'PERSON_OF') THEN 'PERSON_DICT' WHEN bool_and(t = 'AFFILIATION') THEN 'GRAPH_EXPAND' ELSE 'THEME_DICT' END AS rule FROM place GROUP BY start, nodes, ids, weight)
SELECT start, array_to_string(nodes, '>') AS nodes, path, evidence, rule, floor(least(1e0, CASE rule WHEN 'SUPPLY_DICT' THEN 0.75e0 WHEN 'PERSON_DICT' THEN 0.85e0 WHEN 'GRAPH_EXPAND' THEN 0.8e0 ELSE 0.7e0 END * weight) * 1e6 + 0.5) / 1e6 AS recall_score,
  floor(lc * 1e6 + 0.5) / 1e6 AS least_confidence, floor(mw * 1e6 + 0.5) / 1e6 AS most_weight FROM g WHERE n = len(nodes) AND m = len(ids)""",
}
