"""Recall and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.functions.scoring import alias_edge, graph_recall_score
from braidwork.operators import building as B
from braidwork.operators import graph as G
from braidwork.operators.decisions import reference_judgements
from braidwork.operators.matching import best_aliases, best_vector, concept_hits, keyword_hits, similar_spellings, touching
from braidwork.operators.subgraph import kept_connections
from braidwork.plans.market import score_sql
from braidwork.plans.views import table, view, with_views

ROUND = lambda c: F.floor(c * 1e6 + 0.5) / 1e6


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th part's name with its last letter changed is an entity: a stated set of queries against all aliases."""
    p = table(spark, sf_dir, "part").where("p_partkey % 20 = 0")
    name = F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit("x"))
    return p.select(F.col("p_partkey").alias("entity_id"), name.alias("name"), F.lower(F.regexp_replace(name, "[ #]", "")).alias("norm")).withColumn("spelled", F.col("norm"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "alias").withColumn("alias_spelled", F.col("alias_norm"))


def alias_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's companies by their best alias."""
    return best_aliases(_entities(spark, sf_dir), _aliases(spark, sf_dir)).select("entity_id", "company_id", "alias_id", "rule", ROUND(F.col("recall_score")).alias("recall_score"))


def alias_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings with an edit similarity of 0.6 or more."""
    a = _aliases(spark, sf_dir).select(F.col("alias_norm").alias("y")).distinct()
    return similar_spellings(_entities(spark, sf_dir).select(F.col("norm").alias("x")).distinct(), a, 0.6).select("x", "y", ROUND(F.col("sim")).alias("sim"))


def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge that each best alias hit gives."""
    h = best_aliases(_entities(spark, sf_dir), _aliases(spark, sf_dir))
    return h.select("entity_id", "company_id", alias_edge(F.col("rule"), F.col("recall_score"), F.col("company_id") % 9 == 0).alias("e")).select("entity_id", "company_id", "e.edge_type", ROUND(F.col("e.weight")).alias("weight"), ROUND(F.col("e.confidence")).alias("confidence"))


def concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types against words of part names."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("concept_norm")).distinct().withColumn("concept_id", F.col("concept_norm"))
    names = p.select(F.lower(F.col("p_type")).alias("norm")).union(p.select(F.lower(F.regexp_replace("p_name", " ", "")).alias("norm"))).distinct().withColumn("name_id", F.col("norm"))
    return concept_hits(names, words).select("name_id", "concept_id")


def keyword_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that contain a keyword."""
    p = table(spark, sf_dir, "part")
    k = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("keyword_id"), F.substring("p_name", 2, 4).alias("keyword_norm"))
    return keyword_hits(p.select(F.col("p_partkey").alias("text_id"), F.array("p_name", "p_type").alias("texts")), k)


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.walks(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("start")), view(spark, sf_dir, "edge"))


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000).alias("node_id"))


def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All walks of three edges or fewer from each nation that end on a company, with rule and score."""
    w = _walks(spark, sf_dir).join(_companies(spark, sf_dir), "node_id", "left_semi")
    rule = G.walk_rule(F.col("types"))
    return w.select("start", "node_id", "hop", F.array_join("nodes", ">").alias("nodes"), ROUND(F.col("weight")).alias("weight"), rule.alias("rule"), ROUND(graph_recall_score(rule, F.col("weight"))).alias("recall_score"))


def graph_walk_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with its limit: a start's 40 heaviest walks."""
    w = G.company_walks(_walks(spark, sf_dir).withColumn("weight", ROUND(F.col("weight"))), _companies(spark, sf_dir))
    return w.select("start", "node_id", F.array_join("nodes", ">").alias("nodes"), "weight")


def recall_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of all rules in one list, a company's best, 40 of a start."""
    w = _walks(spark, sf_dir).join(_companies(spark, sf_dir), "node_id", "left_semi")
    c = w.select("start", F.col("node_id").alias("company_id"), ROUND(graph_recall_score(G.walk_rule(F.col("types")), F.col("weight"))).alias("recall_score"), F.array_join("nodes", ">").alias("ordinal"))
    return G.merged(c, ["start"]).select("start", "company_id", "recall_score", "rank")


def judged_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the offline judge takes each rule."""
    w = _walks(spark, sf_dir).join(_companies(spark, sf_dir), "node_id", "left_semi").select(G.walk_rule(F.col("types")).alias("recall_rule"))
    return reference_judgements(w).groupBy("recall_rule", "connection_type", "business_relevance", "meme_llm", "confidence_llm").agg(F.count("*").alias("n"))


def canonical_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier s is the same as s - 1 unless s is divisible by 7, and as s + 70 where s is divisible by 14."""
    k = F.col("s_suppkey").cast("long")
    s = table(spark, sf_dir, "supplier").select(k.alias("a"), F.when(k % 14 == 0, k + 70).when(k % 7 == 0, k).otherwise(k - 1).alias("b"))
    return G.components(s)


def ancestor_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures of all nations over edges but those among suppliers and back to regions."""
    e = view(spark, sf_dir, "edge").where("edge_type not in ('AFFILIATION', 'BELONGS_TO')")
    starts = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("start"))
    return G.closure(starts, e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))).select("start", "node_id", "side")


def edges_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("node_id"))
    return touching(view(spark, sf_dir, "edge"), n).select("edge_id", "src", "dst")


def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All walks of three edges or fewer between nations and suppliers as text."""
    nodes = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("node_id"), F.lit("CONCEPT").alias("kind"), F.col("n_name").alias("label"))
    nodes = nodes.union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 100000, F.lit("COMPANY"), F.col("s_name")))
    w = _walks(spark, sf_dir)
    return G.assemble_paths(w, nodes, view(spark, sf_dir, "edge")).select("start", "node_id", F.array_join(F.transform("path", lambda s: s["label"]), " → ").alias("path"))


def cluster_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of each cluster that fit into 12 nodes."""
    c = view(spark, sf_dir, "connection").where("status <> 'PENDING' and br >= 50")
    return kept_connections(c.select(F.col("cluster_id").cast("long"), F.col("id").alias("connection_id"), F.col("br").alias("score"), F.array(F.col("company_id") + 100000, F.col("entity_id") + 1000000).alias("node_ids")), 12)


def vec_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the nearest other vector of every 20th one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return best_vector(v.where("vec_id % 20 = 0"), v).select("query_id", "vec_id", (F.floor(F.col("cosine") * 1e5 + 0.5) / 1e5).alias("cosine"))


QUERIES = {
    "alias_recall": alias_recall, "alias_similar": alias_similar, "alias_edges": alias_edges, "concept_match": concept_match, "keyword_alerts": keyword_alerts, "graph_walk": graph_walk, "graph_walk_top": graph_walk_top, "recall_merge": recall_merge,
    "judged_walks": judged_walks, "canonical_components": canonical_components, "ancestor_descendant": ancestor_descendant, "edges_touching": edges_touching, "path_labels": path_labels, "cluster_graph": cluster_graph, "vec_top1": vec_top1,
}

_R = "floor(({}) * 1e6 + 0.5) / 1e6"
_ENT = """, ent AS (SELECT p_partkey AS entity_id, substr(p_name, 1, length(p_name) - 1) || 'x' AS name, lower(regexp_replace(substr(p_name, 1, length(p_name) - 1) || 'x', '[ #]', '', 'g')) AS norm FROM part WHERE p_partkey % 20 = 0),
pair AS (SELECT e.*, a.*, 1 - levenshtein(norm, alias_norm) / greatest(length(norm), length(alias_norm)) AS sim,
  least(length(norm), length(alias_norm)) >= 2 AND (starts_with(alias_norm, norm) OR starts_with(norm, alias_norm)) AS pre FROM ent e, alias a),
hit AS (SELECT *, CASE WHEN norm = alias_norm THEN 'ALIAS_EXACT' WHEN pre THEN 'ALIAS_PREFIX' WHEN sim >= 0.6 THEN 'ALIAS_JAMO_SIMILAR' WHEN left(name, 1) = left(alias, 1) THEN 'ALIAS_PREFIX' END AS rule FROM pair),
scored AS (SELECT *, CASE rule WHEN 'ALIAS_EXACT' THEN 1e0 WHEN 'ALIAS_PREFIX' THEN 0.55e0 ELSE 0.35e0 + sim * 0.4e0 END AS recall_score FROM hit WHERE rule IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY entity_id, company_id ORDER BY recall_score DESC, alias_id) AS n FROM scored)"""
_WALK = """, walk AS (
  SELECT e.src AS start, e.dst AS node_id, 1 AS hop, [e.src, e.dst] AS nodes, [e.edge_type] AS types, e.weight AS weight FROM edge e JOIN nation ON e.src = 2000 + n_nationkey
  UNION ALL SELECT w.start, e.dst, w.hop + 1, list_append(w.nodes, e.dst), list_append(w.types, e.edge_type), w.weight * e.weight FROM walk w JOIN edge e ON e.src = w.node_id
  WHERE w.hop < 3 AND NOT list_contains(w.nodes, e.dst) AND w.weight * e.weight >= 0.15e0),
cw AS (SELECT *, array_to_string(nodes, '>') AS path, CASE WHEN list_contains(types, 'SUPPLY_CHAIN') THEN 'SUPPLY_DICT' WHEN list_contains(types, 'PERSON_OF') THEN 'PERSON_DICT' WHEN len(list_filter(types, lambda t: t <> 'AFFILIATION')) = 0 THEN 'GRAPH_EXPAND' ELSE 'THEME_DICT' END AS rule
  FROM walk WHERE node_id IN (SELECT 100000 + s_suppkey FROM supplier)),
sw AS (SELECT *, least(1e0, CASE rule WHEN 'SUPPLY_DICT' THEN 0.75e0 WHEN 'PERSON_DICT' THEN 0.85e0 WHEN 'GRAPH_EXPAND' THEN 0.8e0 ELSE 0.7e0 END * weight) AS recall_score FROM cw)"""
_WITH_WALK = with_views("edge", recursive=True) + _WALK

ORACLE_SQL = {
    "alias_recall": with_views("alias") + _ENT + f" SELECT entity_id, company_id, alias_id, rule, {_R.format('recall_score')} AS recall_score FROM best WHERE n = 1",
    "alias_similar": with_views("alias") + _ENT + f" SELECT DISTINCT norm AS x, alias_norm AS y, {_R.format('sim')} AS sim FROM pair WHERE sim >= 0.6",
    "alias_edges": with_views("alias") + _ENT + f""" SELECT entity_id, company_id, CASE rule WHEN 'ALIAS_EXACT' THEN 'NAME_MATCH' ELSE 'NAME_SIMILAR' END AS edge_type, {_R.format('recall_score')} AS weight,
  {_R.format("least(1e0, greatest(0e0, recall_score - CASE WHEN company_id % 9 = 0 THEN 0.3e0 ELSE 0e0 END))")} AS confidence FROM best WHERE n = 1""",
    "concept_match": """WITH c AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS c FROM part), n AS (SELECT lower(p_type) AS n FROM part UNION SELECT lower(replace(p_name, ' ', '')) FROM part)
SELECT n AS name_id, c AS concept_id FROM n, c WHERE length(n) >= 2 AND length(c) >= 2 AND (contains(n, c) OR contains(c, n))""",
    "keyword_alerts": "SELECT p.p_partkey AS text_id, k.p_partkey AS keyword_id FROM part p, part k WHERE k.p_partkey % 20 = 0 AND (contains(p.p_name, substr(k.p_name, 2, 4)) OR contains(p.p_type, substr(k.p_name, 2, 4)))",
    "graph_walk": _WITH_WALK + f" SELECT start, node_id, hop, path AS nodes, {_R.format('weight')} AS weight, rule, {_R.format('recall_score')} AS recall_score FROM sw",
    "graph_walk_top": _WITH_WALK + f", r AS (SELECT start, node_id, path, nodes, {_R.format('weight')} AS weight FROM cw), t AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY weight DESC, nodes) AS n FROM r) SELECT start, node_id, path AS nodes, weight FROM t WHERE n <= 40",
    "recall_merge": _WITH_WALK + f""", r AS (SELECT start, node_id, path, {_R.format('recall_score')} AS s FROM sw), b AS (SELECT *, row_number() OVER (PARTITION BY start, node_id ORDER BY s DESC, path) AS n FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY s DESC, path, node_id) AS k FROM b WHERE n = 1) SELECT start, node_id AS company_id, s AS recall_score, CAST(k AS INT) AS rank FROM t WHERE k <= 40""",
    "judged_walks": _WITH_WALK + """ SELECT rule AS recall_rule, CASE rule WHEN 'GRAPH_EXPAND' THEN 'AFFILIATION' WHEN 'SUPPLY_DICT' THEN 'SUPPLY_CHAIN' WHEN 'PERSON_DICT' THEN 'PERSON' ELSE 'THEME' END AS connection_type,
  CASE rule WHEN 'GRAPH_EXPAND' THEN 8 WHEN 'SUPPLY_DICT' THEN 75 WHEN 'PERSON_DICT' THEN 60 ELSE 40 END AS business_relevance, CASE rule WHEN 'GRAPH_EXPAND' THEN 70 WHEN 'THEME_DICT' THEN 10 ELSE 0 END AS meme_llm, 90 AS confidence_llm, count(*) AS n FROM cw GROUP BY 1, 2, 3, 4, 5""",
    "canonical_components": """WITH RECURSIVE e AS (SELECT s_suppkey AS a, CASE WHEN s_suppkey % 14 = 0 THEN s_suppkey + 70 WHEN s_suppkey % 7 = 0 THEN s_suppkey ELSE s_suppkey - 1 END AS b FROM supplier), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node_id, a AS x FROM l UNION SELECT r.node_id, l.b FROM r JOIN l ON r.x = l.a) SELECT node_id, min(x) AS root FROM r GROUP BY node_id""",
    "ancestor_descendant": with_views("edge", recursive=True) + """, e AS (SELECT src, dst FROM edge WHERE edge_type NOT IN ('AFFILIATION', 'BELONGS_TO')), s AS (SELECT 2000 + n_nationkey AS start FROM nation),
up AS (SELECT start, start AS node_id FROM s UNION SELECT u.start, e.src FROM up u JOIN e ON e.dst = u.node_id),
down AS (SELECT start, start AS node_id FROM s UNION SELECT d.start, e.dst FROM down d JOIN e ON e.src = d.node_id)
SELECT start, node_id, 'ancestor' AS side FROM up WHERE node_id <> start UNION ALL SELECT start, node_id, 'descendant' FROM down WHERE node_id <> start AND (start, node_id) NOT IN (SELECT (start, node_id) FROM up)""",
    "edges_touching": with_views("edge") + ", n AS (SELECT 2000 + n_nationkey AS k FROM nation) SELECT edge_id, src, dst FROM edge WHERE src IN (SELECT k FROM n) OR dst IN (SELECT k FROM n)",
    "path_labels": _WITH_WALK + """, lab AS (SELECT 2000 + n_nationkey AS k, n_name AS label FROM nation UNION ALL SELECT 100000 + s_suppkey, s_name FROM supplier)
SELECT w.start, w.node_id, concat_ws(' → ', a.label, b.label, c.label, d.label) AS path FROM walk w JOIN lab a ON a.k = w.nodes[1] JOIN lab b ON b.k = w.nodes[2] LEFT JOIN lab c ON c.k = w.nodes[3] LEFT JOIN lab d ON d.k = w.nodes[4] WHERE (hop < 2 OR c.k IS NOT NULL) AND (hop < 3 OR d.k IS NOT NULL)""",
    "cluster_graph": with_views("connection", recursive=True) + """, o AS (SELECT cluster_id, id, CAST([company_id, entity_id + 1000000] AS BIGINT[]) AS ids, row_number() OVER (PARTITION BY cluster_id ORDER BY br DESC, id, company_id, entity_id) AS k FROM connection WHERE status <> 'PENDING' AND br >= 50),
fold AS (SELECT DISTINCT cluster_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS id, CAST([] AS BIGINT[]) AS nodes, false AS kept FROM o
  UNION ALL SELECT o.cluster_id, o.k, o.id, CASE WHEN len(list_distinct(nodes || ids)) <= 11 THEN list_distinct(nodes || ids) ELSE nodes END, len(list_distinct(nodes || ids)) <= 11 FROM fold f JOIN o ON o.cluster_id = f.cluster_id AND o.k = f.k + 1 AND o.k <= 200)
SELECT cluster_id, id AS connection_id, kept, bool_or(NOT kept) OVER (PARTITION BY cluster_id) AS truncated FROM fold WHERE k > 0""",
    "vec_top1": """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, arg_max(vec_id, (c, -vec_id)) AS vec_id, floor(max(c) * 1e5 + 0.5) / 1e5 AS cosine FROM p GROUP BY query_id""",
}


def _stage(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nations as entities (every third a person) and concepts, suppliers as companies with their nation's name as a brand."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key = F.col("n_nationkey").cast("long")
    named = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    entities = n.select(key.alias("entity_id"), F.col("n_name").alias("name"), named(F.col("n_name")).alias("norm"), F.when(key % 3 == 0, "PERSON").otherwise("ORG").alias("kind"), (key + 2000).alias("node_id")).withColumn("spelled", F.col("norm"))
    sk = F.col("s_suppkey").cast("long")
    brands = s.join(n, s.s_nationkey == n.n_nationkey).select((sk * 2).alias("alias_id"), sk.alias("company_id"), F.col("n_name").alias("alias"), F.lit("BRAND").alias("alias_type"))
    aliases = brands.union(s.select(sk * 2 + 1, sk, F.col("s_name"), F.lit("OFFICIAL"))).withColumn("alias_norm", named(F.col("alias"))).withColumn("alias_spelled", F.col("alias_norm")).withColumn("is_ambiguous", F.col("company_id") % 9 == 0)
    edges = view(spark, sf_dir, "edge").withColumn("src", F.col("src").cast("long")).withColumn("dst", F.col("dst").cast("long")).withColumn("confidence", F.lit(0.2) + (F.col("edge_id") % 8) / 10)
    return {"entities": entities, "aliases": aliases, "companies": s.select(sk.alias("company_id"), (sk + 100000).alias("node_id")), "concepts": n.select(named(F.col("n_name")).alias("concept_norm"), (key + 2000).alias("node_id")), "edges": edges}


def recall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's candidates by alias, expansion, dictionary and person."""
    c = B.recalled(**_stage(spark, sf_dir))
    return c.select("entity_id", "company_id", "recall_rule", ROUND(F.col("recall_score")).alias("recall_score"), "hop_count", "keyword_match", F.array_join("nodes", ">").alias("nodes"), "rank")


def build_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through the offline judge, guardrails, a check that refutes every seventh company, scores and review state."""
    t = _stage(spark, sf_dir)
    j = reference_judgements(B.recalled(**t)).withColumn("explanation", F.concat(F.lit("makes "), (F.col("company_id") % 4).cast("string")))
    own = j.select("entity_id", F.collect_list("company_id").over(Window.partitionBy("entity_id")).alias("candidate_ids"), "company_id")  # 40 at most
    j = j.join(own, ["entity_id", "company_id"]).withColumn("outside_terms", F.array(F.lit("makes 3"))).withColumn("business_summary", F.when(F.col("company_id") % 2 == 0, "parts")).withColumn("path_labels", F.array(F.lit("parts")))
    j = j.withColumn("dangerous", F.col("entity_id") % 5 == 0).withColumn("negative_person", F.lit(False))
    checks = j.where("company_id % 7 = 0").select(F.concat_ws(":", "entity_id", "company_id").alias("connection_id"))
    c = B.built(j, checks.select("connection_id", F.lit(True).alias("refuted"), F.lit(25).cast("long").alias("adjusted"), F.lit("r").alias("reason")))
    return c.select("entity_id", "company_id", "connection_type", "business_relevance", "meme", F.col("sure").alias("confidence"), "supply_chain", "score", "band", "status", "counter_reason")


QUERIES |= {"recall_all": recall_all, "build_connections": build_connections}

_RECALL = with_views("edge", recursive=True) + """, ed AS (SELECT *, 0.2e0 + (edge_id % 8) / 1e1 AS conf FROM edge),
ent AS (SELECT n_nationkey AS entity_id, n_name AS name, lower(replace(n_name, ' ', '')) AS norm, n_nationkey % 3 = 0 AS person, 2000 + n_nationkey AS node FROM nation),
ali AS (SELECT s_suppkey * 2 AS alias_id, s_suppkey AS company_id, n_name AS alias, 0.9e0 AS times FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, s_name, 1e0 FROM supplier),
prs AS (SELECT *, lower(replace(alias, ' ', '')) AS an, 1 - levenshtein(norm, lower(replace(alias, ' ', ''))) / greatest(length(norm), length(lower(replace(alias, ' ', '')))) AS sim FROM ent, ali),
hit AS (SELECT *, CASE WHEN norm = an THEN 'ALIAS_EXACT' WHEN starts_with(an, norm) OR starts_with(norm, an) THEN 'ALIAS_PREFIX' WHEN sim >= 0.6 THEN 'ALIAS_JAMO_SIMILAR' WHEN left(name, 1) = left(alias, 1) THEN 'ALIAS_PREFIX' END AS rule FROM prs),
sco AS (SELECT *, CASE rule WHEN 'ALIAS_EXACT' THEN 1e0 WHEN 'ALIAS_PREFIX' THEN 0.55e0 ELSE 0.35e0 + sim * 0.4e0 END AS s, company_id % 9 = 0 AS amb FROM hit WHERE rule IS NOT NULL),
al AS (SELECT *, 100000 + company_id AS cnode, least(1e0, greatest(0e0, s - CASE WHEN amb THEN 0.3e0 ELSE 0e0 END)) AS ec,
  CAST(floor(least(100, greatest(0, CASE WHEN norm = an THEN 100 * times ELSE floor(100 * sim + 0.5) * times + CASE WHEN left(norm, 1) = left(an, 1) THEN 12 ELSE 0 END END - CASE WHEN amb THEN 25 ELSE 0 END)) + 0.5) AS BIGINT) AS km
  FROM sco QUALIFY row_number() OVER (PARTITION BY entity_id, company_id ORDER BY s DESC, alias_id) = 1),
walk AS (SELECT src AS start, dst AS node_id, 1 AS hop, [src, dst] AS nodes, [edge_type] AS types, [weight] AS ws, [conf] AS cs, weight FROM ed
  UNION ALL SELECT w.start, e.dst, w.hop + 1, list_append(w.nodes, e.dst), list_append(w.types, e.edge_type), list_append(ws, e.weight), list_append(cs, e.conf), w.weight * e.weight FROM walk w JOIN ed e ON e.src = w.node_id WHERE w.hop < 3 AND NOT list_contains(w.nodes, e.dst) AND w.weight * e.weight >= 0.15e0),
wr AS (SELECT *, node_id - 100000 AS company_id, CASE WHEN list_contains(types, 'SUPPLY_CHAIN') THEN 'SUPPLY_DICT' WHEN list_contains(types, 'PERSON_OF') THEN 'PERSON_DICT' WHEN len(list_filter(types, lambda t: t <> 'AFFILIATION')) = 0 THEN 'GRAPH_EXPAND' ELSE 'THEME_DICT' END AS rule
  FROM walk WHERE node_id - 100000 IN (SELECT s_suppkey FROM supplier)),
wk AS (SELECT *, least(1e0, CASE rule WHEN 'SUPPLY_DICT' THEN 0.75e0 WHEN 'PERSON_DICT' THEN 0.85e0 WHEN 'GRAPH_EXPAND' THEN 0.8e0 ELSE 0.7e0 END * weight) AS s FROM wr),
w1 AS (SELECT * FROM wk WHERE hop = 1 QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, nodes) <= 40), w3 AS (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, nodes) <= 40),
cand AS (SELECT entity_id, company_id, rule, s, 1 AS hops, [node, cnode] AS nodes, [CASE rule WHEN 'ALIAS_EXACT' THEN 'NAME_MATCH' ELSE 'NAME_SIMILAR' END] AS types, [s] AS ws, [ec] AS cs, km, amb, '0:' || alias_id AS ordinal FROM al
  UNION ALL SELECT al.entity_id, w.company_id, w.rule, w.s, 2, [al.node, al.cnode, w.node_id], list_concat([CASE al.rule WHEN 'ALIAS_EXACT' THEN 'NAME_MATCH' ELSE 'NAME_SIMILAR' END], w.types), list_concat([al.s], w.ws), list_concat([al.ec], w.cs), km, amb, '1:' || array_to_string(list_concat([al.node], w.nodes), '>')
    FROM al JOIN w1 w ON w.start = al.cnode WHERE w.company_id <> al.company_id
  UNION ALL SELECT e.entity_id, w.company_id, w.rule, w.s, w.hop + 1, list_concat([e.node], w.nodes), list_concat(['RELATED_CONCEPT'], w.types), list_concat([1e0], w.ws), list_concat([1e0], w.cs), 0, FALSE, '2:' || array_to_string(list_concat([e.node], w.nodes), '>')
    FROM ent e JOIN ent k ON contains(e.norm, k.norm) OR contains(k.norm, e.norm) JOIN w3 w ON w.start = k.node
  UNION ALL SELECT e.entity_id, w.company_id, w.rule, w.s, w.hop, w.nodes, w.types, w.ws, w.cs, 0, FALSE, '3:' || array_to_string(w.nodes, '>') FROM ent e JOIN w3 w ON w.start = e.node WHERE person),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY entity_id, company_id ORDER BY s DESC, ordinal) = 1),
rec AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, ordinal, company_id) AS rank FROM one QUALIFY rank <= 40)"""
ORACLE_SQL["recall_all"] = _RECALL + f" SELECT entity_id, company_id, rule AS recall_rule, {_R.format('s')} AS recall_score, hops AS hop_count, km AS keyword_match, array_to_string(nodes, '>') AS nodes, CAST(rank AS INT) AS rank FROM rec"
ORACLE_SQL["build_connections"] = _RECALL + f""", j AS (SELECT *, CASE rule WHEN 'ALIAS_EXACT' THEN 'NAME_MATCH' WHEN 'ALIAS_PREFIX' THEN 'MEME' WHEN 'ALIAS_JAMO_SIMILAR' THEN 'MEME' WHEN 'GRAPH_EXPAND' THEN 'AFFILIATION' WHEN 'SUPPLY_DICT' THEN 'SUPPLY_CHAIN' WHEN 'PERSON_DICT' THEN 'PERSON' ELSE 'THEME' END AS kind,
  CASE rule WHEN 'ALIAS_EXACT' THEN 10 WHEN 'ALIAS_PREFIX' THEN 15 WHEN 'ALIAS_JAMO_SIMILAR' THEN 15 WHEN 'GRAPH_EXPAND' THEN 8 WHEN 'SUPPLY_DICT' THEN 75 WHEN 'PERSON_DICT' THEN 60 ELSE 40 END AS b0,
  CASE rule WHEN 'ALIAS_EXACT' THEN 85 WHEN 'ALIAS_PREFIX' THEN 75 WHEN 'ALIAS_JAMO_SIMILAR' THEN 75 WHEN 'GRAPH_EXPAND' THEN 70 WHEN 'SUPPLY_DICT' THEN 0 WHEN 'PERSON_DICT' THEN 0 ELSE 10 END AS ml FROM rec),
g AS (SELECT *, CASE WHEN b0 >= 60 AND company_id % 2 <> 0 THEN 59 ELSE b0 END AS b1 FROM j WHERE NOT (entity_id % 5 = 0 AND kind = 'MEME') AND hops <= 4 AND len(list_distinct(nodes)) = len(nodes)),
c AS (SELECT *, b1 >= 60 AND company_id % 7 = 0 AS refuted, CAST(CASE WHEN b1 >= 60 AND company_id % 7 = 0 THEN 25 ELSE b1 END AS BIGINT) AS br FROM g),
f AS (SELECT *, CAST(NULL AS BIGINT) AS mr, amb AS ambiguous, len(list_filter(cs, lambda x: x <= 0.3)) > 0 AS gap, CAST(floor(list_min(cs) * 90 / 100 * 100 + 0.5) AS BIGINT) AS cf,
  CAST(coalesce(floor(100 * list_min(list_transform(list_filter(list_zip(types, ws), lambda x: x[1] = 'SUPPLY_CHAIN'), lambda x: x[2])) + 0.5), 0) AS BIGINT) AS sc,
  least(100, greatest(0, (0.5e0 * ml + 0.3e0 * (100 - br)) / 0.8e0)) AS m0 FROM c),
h AS (SELECT *, CAST(floor(CASE WHEN kind = 'MEME' THEN greatest(m0, 50) ELSE m0 END + 0.5) AS BIGINT) AS meme FROM f), s AS (SELECT *, CAST({score_sql("mr")} AS BIGINT) AS score FROM h)
SELECT entity_id, company_id, kind AS connection_type, br AS business_relevance, meme, cf AS confidence, sc AS supply_chain, score, CASE WHEN br >= 70 THEN 'HIGH' WHEN br >= 40 THEN 'MEDIUM' WHEN br >= 15 THEN 'LOW' ELSE 'NONE' END AS band,
  CASE WHEN br >= 80 OR score >= 90 OR meme >= 90 OR hops >= 4 OR amb THEN 'PENDING' ELSE 'ACTIVE' END AS status, CASE WHEN refuted THEN 'r' END AS counter_reason FROM s"""
