"""Graph of a cluster (G5, Q13) and evidence of walks (G3, J16): tables of nodes, edges and texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.operators.mappers import edge_label

#: The lane in which a kind of node stands (fixed values).
LANES = {"NEWS": 0, "ENTITY": 1, "CONCEPT": 2, "COMPANY": 3}
#: Label of a step that is no edge of the graph (fixed value).
UNTYPED_LABEL = "연관"


class Subgraph(NamedTuple):
    """clusters (cluster_id, kept, truncated), nodes, edges and texts of every cluster."""

    clusters: DataFrame
    nodes: DataFrame
    edges: DataFrame
    texts: DataFrame


def budgeted(connections: Column, news_id: Column, max_nodes: int) -> Column:
    """Struct (nodes, kept, truncated) of one cluster's connections, an array of structs with a `path`, best first.

    A fold in their order: a connection is kept if the nodes of its path that aren't there yet still fit in max_nodes,
    the news node included; a later, smaller one may fit again. One without a path is passed over.
    """
    ids = lambda c: F.transform(c["path"], lambda s: s["node_id"])
    start = F.struct(F.array(news_id).alias("nodes"), F.slice(connections, 1, 0).alias("kept"), F.lit(False).alias("truncated"))

    def step(acc: Column, c: Column) -> Column:
        fresh = F.filter(ids(c), lambda x: ~F.array_contains(acc["nodes"], x))
        has_path = F.size(c["path"]) > 0
        fits = has_path & (F.size(acc["nodes"]) + F.size(fresh) <= max_nodes)
        return F.struct(
            F.when(fits, F.array_union(acc["nodes"], fresh)).otherwise(acc["nodes"]).alias("nodes"),
            F.when(fits, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"),
            (acc["truncated"] | (has_path & ~fits)).alias("truncated"),
        )

    return F.aggregate(connections, start, step)


def kept_connections(connections: DataFrame, max_nodes: int = 60, most: int = 200) -> DataFrame:
    """G5 as flags: (cluster_id, connection_id, kept, truncated) of each cluster's best `most` connections (score, node_ids);
    ties by id, then nodes. See budgeted()."""
    best = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "connection_id", "node_ids")
    path = F.transform("node_ids", lambda x: F.struct(x.cast("long").alias("node_id")))
    top = connections.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).select("cluster_id", F.struct("k", "connection_id", path.alias("path")).alias("c"))
    lists = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list("c")).alias("connections"))
    g = lists.withColumn("g", budgeted(F.col("connections"), (-F.col("cluster_id")).cast("long"), max_nodes))
    flat = g.select("cluster_id", F.explode("connections").alias("c"), F.transform("g.kept", lambda c: c["k"]).alias("ks"), "g.truncated")
    return flat.select("cluster_id", "c.connection_id", F.array_contains("ks", F.col("c.k")).alias("kept"), "truncated")


def assembled(connections: DataFrame, clusters: DataFrame, facts: DataFrame, entity_refs: DataFrame, max_nodes: int = 60, min_score: int = 0, most: int = 200) -> Subgraph:
    """The graph that each cluster's connections make together.

    connections: cluster_id, connection_id, score, company_id, ticker, path (array of node_id, kind, label, edge_type,
    edge_label). clusters: cluster_id, headline. facts: src, dst, edge_type, weight, confidence, evidence, one row a key.
    entity_refs: node_id, ref_id of entity nodes.

    A cluster's best `most` connections (the route's own limit; ties: the smaller id, company, path) with at least min_score go through
    budgeted(), so one cluster is an array of that many at most, cut before the shuffle. The news node is -cluster_id.
    A node is what the first step to it says; a company has its id and ticker at the end of a path of more than one step. Edges are told
    apart by (src, dst, type) and numbered from 1 in the order in which they come up; a step without a type is
    RELATED_CONCEPT. Facts that aren't known are 0.5, 0.5 and null. A cluster without connections has its news node.
    """
    best = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "connection_id", "company_id", "path")
    row = F.struct((-F.col("score")).alias("order"), "connection_id", "company_id", "ticker", "path")
    top = connections.withColumn("_n", F.row_number().over(best)).where((F.col("_n") <= most) & (F.col("score") >= min_score))
    lists = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(row)).alias("connections"))
    news = (-F.col("cluster_id")).cast("long")
    folded = clusters.select("cluster_id", "headline").join(lists, "cluster_id", "left").withColumn("g", budgeted(F.col("connections"), news, max_nodes))
    count = F.coalesce(F.size("g.kept"), F.lit(0))
    summary = folded.select("cluster_id", F.greatest(count, F.lit(0)).alias("kept"), F.coalesce("g.truncated", F.lit(False)).alias("truncated"))

    kept = folded.select("cluster_id", "headline", F.posexplode("g.kept").alias("k", "c"))
    steps = kept.select("cluster_id", "k", "c.company_id", "c.ticker", F.size("c.path").alias("n"), F.col("c.path").alias("path"), F.posexplode("c.path").alias("i", "s"))
    at_end = (F.col("s.kind") == "COMPANY") & (F.col("i") > 0) & (F.col("i") == F.col("n") - 1)
    seen = steps.select("cluster_id", "k", "i", F.col("s.node_id").alias("node_id"), F.col("s.kind").alias("kind"), F.col("s.label").alias("label"), F.when(at_end, F.col("company_id")).alias("own"), F.when(at_end, F.col("ticker")).alias("ticker"))
    first = seen.groupBy("cluster_id", "node_id").agg(F.min(F.struct("k", "i", "kind", "label", "own", "ticker")).alias("f")).select("cluster_id", "node_id", "f.*")
    refs = entity_refs.select("node_id", F.col("ref_id").alias("_ref"))
    named = first.join(refs, "node_id", "left").withColumn("ref_id", F.when(F.col("kind") == "ENTITY", F.coalesce("_ref", "node_id")).otherwise(F.coalesce("own", "node_id")))
    head = clusters.select("cluster_id", news.alias("node_id"), F.lit(-1).alias("k"), F.lit(0).alias("i"), F.lit("NEWS").alias("kind"), F.col("headline").alias("label"), F.lit(None).cast("string").alias("ticker"), F.col("cluster_id").cast("long").alias("ref_id"))
    every = named.select(*head.columns).union(head)
    order = Window.partitionBy("cluster_id").orderBy("k", "i")
    lane = F.element_at(F.create_map(*(F.lit(x) for kv in LANES.items() for x in kv)), F.col("kind"))
    nodes = every.select("cluster_id", F.row_number().over(order).alias("position"), "node_id", "kind", "ref_id", "label", "ticker", lane.alias("lane"))

    before = F.when(F.col("i") > 0, F.try_element_at("path", F.col("i"))["node_id"]).otherwise(news)
    kind = F.when(F.col("i") > 0, F.coalesce("s.edge_type", F.lit("RELATED_CONCEPT"))).otherwise("MENTIONS")
    shown = F.when(F.col("i") > 0, F.coalesce("s.edge_label", edge_label(F.col("s.edge_type")), F.lit(UNTYPED_LABEL))).otherwise(edge_label(F.lit("MENTIONS")))
    drawn = steps.select("cluster_id", "k", "i", before.alias("src"), F.col("s.node_id").alias("dst"), kind.alias("edge_type"), shown.alias("label"))
    one = drawn.groupBy("cluster_id", "src", "dst", "edge_type").agg(F.min(F.struct("k", "i", "label")).alias("f")).select("cluster_id", "src", "dst", "edge_type", "f.*")
    numbered = one.withColumn("edge_id", F.row_number().over(order))
    known = facts.select("src", "dst", "edge_type", "weight", "confidence", "evidence")
    edges = numbered.join(known, ["src", "dst", "edge_type"], "left").select("cluster_id", "edge_id", "src", "dst", "edge_type", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "label", "evidence")
    labels = F.concat(F.array("headline"), F.transform("c.path", lambda s: s["label"]))
    texts = kept.select("cluster_id", (F.col("k") + 1).alias("position"), F.col("c.connection_id").alias("connection_id"), F.array_join(labels, " → ").alias("text"))
    return Subgraph(summary, nodes, edges, texts)


def with_evidence(walks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walks (start, nodes, edge_ids, hop, weight) with path, evidence, edge_confidences and edge_weights.

    nodes: node_id, kind, label. edges: edge_id, edge_type, confidence, weight, origin, url, doc_no. Node i and the edge
    that leads to it, edge i - 1, are looked up together, one row a place; a walk with any missing is dropped. path is an array of
    (node_id, kind, label, edge_type, edge_label), evidence one of (rule, source, label, url, doc_no) a step. Walks are told
    apart by their arrays themselves. Two equi-joins by id and one grouping of a walk's few places.
    """
    flat = walks.select("start", "nodes", "edge_ids", "hop", "weight", F.posexplode("nodes").alias("i", "node_id")).withColumn("edge_id", F.when(F.col("i") > 0, F.try_element_at("edge_ids", F.col("i"))))
    e = edges.select("edge_id", "edge_type", "confidence", F.col("weight").alias("edge_weight"), "origin", "url", "doc_no", F.lit(True).alias("known"))
    met = flat.join(nodes.select("node_id", "kind", "label"), "node_id").join(e, "edge_id", "left").where((F.col("i") == 0) | F.col("known"))
    place = F.struct("i", "node_id", "kind", "label", "edge_type", "confidence", "edge_weight", "origin", "url", "doc_no")
    whole = met.groupBy("start", "nodes", "edge_ids", "hop", "weight").agg(F.array_sort(F.collect_list(place)).alias("p")).where(F.size("p") == F.size("nodes"))
    path = F.transform("p", lambda s: F.struct(s["node_id"].alias("node_id"), s["kind"].alias("kind"), s["label"].alias("label"), s["edge_type"].alias("edge_type"), edge_label(s["edge_type"]).alias("edge_label")))
    later = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    text = lambda a, s: F.concat(a["label"], F.lit(" → "), s["label"], F.lit(" ("), edge_label(s["edge_type"]), F.lit(")"))
    shown = F.zip_with(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), later, lambda a, s: F.struct(s["edge_type"].alias("rule"), s["origin"].alias("source"), text(a, s).alias("label"), s["url"].alias("url"), s["doc_no"].alias("doc_no")))
    return whole.select("start", "nodes", "edge_ids", "hop", "weight", path.alias("path"), shown.alias("evidence"), F.transform(later, lambda s: s["confidence"]).alias("edge_confidences"), F.transform(later, lambda s: s["edge_weight"]).alias("edge_weights"))
