"""Graph operators (G1-G8) on edge tables (edge_id, src, dst, edge_type, weight, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import RECALL, Recall
from braidwork.operators.tables import stored


def walks(starts: DataFrame, edges: DataFrame, max_hops: int = RECALL.max_hops, floor: float = RECALL.weight_floor) -> DataFrame:
    """G1: all cycle-free walks from starts (start) of up to max_hops edges: start, node_id, hop, nodes, edge_ids, types, weight.

    One join with the edges a hop, for all starts at once. A step is taken only if the walk's weight stays at the floor
    or above; the first one always. Edges that a column `active` says are not are left out.
    """
    if "active" in edges.columns:
        edges = edges.where("active")
    e = edges.select("edge_id", "src", "dst", "edge_type", F.col("weight").alias("w"))
    step = starts.select("start").distinct().join(e, F.col("start") == F.col("src")).select(
        "start", F.col("dst").alias("node_id"), F.lit(1).alias("hop"), F.array("src", "dst").alias("nodes"), F.array("edge_id").alias("edge_ids"), F.array("edge_type").alias("types"), F.col("w").alias("weight")
    )
    out = step
    for hop in range(2, max_hops + 1):
        nxt = step.join(e, step.node_id == e.src).where(~F.array_contains("nodes", F.col("dst")) & (F.col("weight") * F.col("w") >= floor))
        step = nxt.select("start", F.col("dst").alias("node_id"), F.lit(hop).alias("hop"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("types", F.col("edge_type")).alias("types"), (F.col("weight") * F.col("w")).alias("weight"))
        out = out.union(step)
    return out


def walk_rule(types: Column) -> Column:
    """G2."""
    return (
        F.when(F.array_contains(types, "SUPPLY_CHAIN"), "SUPPLY_DICT")
        .when(F.array_contains(types, "PERSON_OF"), "PERSON_DICT")
        .when(F.forall(types, lambda t: t == "AFFILIATION"), "GRAPH_EXPAND")
        .otherwise("THEME_DICT")
    )


def company_walks(found: DataFrame, companies: DataFrame, limit: int = RECALL.cap) -> DataFrame:
    """The heaviest `limit` walks of each start that end on a company (node_id); ties by their nodes."""
    w = Window.partitionBy("start").orderBy(F.desc("weight"), "nodes")
    return found.join(companies.select("node_id"), "node_id", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def assemble_paths(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walks with `path`, an array of (node_id, kind, label, edge_type); edge i - 1 leads to node i. A walk with an
    unknown node is dropped. Nodes are looked up once a walk and node, and put together again in order."""
    keyed = found.withColumn("walk_id", F.xxhash64("start", "nodes", "edge_ids"))
    flat = keyed.select("walk_id", "types", F.posexplode("nodes").alias("i", "node_id")).join(nodes.select("node_id", "kind", "label"), "node_id")
    step = F.struct("i", "node_id", "kind", "label", F.when(F.col("i") > 0, F.element_at("types", F.when(F.col("i") > 0, F.col("i")).otherwise(1))).alias("edge_type"))
    paths = flat.groupBy("walk_id").agg(F.array_sort(F.collect_list(step)).alias("path"))
    return keyed.join(paths, "walk_id").where(F.size("path") == F.size("nodes")).drop("walk_id")


def concatenated(anchor: Column, walk: Column) -> Column:
    """Two paths that share a node, which is kept once."""
    return F.concat(anchor, F.slice(walk, F.lit(2), F.greatest(F.size(walk) - 1, F.lit(0))))


def merged(candidates: DataFrame, key: list[str], cfg: Recall = RECALL) -> DataFrame:
    """A company's best candidate (ties: the smaller `ordinal`), then the best cfg.cap of each key."""
    one = Window.partitionBy(*key, "company_id").orderBy(F.desc("recall_score"), "ordinal")
    best = candidates.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    top = Window.partitionBy(*key).orderBy(F.desc("recall_score"), "ordinal", "company_id")
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= cfg.cap)


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node_id, side) of all ancestors and descendants of each start; what is an ancestor isn't entered again as a descendant.

    Goes on until a hop finds nothing new, however deep the edges lead."""

    def reach(e: DataFrame, seen: DataFrame) -> DataFrame:
        front = starts.select("start", F.col("start").alias("node_id")).distinct()
        found, hops = front.limit(0), 0
        while True:
            nxt = front.join(e, front.node_id == e.src).select("start", F.col("dst").alias("node_id")).distinct()
            nxt = stored(nxt.join(seen, ["start", "node_id"], "left_anti").join(found, ["start", "node_id"], "left_anti").where("start <> node_id"), "front")
            if nxt.isEmpty():
                return found
            found, front, hops = found.union(nxt), nxt, hops + 1
            if hops % 16 == 0:  # one table again, so that plans stay short
                found = stored(found, "found")

    none = starts.select("start", F.col("start").alias("node_id")).limit(0)
    up = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), none)
    down = reach(edges.select("src", "dst"), up)
    return up.withColumn("side", F.lit("ancestor")).union(down.withColumn("side", F.lit("descendant")))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node_id, root): the smallest node that each node of links (a, b) reaches. Labels fall to the least of the
    neighbours' and jump to their own label's label each round; ends when none changes."""
    e = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).where("x is not null and y is not null").distinct(), "links")
    lab = stored(e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node_id"), F.least("x", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = e.join(lab.select(F.col("node_id").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("m"))
        low = lab.join(near, lab.node_id == near.x).select("node_id", F.least("root", "m").alias("low"), "root")
        new = low.join(lab.select(F.col("node_id").alias("k"), F.col("root").alias("r")), F.col("low") == F.col("k")).select("node_id", F.least("low", "r").alias("root"), (F.least("low", "r") != F.col("root")).alias("moved"))
        new = stored(new, "labels")
        lab = new.select("node_id", "root")
        if new.where("moved").isEmpty():
            return lab
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def flatten_merges(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, kind, canonical_id): roots of entities (id, kind, canonical_id) after synonyms (a, b) of one kind; null at roots."""
    own = entities.where("canonical_id is not null").select(F.col("id").alias("a"), F.col("canonical_id").alias("b"))
    kinds = entities.select("id", "kind")
    links = own.union(synonyms.select("a", "b")).join(kinds.select(F.col("id").alias("a"), F.col("kind").alias("ka")), "a").join(kinds.select(F.col("id").alias("b"), F.col("kind").alias("kb")), "b").where("ka = kb").select("a", "b")
    roots = components(links)
    return entities.select("id", "kind").join(roots, F.col("id") == F.col("node_id"), "left").select("id", "kind", F.when(F.col("root") != F.col("id"), F.col("root")).alias("canonical_id"))


def lanes(nodes: DataFrame, key: list[str], order: list[str], width: float, height: float, count: int = 4, padding: float = 36) -> DataFrame:
    """Nodes (key, lane, order) with x and y of the still layout: a lane's nodes stand evenly between the paddings, a single one in the middle."""
    w = Window.partitionBy(*key, "lane")
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    y = F.when(n == 1, F.lit(height / 2)).otherwise(F.lit(float(padding)) + i * F.lit(float(height - 2 * padding)) / (n - 1))
    return nodes.withColumn("x", F.col("lane") * F.lit(width / count) + F.lit(width / count / 2)).withColumn("y", y)
