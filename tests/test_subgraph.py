"""The graph of a cluster and the evidence of walks, by hand and against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.config import EDGE_LABELS
from braidwork.operators.subgraph import assembled, kept_connections, with_evidence

STEP = "struct<node_id:bigint,kind:string,label:string,edge_type:string,edge_label:string>"
CONNECTION = f"cluster_id long, connection_id long, score long, company_id long, ticker string, path array<{STEP}>"


def entity(i):
    return (i, "ENTITY", f"e{i}", None, None)


def concept(i, edge=None, label=None):
    return (i, "CONCEPT", f"c{i}", edge, label)


def company(i, edge="SUPPLY_CHAIN"):
    return (i, "COMPANY", f"k{i}", edge, None)


def plain(connections, clusters, facts, refs, max_nodes, min_score, most):
    """Connection by connection, as the rules say."""
    nodes, edges, texts, cut = [], [], [], {}
    for cid, headline in clusters:
        mine = sorted((c for c in connections if c[0] == cid), key=lambda c: (-c[2], c[1]))[:most]
        have = {-cid: ("NEWS", cid, headline, None)}
        drawn, cut[cid], n = {}, False, 0
        for _, k, score, own, ticker, path in mine:
            if score < min_score or not path:
                continue
            if len(have) + sum(s[0] not in have for s in path) > max_nodes:
                cut[cid] = True
                continue
            n += 1
            texts.append((cid, n, k, " → ".join([headline, *(s[2] for s in path)])))
            for i, (node, kind, label, edge, shown) in enumerate(path):
                end = kind == "COMPANY" and i == len(path) - 1 and i > 0
                ref = own if end else refs.get(node, node) if kind == "ENTITY" else node
                have.setdefault(node, (kind, ref, label, ticker if end else None))
                src, edge_kind = (path[i - 1][0], edge or "RELATED_CONCEPT") if i else (-cid, "MENTIONS")
                drawn.setdefault((src, node, edge_kind), EDGE_LABELS["MENTIONS"] if not i else shown or EDGE_LABELS.get(edge, "연관"))
        nodes += [(cid, i, node, *have[node][:3], have[node][3], {"NEWS": 0, "ENTITY": 1, "CONCEPT": 2, "COMPANY": 3}[have[node][0]]) for i, node in enumerate(have, 1)]
        edges += [(cid, i, *key, *facts.get(key, (0.5, 0.5, None))[:2], drawn[key], facts.get(key, (0, 0, None))[2]) for i, key in enumerate(drawn, 1)]
    return set(nodes), set(edges), set(texts), cut


@pytest.mark.parametrize(("max_nodes", "min_score", "most"), [(60, 0, 200), (6, 0, 200), (8, 40, 200), (9, 0, 5), (1, 0, 200)])
def test_assembled(spark, max_nodes, min_score, most):
    rng = random.Random(max_nodes)
    connections = []
    for k in range(150):
        middle = [concept(rng.randint(10, 14), rng.choice([None, "RELATED_CONCEPT"]), rng.choice([None, "shown"])) for _ in range(rng.randint(0, 2))]
        path = rng.choice([[], [company(rng.randint(20, 25))], [entity(rng.randint(1, 6)), *middle, company(rng.randint(20, 29))]])
        connections.append((rng.randint(1, 4), k, rng.randint(0, 90), path[-1][0] - 20 if path else 0, "t", path))
    clusters = [(c, f"head {c}") for c in range(1, 6)]
    facts = {(1, 20, "SUPPLY_CHAIN"): (0.9, 0.7, "d1"), (10, 21, "SUPPLY_CHAIN"): (0.2, 0.1, None), (99, 98, "PRODUCES"): (1.0, 1.0, "x")}
    refs = {1: 1001, 2: 1002}
    g = assembled(
        spark.createDataFrame(connections, CONNECTION).repartition(3), spark.createDataFrame(clusters, "cluster_id long, headline string"),
        spark.createDataFrame([(*k, *v) for k, v in facts.items()], "src long, dst long, edge_type string, weight double, confidence double, evidence string"),
        spark.createDataFrame(list(refs.items()), "node_id long, ref_id long"), max_nodes, min_score, most,
    )
    nodes, edges, texts, cut = plain(connections, clusters, facts, refs, max_nodes, min_score, most)
    assert {tuple(r) for r in g.nodes.collect()} == nodes
    assert {tuple(r) for r in g.edges.collect()} == edges
    assert {tuple(r) for r in g.texts.collect()} == texts
    assert {r["cluster_id"]: r["truncated"] for r in g.clusters.collect()} == cut
    assert {r["cluster_id"]: r["kept"] for r in g.clusters.collect()} == {c: sum(t[0] == c for t in texts) for c, _ in clusters}


def test_hot_cluster_is_cut_before_the_shuffle(spark):
    """A cluster with very many connections hands on its best 200 only: the limit is pushed below the exchange."""
    c = spark.range(5000).selectExpr("id div 100000 as cluster_id", "id as connection_id", "id % 90 as score", "array(id % 7, id) as node_ids")
    out = kept_connections(c, 60)
    assert out.count() == 200 and out.where("kept").count() >= 30
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_no_connections(spark):
    none = spark.createDataFrame([], CONNECTION)
    g = assembled(none, spark.createDataFrame([(7, "h")], "cluster_id long, headline string"), spark.createDataFrame([], "src long, dst long, edge_type string, weight double, confidence double, evidence string"), spark.createDataFrame([], "node_id long, ref_id long"))
    assert [tuple(r) for r in g.nodes.collect()] == [(7, 1, -7, "NEWS", 7, "h", None, 0)] and g.edges.count() == 0 and [tuple(r) for r in g.clusters.collect()] == [(7, 0, False)]


def test_with_evidence(spark):
    """Positions decide which edge belongs to which node; a walk with an unknown node or edge goes; a repeated id is looked up for each place."""
    nodes = spark.createDataFrame([(1, "ENTITY", "a"), (2, "CONCEPT", "b"), (3, "COMPANY", "c")], "node_id long, kind string, label string")
    edges = spark.createDataFrame([(10, "PERSON_OF", 0.9, 0.8, "DART", "u", None), (11, "AFFILIATION", 0.4, 0.5, "SEED", None, "7")], "edge_id long, edge_type string, confidence double, weight double, origin string, url string, doc_no string")
    walks = [(1, [1, 2, 3], [10, 11], 2, 0.4), (1, [1, 3, 2], [11, 10], 2, 0.4), (1, [1, 2], [12], 1, 0.5), (1, [1, 4], [10], 1, 0.5), (1, [1, 2], [10], 1, 0.5)]
    w = with_evidence(spark.createDataFrame(walks, "start long, nodes array<long>, edge_ids array<long>, hop int, weight double"), nodes, edges)
    got = {tuple(r["nodes"]): r for r in w.collect()}
    assert set(got) == {(1, 2, 3), (1, 3, 2), (1, 2)}
    r = got[1, 2, 3]
    assert [tuple(s) for s in r["path"]] == [(1, "ENTITY", "a", None, None), (2, "CONCEPT", "b", "PERSON_OF", "인물 소속"), (3, "COMPANY", "c", "AFFILIATION", "계열 관계")]
    assert [tuple(s) for s in r["evidence"]] == [("PERSON_OF", "DART", "a → b (인물 소속)", "u", None), ("AFFILIATION", "SEED", "b → c (계열 관계)", None, "7")]
    assert (r["edge_confidences"], r["edge_weights"], r["hop"], r["weight"]) == ([0.9, 0.4], [0.8, 0.5], 2, 0.4)
    assert [s["edge_type"] for s in got[1, 3, 2]["path"]] == [None, "AFFILIATION", "PERSON_OF"]
    assert with_evidence(w.limit(0).select("start", "nodes", "edge_ids", "hop", "weight"), nodes, edges.where(F.lit(False))).count() == 0
