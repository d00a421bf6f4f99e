"""Surrogate keys, removal along foreign keys, validation of answers, nearest vectors."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import schemas
from braidwork.operators.cleanup import Reference, cleaned, order
from braidwork.operators.matching import best_vector
from braidwork.sources.sinks import ensure_nodes


@pytest.mark.parametrize("bucket", [None, "0", "ref_id % 2"])
def test_keys_never_share_an_id(spark, bucket):
    """With any hash, one that puts all keys together included: ids are dense, old ones stay, a rerun adds none."""
    bucket = bucket and F.expr(bucket)
    known = spark.createDataFrame([(4, "A", 1, "old"), (9, "B", 1, "b")], "node_id long, kind string, ref_id long, label string")
    wanted = spark.createDataFrame([("A", i % 20, f"l{i}") for i in range(60)] + [(None, 1, "x"), ("A", None, "y")], "kind string, ref_id long, label string").repartition(3)
    once = ensure_nodes(known, wanted, bucket)
    got = {(r["kind"], r["ref_id"]): (r["node_id"], r["label"]) for r in once.collect()}
    assert len(got) == 21 and got["A", 1] == (4, "old") and got["B", 1] == (9, "b") and got["A", 3][1] == "l23"
    assert sorted(i for i, _ in got.values()) == [4, 9, *range(10, 29)]
    again = ensure_nodes(once, wanted, bucket)
    assert {(r["kind"], r["ref_id"]): (r["node_id"], r["label"]) for r in again.collect()} == got
    more = ensure_nodes(once, spark.createDataFrame([("C", 1, "c")], "kind string, ref_id long, label string"), bucket)
    assert more.where("kind = 'C'").first()["node_id"] == 29
    assert ensure_nodes(known.limit(0), wanted.limit(0), bucket).count() == 0


def test_removal_follows_references(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "source": df([(1, "real"), (2, "a Fixture")], "id long, domain string"),
        "article": df([(10, 1), (11, 2), (12, 1), (13, 2)], "id long, source long"),
        "cluster": df([(100,), (101,)], "id long"),
        "link": df([(100, 10), (100, 11), (101, 12)], "cluster long, article long"),
        "mention": df([(100, 7), (101, 7), (100, 8), (100, 9), (101, 6)], "cluster long, entity long"),
        "entity": df([(6, None), (7, None), (8, None), (9, None), (5, 9)], "id long, canonical long"),
        "note": df([(1, 100), (2, 101)], "id long, cluster long"),
    }
    keys = {t: ["id"] for t in tables} | {"link": ["cluster", "article"], "mention": ["cluster", "entity"]}
    references = [
        Reference("article", "source", "source", "id"), Reference("link", "article", "article", "id"), Reference("link", "cluster", "cluster", "id", "with_any_child"),
        Reference("mention", "cluster", "cluster", "id"), Reference("note", "cluster", "cluster", "id"), Reference("mention", "entity", "entity", "id", "unless_shared"),
    ]
    bad = tables["source"].where(F.ilike("domain", F.lit("%fixture%")))
    articles = tables["article"].join(bad.select(F.col("id").alias("source")), "source", "left_semi")
    links = tables["link"].join(articles.select(F.col("id").alias("article")), "article", "left_semi")
    stays, gone = cleaned(tables, keys, {"source": bad, "article": articles, "link": links}, references, [Reference("entity", "canonical", "entity", "id")])
    left = {t: sorted(tuple(r)[: len(keys[t])] for r in d.select(*keys[t]).collect()) for t, d in stays.items()}
    # 9 is in the bad cluster alone, but 5, which stays, names it; 7 is in another cluster; 13 has no cluster; 10 loses its cluster and stays
    assert left == {"source": [(1,)], "article": [(10,), (12,)], "cluster": [(101,)], "link": [(101, 12)], "mention": [(101, 6), (101, 7)], "entity": [(5,), (6,), (7,), (9,)], "note": [(2,)]}
    assert [r[0] for r in gone["entity"].collect()] == [8]
    stays, gone = cleaned(tables, keys, {}, references)
    assert all(stays[t].count() == d.count() and gone[t].count() == 0 for t, d in tables.items())
    line = order(list(tables), references)
    assert all(line.index(r.parent) < line.index(r.child) for r in references)
    with pytest.raises(ValueError, match="circle"):
        order(["a", "b"], [Reference("a", "x", "b", "x"), Reference("b", "y", "a", "y")])


def test_answers_are_checked_by_stage(spark):
    entity = {"surface": "s", "normalized": "n", "kind": "ORG", "importance": 0.5, "in_headline": False, "role": "SUBJECT"}
    judged = {"company_id": 1, "verdict": "ACCEPT", "connection_type": "MEME", "business_relevance": 10, "meme": 0, "confidence": 100, "explanation": "x" * 60}
    cases = [
        ("SUMMARY", {"sentences": ["a", "b", "c"], "more": 1}, []),
        ("SUMMARY", {"sentences": ["a", 1, None]}, ["$.sentences[1]: not a string", "$.sentences[2]: not a string"]),
        ("SUMMARY", {}, ["$.sentences: not an array"]), ("SUMMARY", [], ["$: not an object"]), ("SUMMARY", None, ["$: not an object"]),
        ("ENTITY", {"entities": []}, []), ("ENTITY", {"entities": [entity] * 21}, ["$.entities: too many elements"]),
        ("ENTITY", {"entities": [entity | {"aliases": ["a"], "parent": "p", "importance": 1}, entity | {"kind": "PLANET", "aliases": "a", "importance": -0.1}]}, ["$.entities[1].kind: not one of the values", "$.entities[1].importance: too small", "$.entities[1].aliases: not an array"]),
        ("MATCH", {"judgements": [judged, judged | {"caution": None, "used_path_steps": [0, 1]}]}, []),
        ("MATCH", {"judgements": [judged | {"company_id": 1.5, "meme": 101, "explanation": "x" * 59 + "😀", "caution": "y" * 81, "used_path_steps": [0.5]}]}, ["$.judgements[0].company_id: not a whole number", "$.judgements[0].meme: too large", "$.judgements[0].explanation: too long", "$.judgements[0].caution: too long", "$.judgements[0].used_path_steps[0]: not a whole number"]),
        ("COUNTER", {"refuted": True, "reason": "r" * 100, "adjusted_relevance": 5.0}, []), ("COUNTER", {"refuted": "true", "reason": "r" * 101, "adjusted_relevance": "5"}, ["$.refuted: not a boolean", "$.reason: too long", "$.adjusted_relevance: not a number"]),
        ("OTHER", {}, ["$: unknown stage OTHER"]), (None, {}, ["$: unknown stage null"]),
    ]
    rows = [(i, s, json.dumps(v)) for i, (s, v, _) in enumerate(cases)] + [(98, "SUMMARY", "{"), (99, "SUMMARY", None)]
    ok, invalid = schemas.split(spark.createDataFrame(rows, "id int, stage string, json string"))
    got = {r["id"]: r["errors"] for r in ok.union(invalid).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases)} | {98: ["$: not JSON"], 99: ["$: not JSON"]}
    assert {r["id"] for r in ok.collect()} == {i for i, e in got.items() if not e}


@pytest.mark.parametrize("block", [5, 4096])
def test_nearest_vectors(spark, block):
    """Queries beyond one block, ties, copies, zero, null and shorter vectors, against all pairs."""
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, [0.0] * 4), (103, None), (104, []), (105, [3.0, 1.0, 0.0, 0.0]), (106, [6.0, 2.0, 0.0, 0.0]), (107, [9.0, 3.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not np.any(a) or not np.any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12)

    got = {r["query_id"]: (r["vec_id"], round(r["cosine"], 9)) for r in best_vector(df.where("vec_id % 3 = 0 or vec_id >= 100"), df, -1.0, block).collect()}
    want = {}
    for q, v in rows:
        if q % 3 == 0 or q >= 100:
            c, k = max((cosine(v, w), -i) for i, w in rows if i != q)
            want[q] = (-k, round(c, 9))
    assert got == want
    assert best_vector(df.limit(0), df).count() == 0 and best_vector(df, df.limit(0)).count() == 0


def test_reviews_one_after_another(spark):
    """Random reviews in any order of rows, against applying them one by one."""
    from braidwork.operators.decisions import review_outcome

    rng = random.Random(4)
    rows = [(rng.randint(1, 8), rng.choice(["APPROVE", "REJECT", "CORRECT"]), k, rng.choice([None, rng.randint(0, 100)]), rng.choice([None, f"e{k}"])) for k in range(60)] + [(9, "REJECT", 1, 5, "x")]
    want = {}
    for i, action, _, br, text in sorted(rows, key=lambda r: r[2]):
        s = want.setdefault(i, {"status": None, "new_business_relevance": None, "new_explanation": None, "rescored": False})
        s["status"] = {"APPROVE": "ACTIVE", "REJECT": "REJECTED", "CORRECT": "CORRECTED"}[action]
        s["rescored"] |= action != "REJECT"
        if action == "CORRECT":
            s["new_business_relevance"] = s["new_business_relevance"] if br is None else br
            s["new_explanation"] = text or s["new_explanation"]
    rng.shuffle(rows)
    got = review_outcome(spark.createDataFrame(rows, "id long, action string, order int, business_relevance long, explanation string").repartition(3))
    assert {r["id"]: {k: r[k] for k in want[r["id"]]} for r in got.collect()} == want
