"""Clusters carried on from batch to batch: as in one loop over the articles, on replay, after failures, with late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators.stories import OPEN, clustered, continued, step
from braidwork.streaming.stories import ClusterStream, deliver

DAY = dt.datetime(2026, 1, 5)
ARTICLE = "id long, tokens array<string>, published_at timestamp, tier int"


def random_rows(rng, n, span):
    return [(i, [] if i % 40 == 0 else rng.sample("abcdefghij", rng.randint(2, 5)), DAY + dt.timedelta(minutes=rng.randint(0, span)), rng.randint(1, 3)) for i in range(n)]


def loop(batches):
    clusters, of = [], {}
    for rows in batches:
        for i, tokens, at, tier in sorted(rows, key=lambda r: (r[2], r[0])):
            of[i] = step(clusters, {"id": i, "tokens": tokens, "at": at.timestamp(), "tier": tier}, 0.5, 24, 0.88)
    return {i: c["id"] for i, c in of.items()}, {c["id"]: (c["rep"], c["tier"]) for c in clusters}


@pytest.mark.parametrize(("seed", "span"), [(1, 2500), (3, 200)])
def test_batches_out_of_order(spark, seed, span):
    """Two batches with times all over the span: every batch takes the clusters as the ones before left them, late articles and ties included."""
    rows = random_rows(random.Random(seed), 120, span)
    batches, state, got = [rows[:60], rows[60:]], spark.createDataFrame([], OPEN), {}
    for b in batches:
        done, state = continued(spark.createDataFrame(b, ARTICLE), state)
        got |= {r["id"]: r["cluster_id"] for r in done.collect()}
    want, heads = loop(batches)
    assert got == want
    assert {r["cluster_id"]: (r["representative"], r["tier"]) for r in state.collect()} == heads


def test_stream_replayed_is_the_batch_result(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(random_rows(rng, 90, 4000), key=lambda r: (r[2], r[0]))
    for k in range(2):
        spark.createDataFrame(rows[45 * k : 45 * k + 45], ARTICLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    want = {r["id"]: r["cluster_id"] for r in clustered(spark.createDataFrame(rows, ARTICLE)).collect()}
    for run in ("a", "b"):  # the same input from the start, into other tables
        s = ClusterStream(str(tmp_path / run))
        s.start(stream, str(tmp_path / f"check-{run}")).awaitTermination()
        members = s.members(spark).collect()
        assert {r["id"]: r["cluster_id"] for r in members} == want and {r["batch"] for r in members} == {0, 1}
    assert s.clusters(spark).columns == ["cluster_id", "tokens", "tier", "representative", "rep_at", "seen", "opened"]


def test_batch_run_again_late_rows_and_closed_clusters(spark, tmp_path):
    """A batch that runs twice changes nothing and alerts once; rows over 48 hours late go; clusters leave the state 73 hours after they were seen."""
    hour = lambda h: DAY + dt.timedelta(hours=h)
    alerts = deliver(str(tmp_path / "sent"), lambda m: m.select("cluster_id", F.col("id").alias("article_id")), ["cluster_id"])
    s = ClusterStream(str(tmp_path / "s"), then=alerts)
    first = spark.createDataFrame([(1, ["a", "b"], hour(0), 1), (2, ["x", "y"], hour(1), 1), (2, ["x", "y"], hour(1), 1)], ARTICLE)
    second = spark.createDataFrame([(3, ["a", "b"], hour(20), 1), (4, ["p", "q"], hour(70), 2), (9, [], None, None)], ARTICLE)
    third = spark.createDataFrame([(5, ["p", "q"], hour(21), 2), (6, ["p", "q"], hour(47), 1), (7, ["a", "b"], hour(44), 1), (8, ["z"], hour(100), 1)], ARTICLE)
    s(first, 0)
    s(second, 1)
    s(second, 1)  # failed after its commit, say
    s(third, 2)
    s(third, 2)
    assert {(r["id"], r["cluster_id"], r["batch"]) for r in s.members(spark).collect()} == {(1, 1, 0), (2, 2, 0), (3, 1, 1), (4, 4, 1), (6, 4, 2), (7, 1, 2), (8, 8, 2)}
    state = {r["cluster_id"]: (r["representative"], r["tier"]) for r in s.clusters(spark).collect()}
    assert state == {1: (1, 1), 4: (6, 1), 8: (8, 1)}
    sent = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "sent")).collect()
    assert sorted((r["cluster_id"], r["article_id"], r["_batch"]) for r in sent) == [(1, 1, 0), (2, 2, 0), (4, 4, 1), (8, 8, 2)]
    s(third.limit(0), 3)
    assert {r["cluster_id"] for r in s.clusters(spark).collect()} == set(state)
    with pytest.raises(ValueError):
        ClusterStream("x", close_hours=60)
