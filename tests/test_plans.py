"""Queries against their DuckDB SQL on the smallest tables."""

import datetime as dt
import decimal
import os
from collections import Counter

import duckdb
import pytest

from braidwork.plans.catalog import ORACLE_SQL, QUERIES

SLOW = {"alias_recall", "alias_edges", "near_dup_pairs", "title_jaccard", "guardrail_summary", "verbatim_quotes", "graph_walk_top", "recall_merge", "judged_walks", "dedup_survivors", "cluster_assign", "news_clusters", "recall_all", "build_connections"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    got = Counter(tuple(plain(v) for v in r) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert got == want


def test_greedy_queries_cover_all(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    out = QUERIES["dedup_survivors"](spark, small).collect()
    assert len(out) == docs and all((r["duplicate_of"] is None) == r["kept"] for r in out)
    kept = {r["id"] for r in out if r["kept"]}
    assert all(r["duplicate_of"] in kept for r in out if not r["kept"])


@pytest.mark.parametrize("name", ["market_hours", "rate_limit"])
@pytest.mark.parametrize("zone", ["UTC", "Europe/London"])
def test_times_follow_the_sql_in_any_session(name, zone, spark, small, tmp_path):
    """Events of a year, of 1962, 1987 and around 1970, in a session with summer time and in one without."""
    c = duckdb.connect()
    moved = [*(f"ts + INTERVAL {30 * k} DAY" for k in range(12)), "ts - INTERVAL 37 YEAR + INTERVAL 180 DAY", "ts - INTERVAL 62 YEAR", "TIMESTAMP '1970-01-01' + (event_id % 90 - 45) * INTERVAL 1 SECOND"]
    parts = " UNION ALL ".join(f"SELECT event_id + {k} * 1000000 AS event_id, {m} AS ts, user_id, event_type, value, props FROM '{small}/events.parquet'" for k, m in enumerate(moved))
    c.execute(f"COPY ({parts}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = QUERIES[name](spark, str(tmp_path))
        got = Counter(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = Counter(c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert got == want
