"""Domain-shaped views over the test tables.

A view is one SQL text for both engines: Spark gets the tables as frames, the oracle as names. Only what is tested on
top of the views differs between the two.

An `article` is a document, all of them: its headline is what fits of its first line into the 60 characters of a headline, so
queries on titles, and on what follows from titles, read that line only, those on texts the whole text. A null text is empty; the
tier follows from the number at the end of the source's name, and is 3 without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.config import CONNECTION_KINDS

_KIND = "CASE l.l_partkey % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(CONNECTION_KINDS)) + " END"


VIEWS = {
    "daily": "SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS trade_date, sum(l_quantity) AS volume, max(l_extendedprice) AS price FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)",
    "company": "SELECT s_suppkey AS company_id, lpad(CAST(s_suppkey AS STRING), 6, '0') AS ticker, s_name AS company_name, n_name AS sector, CASE WHEN n_regionkey = 0 THEN 'KONEX' WHEN n_regionkey % 2 = 1 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "article": "SELECT doc_id AS id, trim(substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60)) AS title, coalesce(text, '') AS text, source, CAST(doc_id AS BIGINT) AS minute, CAST(doc_id + doc_id % 90 AS BIGINT) AS fetched_minute, CAST(coalesce(1 + TRY_CAST(substr(source, 4) AS INT) % 3, 3) AS INT) AS tier FROM {documents}",
    "connection": f"""SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS id, o.o_custkey AS cluster_id, l.l_suppkey AS company_id, CAST(l.l_partkey AS BIGINT) AS entity_id,
  CAST(o.o_orderdate AS DATE) AS trade_date, {_KIND} AS kind,
  CAST((l.l_partkey * 7 + l.l_suppkey * 3) % 101 AS BIGINT) AS br, CAST((l.l_orderkey * 5 + l.l_linenumber) % 101 AS BIGINT) AS km, CAST((l.l_suppkey * 11) % 101 AS BIGINT) AS sc,
  CASE WHEN l.l_partkey % 5 = 0 THEN NULL ELSE CAST((l.l_partkey * 13) % 101 AS BIGINT) END AS mr, CAST((l.l_orderkey * 3 + l.l_partkey) % 101 AS BIGINT) AS meme, CAST((l.l_partkey * 17 + l.l_orderkey) % 101 AS BIGINT) AS cf,
  CAST(1 + l.l_linenumber % 5 AS BIGINT) AS hops, l.l_orderkey % 7 = 0 AS gap, l.l_partkey % 9 = 0 AS ambiguous,
  CASE o.o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN CASE WHEN l.l_linenumber % 2 = 0 THEN 'DISPUTED' ELSE 'CORRECTED' END ELSE 'PENDING' END AS status
  FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""",
    "alias": """SELECT p_partkey * 3 + k AS alias_id, p_partkey AS company_id, a AS alias, lower(regexp_replace(a, '[ #]', '', 'g')) AS alias_norm, t AS alias_type FROM (
  SELECT p_partkey, 0 AS k, p_name AS a, 'OFFICIAL' AS t FROM {part} UNION ALL SELECT p_partkey, 1, p_brand, 'BRAND' FROM {part} UNION ALL SELECT p_partkey, 2, p_type, 'SHORT' FROM {part}) x""",
    "edge": """SELECT * FROM (
  SELECT 10000000 + n_nationkey AS edge_id, 2000 + n_nationkey AS src, 1000 + n_regionkey AS dst, 'BELONGS_TO' AS edge_type, 0.3e0 + (n_nationkey % 7) / 1e1 AS weight FROM {nation}
  UNION ALL SELECT 20000000 + n_nationkey, 1000 + n_regionkey, 2000 + n_nationkey, 'RELATED_CONCEPT', 0.4e0 + (n_nationkey % 5) / 1e1 FROM {nation}
  UNION ALL SELECT CAST(30000000 + s_suppkey AS BIGINT), 2000 + s_nationkey, CAST(100000 + s_suppkey AS BIGINT), CASE WHEN s_suppkey % 2 = 0 THEN 'SUPPLY_CHAIN' ELSE 'PERSON_OF' END, 0.3e0 + (s_suppkey % 7) / 1e1 FROM {supplier}
  UNION ALL SELECT CAST(40000000 + s_suppkey AS BIGINT), CAST(100000 + s_suppkey AS BIGINT), CAST(100000 + (3 * s_suppkey + 1) % 97 AS BIGINT), 'AFFILIATION', 0.5e0 + (s_suppkey % 5) / 1e1 FROM {supplier}) x""",
    "cluster": "SELECT c.c_custkey AS cluster_id, c.c_mktsegment || ' ' || c.c_name AS headline, CAST(max(o.o_orderdate) AS DATE) AS trade_date, CAST(min(o.o_orderdate) AS DATE) AS first_seen, count(*) AS articles, CAST(1 + c.c_custkey % 3 AS BIGINT) AS tier, CAST(c.c_custkey % 4 AS BIGINT) AS recent FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_mktsegment, c.c_name",
    "mention": "SELECT o.o_custkey AS cluster_id, CAST(l.l_partkey AS BIGINT) AS entity_id, least(max(l.l_quantity) / 5e1, 1e0) AS importance FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_partkey",
    "run": "SELECT event_id AS run_id, event_type AS stage, CAST(user_id % 3 AS STRING) AS model, value / 1000 AS cost_usd, CAST(ts AS DATE) AS day, ts, CASE event_id % 5 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'ERROR' ELSE 'OK' END AS status FROM {events}",
    "feedback": "SELECT user_id AS connection_id, CASE event_type WHEN 'view' THEN 'UNDERSTOOD' WHEN 'click' THEN 'FARFETCHED' WHEN 'error' THEN 'WRONG' END AS kind FROM {events}",
}

_USES = {"daily": ("lineitem",), "company": ("supplier", "nation"), "article": ("documents",), "connection": ("lineitem", "orders"), "alias": ("part",), "cluster": ("customer", "orders"), "mention": ("lineitem", "orders"), "edge": ("nation", "supplier"), "run": ("events",), "feedback": ("events",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a frame."""
    sql = VIEWS[name].replace(", 'g')", ")")  # Spark replaces all matches anyway
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _USES[name]})


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the views for the oracle; further common table expressions may follow a comma."""
    ctes = (f"{n} AS ({VIEWS[n].format(**{t: t for t in _USES[n]})})" for n in names)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)


def daily_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_id, trade_date, volume, price): one row for each company and day with trades."""
    return view(spark, sf_dir, "daily")
