"""Read queries of the service (Q1-Q23) over the domain views. Each is one lazy plan; per-key limits are windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import BUSINESS_KINDS, VISIBLE_STATES
from braidwork.functions.scoring import is_meme
from braidwork.functions.timeutil import within_days
from braidwork.plans.market import score_sql
from braidwork.plans.scores import with_score
from braidwork.plans.views import table, view, with_views


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with score; the number of the line tells apart rows that share an id."""
    return with_score(view(spark, sf_dir, "connection").withColumn("k", F.xxhash64("id", "company_id", "entity_id")))


def visible(c: DataFrame) -> DataFrame:
    return c.where(F.col("status").isin(*VISIBLE_STATES))


def top(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "_n") -> DataFrame:
    """The first n rows of each key."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
    return out.drop(rank) if rank == "_n" else out


def _order() -> list[Column]:
    return [F.desc("score"), F.col("id"), F.col("company_id"), F.col("entity_id")]


def on_latest_day(c: DataFrame) -> DataFrame:
    """Q1: rows of the newest trade date; one row is broadcast."""
    return c.join(F.broadcast(c.agg(F.max("trade_date").alias("trade_date"))), "trade_date", "left_semi")


def latest_trade_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "connection").agg(F.max("trade_date").alias("trade_date"))


def cluster_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 best visible connections of each cluster."""
    return top(visible(connections(spark, sf_dir)), ["cluster_id"], _order(), 4, "rank").select("cluster_id", "id", "company_id", "entity_id", "score", "rank")


def meme_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best meme connections of the newest day, one a company."""
    c = on_latest_day(visible(connections(spark, sf_dir))).where(is_meme(F.col("kind"), F.col("meme")))
    return meme_top(c)


def weekly_meme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the 7 days up to the newest."""
    c = visible(connections(spark, sf_dir))
    end = c.agg(F.max("trade_date").alias("end"))
    return meme_top(c.join(F.broadcast(end), within_days(F.col("trade_date"), F.col("end"), 7)).where(is_meme(F.col("kind"), F.col("meme"))))


def meme_top(c: DataFrame) -> DataFrame:
    order = [F.desc("meme"), F.desc("score"), F.col("id"), F.col("entity_id")]
    ten = top(c, ["company_id"], order, 1).orderBy(*order).limit(10)
    return ten.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "company_id", "id", "meme")  # 10 rows


def entity_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: companies of each entity: connections and best score."""
    return visible(connections(spark, sf_dir)).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"), F.max("score").alias("best"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: pending or disputed connections of 50 points or more, newest 50."""
    c = connections(spark, sf_dir).where(F.col("status").isin("PENDING", "DISPUTED") & (F.col("score") >= 50))
    return c.orderBy(F.desc("trade_date"), "id", "company_id", "entity_id").limit(50).select("id", "company_id", "entity_id", "score")


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q22, K1: the first bookmark of each (user, connection), newest 3 of a user."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 500).alias("connection_id"), "ts", "event_id")
    first = e.groupBy("user_id", "connection_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "connection_id", F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))
    return top(first, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3, "rank").select("user_id", "connection_id", "rank")


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-table bridge with an ordered list for each cluster."""
    c = view(spark, sf_dir, "connection").select("cluster_id", "company_id").distinct()
    j = c.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), "s_nationkey"), "company_id").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    return j.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("sources"))


QUERIES = {
    "latest_trade_date": latest_trade_date, "cluster_connections": cluster_connections, "meme_rank": meme_rank, "weekly_meme": weekly_meme, 
    "entity_hub": entity_hub, "review_queue": review_queue, "bookmarks": bookmarks, "customer_sources": customer_sources,
}

_BASE = with_views("connection", "company") + f", s AS (SELECT *, CAST({score_sql('mr')} AS BIGINT) AS score, kind = 'MEME' OR meme >= 70 AS is_meme FROM connection), v AS (SELECT * FROM s WHERE status IN ('ACTIVE', 'DISPUTED', 'CORRECTED'))"
_BY = "score DESC, id, company_id, entity_id"
_MEMES = ", o AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY meme DESC, score DESC, id, entity_id) AS n FROM d WHERE is_meme) SELECT CAST(row_number() OVER (ORDER BY meme DESC, score DESC, id, entity_id) AS INT) AS rank, company_id, id, meme FROM o WHERE n = 1 ORDER BY rank LIMIT 10"

ORACLE_SQL = {
    "latest_trade_date": "SELECT max(CAST(o_orderdate AS DATE)) AS trade_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "cluster_connections": _BASE + f", r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_BY}) AS rank FROM v) SELECT cluster_id, id, company_id, entity_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4",
    "meme_rank": _BASE + ", d AS (SELECT * FROM v WHERE trade_date = (SELECT max(trade_date) FROM v))" + _MEMES,
    "weekly_meme": _BASE + ", d AS (SELECT * FROM v WHERE trade_date >= (SELECT max(trade_date) - 6 FROM v))" + _MEMES,
    "entity_hub": _BASE + " SELECT entity_id, count(*) AS n, count(DISTINCT company_id) AS companies, max(score) AS best FROM v GROUP BY 1",
    "review_queue": _BASE + " SELECT id, company_id, entity_id, score FROM s WHERE status IN ('PENDING', 'DISPUTED') AND score >= 50 ORDER BY trade_date DESC, id, company_id, entity_id LIMIT 50",
    "bookmarks": """WITH f AS (SELECT user_id, event_id % 500 AS connection_id, min((ts, event_id)) AS m FROM events WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC) AS rank FROM f)
SELECT user_id, connection_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""",
    "customer_sources": with_views("connection") + " SELECT cluster_id, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS sources FROM connection JOIN supplier ON company_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
}
