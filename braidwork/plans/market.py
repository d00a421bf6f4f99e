"""Market queries: reactions, ratios, sparklines, market hours and rescoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from braidwork.config import HOLIDAYS
from braidwork.functions.scoring import connection_score, half_up, market_reaction
from braidwork.functions.timeutil import ZONE, day_start, fixed_window, instant, is_pre_market, market_status, quiet_hours, trade_date
from braidwork.operators.matching import as_of, latest
from braidwork.plans.views import daily_market, table, view, with_views


def by_day() -> WindowSpec:
    return Window.partitionBy("company_id").orderBy("trade_date")


def with_ratio(days: DataFrame) -> DataFrame:
    """Volume against the mean of the 20 trading days before, to 2 digits; price change in percent."""
    base, before = F.avg("volume").over(by_day().rowsBetween(-20, -1)), F.lag("price").over(by_day())
    return days.withColumn("volume_ratio", F.when(base > 0, half_up(F.col("volume") / base, 2))).withColumn("change_pct", F.when(before > 0, half_up((F.col("price") / before - 1) * 100, 2)))


def market_reaction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 with M2: volume ratio, price change, and the reaction score of each company-day."""
    days = with_ratio(daily_market(spark, sf_dir)).drop("price")
    return days.withColumn("market_reaction", market_reaction(F.col("volume_ratio"), F.col("change_pct")))


def volume_ratio20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 on each company's newest day, from its newest 200 days."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("trade_date"))
    cut = daily_market(spark, sf_dir).withColumn("n", F.row_number().over(newest)).where("n <= 200")
    return with_ratio(cut).where("n = 1").select("company_id", "trade_date", "volume_ratio")


def sparkline5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 daily prices, oldest first."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("trade_date"))
    top = daily_market(spark, sf_dir).withColumn("n", F.row_number().over(newest)).where("n <= 5")
    line = F.array_sort(F.collect_list(F.struct("trade_date", "price")))
    return top.groupBy("company_id").agg(line.alias("s")).select("company_id", F.array_join(F.transform("s", lambda x: F.floor(x["price"]).cast("string")), ",").alias("prices"))


def last_value_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value above 100 of each user and day."""
    e = table(spark, sf_dir, "events").where("value > 100").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def market_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and UTC day and their starts, status, quiet hours, before the market, and 5-minute window of each event, moved by
    731 days into a year whose holidays are known."""
    e = table(spark, sf_dir, "events")
    ts = F.timestamp_micros(F.unix_micros(instant(e, "ts")) + 731 * 86_400_000_000)
    starts = [F.unix_seconds(day_start(ts, zone)).alias(name) for zone, name in ((ZONE, "local_start"), (None, "utc_start"))]
    return e.select(trade_date(ts, None).alias("utc_day"), *starts, is_pre_market(ts).alias("pre_market"), "event_id", trade_date(ts).alias("local_day"), market_status(ts).alias("status"), quiet_hours(ts).alias("quiet"), fixed_window(ts, 300).alias("bucket"))


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each connection with its company's newest earlier market day."""
    c = view(spark, sf_dir, "connection").select("id", "company_id", "trade_date")
    return as_of(c, daily_market(spark, sf_dir).withColumnRenamed("trade_date", "day").select("company_id", "day", "price"), "company_id", "trade_date", "day").select("id", "day", "price")


def rescore_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible connections of companies with a newest snapshot: reaction and score anew, as not reviewed; changed rows only (K4)."""
    snap = latest(with_ratio(daily_market(spark, sf_dir)).where("volume_ratio is not null and change_pct is not null"), ["company_id"], "trade_date")
    j = view(spark, sf_dir, "connection").where(F.col("status").isin("ACTIVE", "DISPUTED")).join(snap.select("company_id", "volume_ratio", "change_pct"), "company_id")
    j = j.withColumn("new_mr", market_reaction(F.col("volume_ratio"), F.col("change_pct"))).where(~F.col("new_mr").eqNullSafe(F.col("mr")))
    s = {"business_relevance": F.col("br"), "keyword_match": F.col("km"), "supply_chain": F.col("sc"), "market_reaction": F.col("new_mr"), "meme": F.col("meme"), "confidence": F.col("cf")}
    return j.select("id", "new_mr", connection_score(s, F.col("kind"), F.col("hops"), F.col("gap"), F.col("ambiguous"), F.lit(False)).alias("score"))


QUERIES = {
    "market_reaction": market_reaction_query, "volume_ratio20": volume_ratio20, "sparkline5": sparkline5, "last_value_per_day": last_value_per_day, "market_hours": market_hours,
    "snapshot_as_of": snapshot_as_of, "rescore_market": rescore_market,
}

RATIO = """w AS (
  SELECT *, avg(volume) OVER (PARTITION BY company_id ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base,
    lag(price) OVER (PARTITION BY company_id ORDER BY trade_date) AS before FROM {of}),
ratio AS (SELECT *, CASE WHEN base > 0 THEN floor(volume / base * 100 + 0.5) / 100 END AS volume_ratio,
  CASE WHEN before > 0 THEN floor((price / before - 1) * 100 * 100 + 0.5) / 100 END AS change_pct FROM w)"""

REACTION = """CASE WHEN volume_ratio IS NOT NULL AND change_pct IS NOT NULL THEN CAST(floor(
    0.6 * least(100, greatest(0, 25 * log2(greatest(volume_ratio, 0.25)) + 50))
  + 0.4 * least(100, greatest(0, 2.5 * abs(change_pct) + 50)) + 0.5) AS BIGINT) END"""


def score_sql(mr: str, reviewed: str = "FALSE") -> str:
    """M6 in SQL over the columns of the view `connection`."""
    def mean(weights: list[tuple[str, str]]) -> str:
        top = " + ".join(f"coalesce({w} * {c}, 0e0)" for c, w in weights)
        low = " + ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {w} END" for c, w in weights)
        return f"(0e0 + {top}) / (0e0 + {low})"

    nominal = mean([("km", "0.45e0"), (mr, "0.30e0"), ("meme", "0.15e0"), ("br", "0.05e0"), ("sc", "0.05e0")])
    business = mean([("br", "0.40e0"), ("km", "0.20e0"), ("sc", "0.15e0"), (mr, "0.15e0"), ("meme", "0.10e0")])
    base = f"CASE WHEN kind IN ('NAME_MATCH', 'KEYWORD', 'MEME') THEN {nominal} ELSE {business} END"
    raw = f"CAST(floor(least(100, greatest(0, {base} * (0.6e0 + 0.4e0 * (cf / 100e0)) * greatest(0.7e0, 1 - 0.08e0 * (hops - 1)))) + 0.5) AS BIGINT)"
    return f"least({raw}, CASE WHEN gap THEN 60 ELSE 100 END, CASE WHEN ambiguous THEN 80 ELSE 100 END, CASE WHEN {reviewed} THEN 100 ELSE 95 END)"


ORACLE_SQL = {
    "market_reaction": with_views("daily") + "," + RATIO.format(of="daily") + f" SELECT company_id, trade_date, volume, volume_ratio, change_pct, {REACTION} AS market_reaction FROM ratio",
    "volume_ratio20": with_views("daily") + ", c AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS n FROM daily), cut AS (SELECT * FROM c WHERE n <= 200)," + RATIO.format(of="cut") + " SELECT company_id, trade_date, volume_ratio FROM ratio WHERE n = 1",
    "sparkline5": with_views("daily") + """, c AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS n FROM daily)
SELECT company_id, string_agg(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), ',' ORDER BY trade_date) AS prices FROM c WHERE n <= 5 GROUP BY company_id""",
    "last_value_per_day": "SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE value > 100 GROUP BY 1, 2",
    "market_hours": f"""WITH u AS (SELECT event_id, ts + INTERVAL 731 DAY AS ts FROM events), l AS (SELECT event_id, ts, ts + INTERVAL 9 HOUR AS t FROM u), m AS (SELECT *, hour(t) * 60 + minute(t) AS m FROM l)
SELECT event_id, CAST(t AS DATE) AS local_day, CAST(ts AS DATE) AS utc_day, CAST(epoch(date_trunc('day', t) - INTERVAL 9 HOUR) AS BIGINT) AS local_start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS utc_start, hour(t) < 8 AS pre_market,
  CASE WHEN dayofweek(t) IN (0, 6) OR strftime(t, '%Y-%m-%d') IN {HOLIDAYS} THEN 'CLOSED' WHEN m >= 480 AND m < 540 THEN 'PRE_MARKET' WHEN m >= 540 AND m < 930 THEN 'OPEN'
  WHEN m >= 930 AND m < 960 THEN 'AFTER_MARKET' ELSE 'CLOSED' END AS status, hour(t) >= 22 OR hour(t) < 7 AS quiet, CAST(epoch_ms(ts) // 300000 AS BIGINT) AS bucket FROM m""",
    "snapshot_as_of": with_views("connection", "daily") + " SELECT c.id, d.trade_date AS day, d.price FROM connection c ASOF LEFT JOIN daily d ON c.company_id = d.company_id AND c.trade_date >= d.trade_date",
    "rescore_market": with_views("connection", "daily") + "," + RATIO.format(of="daily") + f""", s AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS n FROM ratio WHERE volume_ratio IS NOT NULL AND change_pct IS NOT NULL),
j AS (SELECT c.*, {REACTION} AS new_mr FROM connection c JOIN s ON c.company_id = s.company_id AND s.n = 1 WHERE status IN ('ACTIVE', 'DISPUTED'))
SELECT id, new_mr, {score_sql("new_mr")} AS score FROM j WHERE new_mr IS DISTINCT FROM mr""",
}
