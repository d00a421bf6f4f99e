"""Scoring and decision queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.functions import scoring as S
from braidwork.functions.similarity import edit_similarity
from braidwork.functions.text import chip_tone
from braidwork.functions.timeutil import instant
from braidwork.operators import decisions as D
from braidwork.plans.market import score_sql
from braidwork.plans.views import table, view, with_views


def scores_of(c: DataFrame) -> dict[str, Column]:
    return {"business_relevance": c["br"], "keyword_match": c["km"], "supply_chain": c["sc"], "market_reaction": c["mr"], "meme": c["meme"], "confidence": c["cf"]}


def with_score(c: DataFrame, reviewed: Column | None = None) -> DataFrame:
    return c.withColumn("score", S.connection_score(scores_of(c), F.col("kind"), F.col("hops"), F.col("gap"), F.col("ambiguous"), F.lit(False) if reviewed is None else reviewed))


def connection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M7, F3, F9, P10."""
    c = with_score(view(spark, sf_dir, "connection"))
    return c.select("id", "score", S.relevance_band(F.col("br")).alias("band"), S.is_meme(F.col("kind"), F.col("meme")).alias("is_meme"), S.review_state(F.col("br"), F.col("score"), F.col("meme"), F.col("hops"), F.col("ambiguous"), F.lit(False)).alias("state"), chip_tone(F.col("br"), S.is_meme(F.col("kind"), F.col("meme"))).alias("tone"))


def part_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3, M4, M5, M12, M17."""
    c = view(spark, sf_dir, "connection")
    types, weights = F.array(F.lit("PRODUCES"), F.when(F.col("kind") == "SUPPLY_CHAIN", F.lit("SUPPLY_CHAIN")).otherwise(F.lit("BELONGS_TO"))), F.array(F.lit(1.0), F.col("sc") / 100)
    return c.select(
        "id", S.meme(F.col("cf"), F.col("br"), F.col("mr"), F.col("kind")).alias("meme"), S.confidence(F.array(F.lit(0.9), F.col("km") / 100), F.col("cf")).alias("confidence"), S.supply_chain(types, weights).alias("supply"),
        S.evidence_gap(F.array(F.lit(0.9), F.col("km") / 100)).alias("gap"), (F.floor(S.importance(F.col("km")) * 1e6 + 0.5) / 1e6).alias("importance"),
    )


def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: type against name of each part."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("OFFICIAL", "SHORT", "BRAND", "FORMER")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    a, b = F.col("p_type"), F.col("p_name")
    return p.select("p_partkey", S.keyword_match(F.col("p_partkey") % 11 != 0, a == b, a, b, kind, F.col("p_partkey") % 3 == 0, similarity=edit_similarity(a, b)).alias("score"))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "connection")
    return D.guarded(c.select(
        "id", "company_id", F.col("kind").alias("connection_type"), F.col("br").alias("business_relevance"), F.col("cf").alias("confidence"), F.when(F.col("km") < 5, F.lit("매수 x")).otherwise(F.lit("about y")).alias("explanation"),
        F.when(F.col("km") % 10 == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))).alias("used_path_steps"), F.when(F.col("sc") < 95, F.array("company_id")).otherwise(F.array(F.lit(-1).cast("long"))).alias("candidate_ids"),
        F.array(F.lit(""), F.when(F.col("sc") % 13 == 0, F.lit("about")).otherwise(F.lit("zzz"))).alias("outside_terms"), F.lit("makes parts").alias("business_summary"), F.array(F.when(F.col("km") % 2 == 0, F.lit("parts")).otherwise(F.lit(""))).alias("path_labels"),
        (F.col("cf") < 10).alias("dangerous"), (F.col("cf") > 90).alias("negative_person"), F.array("company_id", F.when(F.col("meme") == 7, F.col("company_id")).otherwise(F.lit(-5).cast("long"))).alias("path_nodes"), "hops",
    ))


def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each judgement becomes."""
    return _guarded(spark, sf_dir).select("id", "business_relevance", "confidence", F.array_join("violations", ",").alias("violations"), "discarded", "forced_pending")


def guardrail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by rule."""
    return _guarded(spark, sf_dir).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def counter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check that refutes every ninth connection."""
    c = view(spark, sf_dir, "connection").select(F.col("id").alias("connection_id"), F.col("br").alias("business_relevance"))
    k = c.where("connection_id % 9 < 2").select("connection_id").distinct().select("connection_id", (F.col("connection_id") % 9 == 0).alias("refuted"), F.lit(20).cast("long").alias("adjusted"), F.lit("r").alias("reason"))
    return D.counter_checked(c, k).select("connection_id", "business_relevance", "counter_reason")


def feedback_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, D8."""
    f = view(spark, sf_dir, "feedback").where("kind is not null")
    n = f.groupBy("connection_id").agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("UNDERSTOOD", "FARFETCHED", "WRONG")])
    status = F.when(F.col("connection_id") % 7 == 0, "REJECTED").when(F.col("connection_id") % 7 == 1, "PENDING").otherwise("ACTIVE")
    return n.select("connection_id", "understood", "farfetched", "wrong", D.promoted(status, F.col("understood"), F.col("farfetched"), F.col("wrong")).alias("new_status"))


def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, business relevance, band, score and explanation of each connection after all its reviews, with the patches of corrections. Once
    approved or corrected it is scored anew as reviewed, and a reaction of 0 counts as unknown."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 10 + 1).alias("id"), F.struct("ts", "event_id").alias("order"), F.when(F.col("event_type") == "purchase", "APPROVE").when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "click", "CORRECT").alias("action"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") * 13 % 101).cast("long")).alias("business_relevance"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), "event_id")).alias("explanation"))
    o = D.review_outcome(e.where("action is not null"))
    j = view(spark, sf_dir, "connection").drop("status").join(o, "id")
    again = j.withColumn("mr", F.when(~F.col("rescored") | (F.col("mr") != 0), F.col("mr"))).withColumn("br", F.coalesce("new_business_relevance", "br"))
    return with_score(again, F.col("rescored")).select("id", "status", F.col("br").alias("business_relevance"), S.relevance_band(F.col("br")).alias("band"), "score", F.coalesce("new_explanation", F.lit("as built")).alias("explanation"))


def alert_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of users on clusters, at most 3 on a local day, none at night, none twice."""
    m = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select((F.col("user_id") % 50).alias("alert_id"), (F.col("event_id") % 97).alias("cluster_id"), F.col("ts").cast("timestamp").alias("matched_at"), F.lit(60).alias("min_score"), (F.col("user_id") % 2 == 0).alias("include_meme"), F.col("event_id").alias("connection_id"), F.when(F.col("event_id") % 3 == 0, "MEME").otherwise("THEME").alias("connection_type"), (F.col("event_id") * 7 % 101).alias("score"), (F.col("event_id") * 3 % 101).alias("meme"))
    past = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy((F.col("user_id") % 50).alias("alert_id"), (F.col("event_id") % 97).alias("cluster_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("delivered_at"))
    return D.dispatched(m, past)


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources, errors as failures."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("fetch_id"), (F.col("event_type") == "error").alias("failed"))
    return D.source_health(e, 2)


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9, D12."""
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 3).alias("ip"), instant(e, "ts").alias("at"), F.when(F.col("event_type") == "signup", "DISCOVERY_REQUEST").when(F.col("event_type") == "view", "SEARCH").when(F.col("event_type") == "click", "ANONYMOUS_READ").alias("tier"))
    return D.rate_limited(e).where("tier is not null").select("request_id", "nth", "allowed")


def llm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, Q20: cost and runs by stage, model, status and in all, in one pass over grouping sets."""
    r = view(spark, sf_dir, "run")
    g = r.groupingSets([["stage"], ["model"], ["status"], []], "stage", "model", "status").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("runs"))
    return g.select("stage", "model", "status", (F.floor(F.coalesce("cost", F.lit(0.0)) * 1e4 + 0.5) / 1e4).alias("cost"), "runs")


def daily_cost7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: daily cost of the last 7 days with runs up to the newest day."""
    r = view(spark, sf_dir, "run")
    end = r.agg(F.max("day").alias("end"))
    return r.join(F.broadcast(end), F.col("day") > F.date_sub("end", 7)).groupBy("day").agg(F.sum("cost_usd").alias("c")).select("day", (F.floor(F.col("c") * 1e4 + 0.5) / 1e4).alias("cost"))


def cost_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: runs of a day that start before its cap of 0.5 is spent; a day's runs are ranked within the day only."""
    w = Window.partitionBy("day", "stage").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return view(spark, sf_dir, "run").withColumn("spent", F.coalesce(F.sum("cost_usd").over(w), F.lit(0.0))).groupBy("day", "stage").agg(F.count_if(F.col("spent") < 0.5).alias("within_cap"), F.count("*").alias("runs"))


def rolling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same kind and user group in the hour up to each event."""
    w = Window.partitionBy("event_type", F.col("user_id") % 50).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("hour_count"))


QUERIES = {
    "connection_scores": connection_scores, "part_scores": part_scores, "keyword_match": keyword_match, "guardrails": guardrails, "guardrail_summary": guardrail_summary, "counter_check": counter_check, "feedback_promotion": feedback_promotion,
    "review_apply": review_apply, "alert_dispatch": alert_dispatch, "source_health": source_health, "rate_limit": rate_limit, "llm_costs": llm_costs, "daily_cost7": daily_cost7, "cost_cap": cost_cap, "rolling_hour": rolling_hour,
}

_MEME = "(kind = 'MEME' OR meme >= 70)"
_GUARD = with_views("connection") + """, g AS (SELECT *, sc >= 95 AS g1, sc % 13 = 0 AND km >= 5 AS g2, km < 5 AS g3, kind IN ('MEME', 'NAME_MATCH') AND br > 30 AS g4, km % 10 = 3 AS g5,
  (CASE WHEN kind IN ('MEME', 'NAME_MATCH') AND br > 30 THEN 30 ELSE br END) >= 60 AND km % 2 <> 0 AS g6, cf - CASE WHEN km % 10 = 3 THEN 30 ELSE 0 END AS c2, cf < 10 AND kind = 'MEME' AS g7, cf > 90 AND kind = 'MEME' AS g8, hops > 4 OR meme = 7 AS g9 FROM connection),
v AS (SELECT *, list_filter([CASE WHEN g1 THEN 'G1' END, CASE WHEN g2 THEN 'G2' END, CASE WHEN g3 THEN 'G3' END, CASE WHEN g4 THEN 'G4' END, CASE WHEN g5 THEN 'G5' END, CASE WHEN g6 THEN 'G6' END, CASE WHEN g7 THEN 'G7' END, CASE WHEN g8 THEN 'G8' END, CASE WHEN g9 THEN 'G9' END], lambda x: x IS NOT NULL) AS vs FROM g)"""

ORACLE_SQL = {
    "connection_scores": with_views("connection") + f""", s AS (SELECT *, CAST({score_sql("mr")} AS BIGINT) AS score, {_MEME} AS m FROM connection)
SELECT id, score, CASE WHEN br >= 70 THEN 'HIGH' WHEN br >= 40 THEN 'MEDIUM' WHEN br >= 15 THEN 'LOW' ELSE 'NONE' END AS band, m AS is_meme,
  CASE WHEN br >= 80 OR score >= 90 OR meme >= 90 OR hops >= 4 OR ambiguous THEN 'PENDING' ELSE 'ACTIVE' END AS state, CASE WHEN m THEN 'gray' WHEN br >= 60 THEN 'green' WHEN br >= 30 THEN 'blue' ELSE 'gray' END AS tone FROM s""",
    "part_scores": with_views("connection") + """, r AS (SELECT *, least(100, greatest(0, CASE WHEN mr IS NULL THEN (0.5e0 * cf + 0.3e0 * (100 - br)) / 0.8e0 ELSE 0.5e0 * cf + 0.3e0 * (100 - br) + 0.2e0 * mr END)) AS x FROM connection)
SELECT id, CAST(floor(CASE WHEN kind = 'MEME' THEN greatest(x, 50) ELSE x END + 0.5) AS BIGINT) AS meme, CAST(floor(least(0.9e0, km / 100) * cf / 100 * 100 + 0.5) AS BIGINT) AS confidence,
  CASE WHEN kind = 'SUPPLY_CHAIN' THEN CAST(floor(100 * (sc / 100) + 0.5) AS BIGINT) ELSE 0 END AS supply, km / 100 <= 0.3 AS gap, floor(least(km / 50, 1) * 1e6 + 0.5) / 1e6 AS importance FROM r""",
    "keyword_match": """WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.95e0 WHEN 2 THEN 0.9e0 ELSE 0.7e0 END AS times, CASE WHEN p_type = p_name THEN 1e0 ELSE 1 - levenshtein(p_type, p_name) / greatest(length(p_type), length(p_name)) END AS sim FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CAST(floor(least(100, greatest(0, CASE WHEN p_type = p_name THEN 100 * times ELSE floor(100 * sim + 0.5) * times + CASE WHEN left(p_type, 1) = left(p_name, 1) THEN 12 ELSE 0 END END
  - CASE WHEN p_partkey % 3 = 0 THEN 25 ELSE 0 END - CASE WHEN length(p_type) < 2 THEN 40 ELSE 0 END)) + 0.5) AS BIGINT) END AS score FROM p""",
    "guardrails": _GUARD + """ SELECT id, CASE WHEN g6 THEN 59 WHEN g4 THEN 30 ELSE br END AS business_relevance, greatest(0, c2) AS confidence, array_to_string(vs, ',') AS violations, g1 OR g7 OR g8 OR g9 AS discarded, g3 AS forced_pending FROM v""",
    "guardrail_summary": _GUARD + ", u AS (SELECT unnest(vs) AS rule FROM v) SELECT rule, count(*) AS n FROM u GROUP BY rule",
    "counter_check": with_views("connection") + " SELECT id AS connection_id, CASE WHEN br >= 60 AND id % 9 = 0 THEN 20 ELSE br END AS business_relevance, CASE WHEN br >= 60 AND id % 9 = 0 THEN 'r' END AS counter_reason FROM connection",
    "feedback_promotion": with_views("feedback") + """, n AS (SELECT connection_id, count(*) FILTER (kind = 'UNDERSTOOD') AS u, count(*) FILTER (kind = 'FARFETCHED') AS f, count(*) FILTER (kind = 'WRONG') AS w FROM feedback WHERE kind IS NOT NULL GROUP BY 1)
SELECT connection_id, u AS understood, f AS farfetched, w AS wrong, CASE WHEN connection_id % 7 = 0 THEN NULL WHEN w >= 3 THEN CASE WHEN connection_id % 7 = 1 THEN NULL ELSE 'PENDING' END WHEN u + f + w >= 20 AND f / (u + f + w) > 0.4 THEN 'DISPUTED' END AS new_status FROM n""",
    "review_apply": with_views("connection") + f""", e AS (SELECT user_id * 10 + 1 AS id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'REJECT' WHEN 'click' THEN 'CORRECT' END AS action FROM events),
l AS (SELECT id, arg_max(action, (ts, event_id)) AS action, bool_or(action <> 'REJECT') AS again, arg_max(event_id * 13 % 101, (ts, event_id)) FILTER (action = 'CORRECT' AND event_id % 2 = 0) AS nb, arg_max('note ' || event_id, (ts, event_id)) FILTER (action = 'CORRECT' AND event_id % 3 = 0) AS ne FROM e WHERE action IS NOT NULL GROUP BY id),
j AS (SELECT c.* REPLACE (CASE WHEN again THEN nullif(mr, 0) ELSE mr END AS mr, CAST(coalesce(nb, br) AS BIGINT) AS br), action, again, ne FROM connection c JOIN l USING (id))
SELECT id, CASE action WHEN 'APPROVE' THEN 'ACTIVE' WHEN 'REJECT' THEN 'REJECTED' ELSE 'CORRECTED' END AS status, br AS business_relevance, CASE WHEN br >= 70 THEN 'HIGH' WHEN br >= 40 THEN 'MEDIUM' WHEN br >= 15 THEN 'LOW' ELSE 'NONE' END AS band,
  {score_sql("mr", "again")} AS score, coalesce(ne, 'as built') AS explanation FROM j""",
    "alert_dispatch": """WITH m AS (SELECT user_id % 50 AS alert_id, event_id % 97 AS cluster_id, ts + INTERVAL 9 HOUR AS t, ts, user_id % 2 = 0 AS include_meme, event_id AS connection_id, event_id % 3 = 0 OR event_id * 3 % 101 >= 70 AS is_meme, event_id * 7 % 101 AS score FROM events WHERE event_type IN ('view', 'click')),
past AS (SELECT user_id % 50 AS alert_id, event_id % 97 AS cluster_id, CAST(min(ts) + INTERVAL 9 HOUR AS DATE) AS day FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
ok AS (SELECT *, row_number() OVER (PARTITION BY alert_id, cluster_id ORDER BY score DESC, connection_id) AS n FROM m WHERE score >= 60 AND (include_meme OR NOT is_meme) AND NOT (hour(t) >= 22 OR hour(t) < 7) AND (alert_id, cluster_id) NOT IN (SELECT (alert_id, cluster_id) FROM past)),
k AS (SELECT *, CAST(t AS DATE) AS day, row_number() OVER (PARTITION BY alert_id, CAST(t AS DATE) ORDER BY ts, cluster_id) AS k FROM ok WHERE n = 1), s AS (SELECT alert_id, day, count(*) AS sent FROM past GROUP BY 1, 2)
SELECT k.alert_id, k.cluster_id, k.connection_id FROM k LEFT JOIN s ON k.alert_id = s.alert_id AND k.day = s.day WHERE k.k + coalesce(sent, 0) <= 3""",
    "source_health": """WITH e AS (SELECT user_id % 200 AS source_id, (ts, event_id) AS k, event_type = 'error' AS failed FROM events), l AS (SELECT source_id, max(k) FILTER (NOT failed) AS ok FROM e GROUP BY 1)
SELECT e.source_id, count(*) FILTER (failed AND (ok IS NULL OR k > ok)) AS errors, count(*) FILTER (failed AND (ok IS NULL OR k > ok)) < 2 AS active FROM e JOIN l USING (source_id) GROUP BY 1""",
    "rate_limit": """WITH e AS (SELECT event_id, user_id % 3 AS ip, ts, CASE event_type WHEN 'signup' THEN 'DISCOVERY_REQUEST' WHEN 'view' THEN 'SEARCH' WHEN 'click' THEN 'ANONYMOUS_READ' END AS tier, CASE event_type WHEN 'signup' THEN 3600000 ELSE 60000 END AS w, CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 30 ELSE 120 END AS most FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY tier, ip, epoch_ms(ts) // w ORDER BY ts, event_id) AS nth FROM e WHERE tier IS NOT NULL) SELECT event_id AS request_id, nth, nth <= most AS allowed FROM n""",
    "llm_costs": with_views("run") + " SELECT stage, model, status, floor(coalesce(sum(cost_usd), 0) * 1e4 + 0.5) / 1e4 AS cost, count(*) AS runs FROM run GROUP BY GROUPING SETS ((stage), (model), (status), ())",
    "daily_cost7": with_views("run") + " SELECT day, floor(sum(cost_usd) * 1e4 + 0.5) / 1e4 AS cost FROM run WHERE day > (SELECT max(day) - 7 FROM run) GROUP BY day",
    "cost_cap": with_views("run") + """, w AS (SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY day, stage ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM run)
SELECT day, stage, count(*) FILTER (spent < 0.5) AS within_cap, count(*) AS runs FROM w GROUP BY day, stage""",
    "rolling_hour": "SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id % 50 ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour_count FROM events",
}
