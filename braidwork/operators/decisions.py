"""Guardrails and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import FEEDBACK, RATE_LIMITS, REFERENCE_JUDGE, Feedback
from braidwork.functions.text import has_forbidden_words, normalize_name
from braidwork.functions.timeutil import fixed_window, quiet_hours, trade_date

REPLACED_EXPLANATION = "설명을 표시할 수 없습니다 — 근거 확인이 필요합니다."


def guarded(j: DataFrame) -> DataFrame:
    """The nine rules in order, each on what the earlier ones left. Adds violations (array), discarded and forced_pending.

    j: company_id, connection_type, business_relevance, confidence, explanation, used_path_steps, and the context:
    candidate_ids, outside_terms, business_summary, path_labels, dangerous, negative_person, path_nodes, hops.
    """
    t, br = F.col("connection_type"), F.col("business_relevance")
    hit = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    d = j.withColumn("_g1", hit("G1", ~F.array_contains("candidate_ids", F.col("company_id"))))
    d = d.withColumn("_g2", hit("G2", F.exists("outside_terms", lambda x: (x != "") & F.contains(F.col("explanation"), x))))
    d = d.withColumn("explanation", F.when(F.size("_g2") > 0, REPLACED_EXPLANATION).otherwise(F.col("explanation")))
    d = d.withColumn("_g3", hit("G3", has_forbidden_words(F.col("explanation"))))
    d = d.withColumn("_g4", hit("G4", t.isin("MEME", "NAME_MATCH") & (br > 30)))
    d = d.withColumn("business_relevance", F.when(F.size("_g4") > 0, F.lit(30)).otherwise(br).cast("long"))
    d = d.withColumn("_g5", hit("G5", F.size("used_path_steps") <= 0))
    d = d.withColumn("confidence", F.when(F.size("_g5") > 0, F.greatest(F.lit(0), F.col("confidence") - 30)).otherwise(F.col("confidence")).cast("long"))
    grounded = F.exists("path_labels", lambda x: (x != "") & F.contains(F.coalesce("business_summary", F.lit("")), x))
    d = d.withColumn("_g6", hit("G6", (br >= 60) & ~F.coalesce(grounded, F.lit(False))))
    d = d.withColumn("business_relevance", F.when(F.size("_g6") > 0, F.lit(59)).otherwise(br).cast("long"))
    d = d.withColumn("_g7", hit("G7", F.col("dangerous") & (t == "MEME"))).withColumn("_g8", hit("G8", F.col("negative_person") & (t == "MEME")))
    d = d.withColumn("_g9", hit("G9", (F.col("hops") > 4) | (F.size(F.array_distinct("path_nodes")) != F.size("path_nodes"))))
    d = d.withColumn("violations", F.concat(*[f"_g{i}" for i in range(1, 10)])).drop(*[f"_g{i}" for i in range(1, 10)])
    return d.withColumn("discarded", F.arrays_overlap("violations", F.array(*map(F.lit, ("G1", "G7", "G8", "G9"))))).withColumn("forced_pending", F.array_contains("violations", "G3"))


def reference_judgements(candidates: DataFrame) -> DataFrame:
    """The fixed judgement of each candidate's recall_rule; confidence 90, always accepted."""

    def pick(i: int, cast: str) -> Column:
        out = F.lit(REFERENCE_JUDGE[None][i]) if i < 3 else F.array(*map(F.lit, REFERENCE_JUDGE[None][3]))
        for rule, v in REFERENCE_JUDGE.items():
            if rule:
                out = F.when(F.col("recall_rule") == rule, F.lit(v[i]) if i < 3 else F.array(*map(F.lit, v[3]))).otherwise(out)
        return out.cast(cast)

    return candidates.select("*", pick(0, "string").alias("connection_type"), pick(1, "long").alias("business_relevance"), pick(2, "long").alias("meme_llm"), pick(3, "array<int>").alias("used_path_steps"), F.lit(90).cast("long").alias("confidence_llm"), F.lit("ACCEPT").alias("verdict"))


def counter_checked(connections: DataFrame, checks: DataFrame, floor: int = 60) -> DataFrame:
    """Relevance of `floor` or more yields to the adjusted one of a refuting check (connection_id, refuted, adjusted, reason)."""
    c = checks.where("refuted").select("connection_id", "adjusted", "reason")
    j = connections.join(c, "connection_id", "left")
    on = (F.col("business_relevance") >= floor) & F.col("adjusted").isNotNull()
    return j.withColumns({"business_relevance": F.when(on, F.col("adjusted")).otherwise(F.col("business_relevance")), "counter_reason": F.when(on, F.col("reason"))}).drop("adjusted", "reason")


def promoted(status: Column, understood: Column, farfetched: Column, wrong: Column, cfg: Feedback = FEEDBACK) -> Column:
    """The new status from feedback counts; null if it stays."""
    total = understood + farfetched + wrong
    new = F.when(status.isin("REJECTED", "CORRECTED"), status).when(wrong >= cfg.wrong_from, "PENDING").when((total >= cfg.least_votes) & (farfetched / total > cfg.farfetched_above), "DISPUTED")
    return F.when(new != status, new)


def reviewed_status(action: Column) -> Column:
    """D9."""
    return F.when(action == "APPROVE", "ACTIVE").when(action == "REJECT", "REJECTED").when(action == "CORRECT", "CORRECTED")


def review_outcome(actions: DataFrame) -> DataFrame:
    """What all reviews (id, action, order, business_relevance, explanation) make of each connection, one after another: the last
    action's status, the last patches that corrections bring, and `rescored` if any of them approves or corrects. Patches of other
    actions don't count. One aggregate, so reviews of one connection are never gathered."""
    fixes = F.col("action") == "CORRECT"
    patch = lambda c: F.max(F.when(fixes & F.col(c).isNotNull(), F.struct("order", c)))[c].alias(f"new_{c}")
    out = actions.groupBy("id").agg(F.max_by("action", "order").alias("action"), patch("business_relevance"), patch("explanation"), F.bool_or(F.col("action") != "REJECT").alias("rescored"))
    return out.select("id", reviewed_status(F.col("action")).alias("status"), "new_business_relevance", "new_explanation", "rescored")


def dispatched(matches: DataFrame, past: DataFrame, daily_cap: int = 3) -> DataFrame:
    """(alert_id, cluster_id, connection_id): deliveries from matches (alert_id, cluster_id, matched_at, min_score, include_meme,
    connection_id, connection_type, score, meme) and past deliveries (alert_id, cluster_id, delivered_at).

    Of a match the best connection that passes is taken; none in quiet hours; no (alert, cluster) twice; at most
    daily_cap of an alert on a local day, past ones included, in the order of matched_at and cluster.
    """
    ok = matches.where((F.col("score") >= F.col("min_score")) & (F.col("include_meme") | ~((F.col("connection_type") == "MEME") | (F.col("meme") >= 70))) & ~quiet_hours(F.col("matched_at")))
    ok = ok.join(past.select("alert_id", "cluster_id"), ["alert_id", "cluster_id"], "left_anti")
    best = Window.partitionBy("alert_id", "cluster_id").orderBy(F.desc("score"), "connection_id")
    one = ok.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("day", trade_date(F.col("matched_at")))
    sent = past.groupBy("alert_id", trade_date(F.col("delivered_at")).alias("day")).agg(F.count("*").alias("sent"))
    turn = Window.partitionBy("alert_id", "day").orderBy("matched_at", "cluster_id")
    return one.withColumn("_k", F.row_number().over(turn)).join(sent, ["alert_id", "day"], "left").where(F.col("_k") + F.coalesce("sent", F.lit(0)) <= daily_cap).select("alert_id", "cluster_id", "connection_id")


def source_health(fetches: DataFrame, limit: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(source_id, errors, active): errors since the last success of fetches (source_id, at, fetch_id, failed); `limit` of them
    switch a source off, and so does a robots file that doesn't allow it (allowed: source_id, allowed)."""
    last = fetches.groupBy("source_id").agg(F.max(F.when(~F.col("failed"), F.struct("at", "fetch_id"))).alias("ok"))
    errors = F.count(F.when(F.col("failed") & (F.col("ok").isNull() | (F.struct("at", "fetch_id") > F.col("ok"))), 1))
    out = fetches.join(last, "source_id").groupBy("source_id").agg(errors.alias("errors")).withColumn("active", F.col("errors") < limit)
    if allowed is None:
        return out
    banned = allowed.where(~F.col("allowed")).select("source_id", F.lit(True).alias("banned")).distinct()
    return out.join(banned, "source_id", "left").select("source_id", "errors", (F.col("active") & F.col("banned").isNull()).alias("active"))


def rate_limited(requests: DataFrame) -> DataFrame:
    """Requests (request_id, ip, at, tier) with `allowed`: the first so many of an address in each fixed window; unknown tiers always."""
    seconds, most = F.lit(None).cast("long"), F.lit(None).cast("long")
    for tier, (s, m) in RATE_LIMITS.items():
        seconds, most = F.when(F.col("tier") == tier, s).otherwise(seconds), F.when(F.col("tier") == tier, m).otherwise(most)
    r = requests.withColumn("bucket", fixed_window(F.col("at"), seconds))
    w = Window.partitionBy("tier", "ip", "bucket").orderBy("at", "request_id")
    return r.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("allowed", F.when(most.isNull(), F.lit(True)).otherwise(F.col("nth") <= most))


def request_tier(path: Column, method: Column) -> Column:
    """The tier of a request; null without one."""
    api, search = path.startswith("/api/v1/"), (path == "/api/v1/search") | path.startswith("/api/v1/search/")
    return F.when(~api, F.lit(None)).when((method == "POST") & (path == "/api/v1/discovery/requests"), "DISCOVERY_REQUEST").when(method != "GET", F.lit(None)).when(search, "SEARCH").otherwise("ANONYMOUS_READ")


def golden_outcomes(cases: DataFrame, observed: DataFrame, real_judge: bool = False) -> DataFrame:
    """(id, outcome, missing, violated): cases (id, must_include, must_exclude, expect_type, br_range, score_range, needs_llm)
    against observed (id, ticker, type, business_relevance, score)."""
    rows = observed.groupBy("id").agg(F.collect_list(F.struct("ticker", "type", F.col("business_relevance").alias("br"), "score")).alias("o"))
    d = cases.join(rows, "id", "left").withColumn("o", F.coalesce("o", F.expr("cast(array() as array<struct<ticker:string,type:string,br:bigint,score:bigint>>)")))
    tickers = F.transform("o", lambda x: x["ticker"])
    mine = F.filter("o", lambda x: F.array_contains("must_include", x["ticker"]))
    outside = lambda c, lim: F.coalesce(F.exists(mine, lambda x: (x[c] < F.get(lim, 0)) | (x[c] > F.get(lim, 1))), F.lit(False))
    d = d.withColumn("missing", F.array_except("must_include", tickers)).withColumn("violated", F.array_intersect("must_exclude", tickers))
    soft = F.coalesce("needs_llm", F.lit(False)) & F.lit(not real_judge)
    wrong_type = F.coalesce(F.exists(mine, lambda x: x["type"] != F.col("expect_type")), F.lit(False))
    hard = (F.size("missing") > 0) | ((F.size("violated") > 0) & ~soft) | wrong_type | outside("br", F.col("br_range")) | outside("score", F.col("score_range"))
    return d.select("id", F.when(hard, "FAIL").when((F.size("violated") > 0) & soft, "NEEDS_LLM_REVIEW").otherwise("PASS").alias("outcome"), "missing", "violated")


def pass_rate(outcomes: DataFrame) -> DataFrame:
    """Passed over scored cases; 1 without any."""
    scored = F.count_if(F.col("outcome") != "NEEDS_LLM_REVIEW")
    return outcomes.agg(F.when(scored == 0, F.lit(1.0)).otherwise(F.count_if(F.col("outcome") == "PASS") / scored).alias("pass_rate"))


def keyword_requests(requests: DataFrame, request_id: str, at: str, most: int = 5) -> DataFrame:
    """Q23: requests (user_id, keyword) in their order with `result`: OK, DUPLICATE if the user has the normalised keyword, or
    PLAN_LIMIT once the user has `most`. What a user has is what they asked for first, up to the limit."""
    asked = requests.withColumn("keyword_norm", normalize_name(F.col("keyword")))
    fresh = F.row_number().over(Window.partitionBy("user_id", "keyword_norm").orderBy(at, request_id)) == 1
    before = Window.partitionBy("user_id").orderBy(at, request_id).rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.sum(F.col("fresh").cast("int")).over(before), F.lit(0))
    return asked.withColumn("fresh", fresh).withColumn("result", F.when(kept >= most, "PLAN_LIMIT").when(F.col("fresh"), "OK").otherwise("DUPLICATE")).drop("fresh")
