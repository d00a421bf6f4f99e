"""Pages of the service (Q3, Q5, Q8-Q12, Q14, Q15, Q17, Q18, Q23, F5, G7): each is one plan for all clusters, companies or users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import BUSINESS_KINDS
from braidwork.functions.scoring import heat, is_meme
from braidwork.functions.text import normalize_entity, normalize_name
from braidwork.functions.timeutil import within_days
from braidwork.operators.decisions import keyword_requests
from braidwork.operators.graph import lanes
from braidwork.operators.matching import alias_hits, unlisted
from braidwork.operators.stages import extracted, summaries
from braidwork.plans.market import RATIO, with_ratio
from braidwork.plans.reads import _BASE, connections, meme_top, top, visible
from braidwork.plans.views import daily_market, table, view, with_views


def _order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.col("id"), F.col("company_id"), F.col("entity_id")]


def created(c: DataFrame) -> DataFrame:
    """Connections with the minute since 1970 in which they were made."""
    return c.withColumn("created", F.unix_date("trade_date").cast("long") * 1440 + F.col("id") % 1440)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with heat."""
    return view(spark, sf_dir, "cluster").withColumn("heat", heat(F.col("articles"), F.col("tier"), F.col("recent")))


def listed(rows: DataFrame, key: str, order: list[Column], value: Column) -> DataFrame:
    """(key, list): the values of each key in order, joined by bars."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"].cast("string")), "|").alias("list"))


def cluster_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: the entities of each cluster by importance."""
    m = view(spark, sf_dir, "mention").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), "entity_id")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("importance"), "entity_id")
    return m.select("cluster_id", "entity_id", "name", "importance", F.row_number().over(w).alias("rank"))


def cluster_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: each cluster with its 4 best visible connections, its entities by importance and the sectors of its companies."""
    c = visible(connections(spark, sf_dir))
    best = listed(top(c, ["cluster_id"], _order(), 4), "cluster_id", [-F.col("score"), F.col("id"), F.col("company_id"), F.col("entity_id")], F.col("id")).withColumnRenamed("list", "connections")
    names = listed(cluster_entities(spark, sf_dir), "cluster_id", [F.col("rank")], F.col("name")).withColumnRenamed("list", "entities")
    sectors = c.select("cluster_id", "company_id").join(view(spark, sf_dir, "company"), "company_id").groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("sector")), "|").alias("sectors"))
    cards = clusters(spark, sf_dir).select("cluster_id", "headline", "heat")
    for part in (best, names, sectors):
        cards = cards.join(part, "cluster_id", "left")
    return cards


def cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: the 100 best visible connections of each cluster, with its headline."""
    c = top(visible(connections(spark, sf_dir)), ["cluster_id"], _order(), 100, "rank")
    return c.join(clusters(spark, sf_dir), "cluster_id").select("cluster_id", "headline", "heat", "rank", "id", "company_id", "entity_id", "score")


def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the newest day with connections, the ten companies that moved most (unknown moves first, as a descending sort has
    them there), each with its best visible connection of that day."""
    c = connections(spark, sf_dir)
    day = c.agg(F.max("trade_date").alias("trade_date"))
    snap = with_ratio(daily_market(spark, sf_dir)).join(F.broadcast(day), "trade_date", "left_semi")
    ten = snap.withColumn("move", F.abs("change_pct")).orderBy(F.desc_nulls_first("move"), "company_id").limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_first("move"), "company_id"))  # 10 rows
    best = top(visible(c).join(F.broadcast(day), "trade_date", "left_semi"), ["company_id"], _order(), 1).select("company_id", F.col("id").alias("connection_id"), "score")
    return ten.withColumn("rank", rank).join(best, "company_id", "left").select("rank", "company_id", "trade_date", "change_pct", "connection_id", "score")


def recent_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: of the visible connections made in the 60 minutes up to the newest one, the newest 20."""
    c = created(visible(connections(spark, sf_dir)))
    now = c.agg((F.max("created") - 60).alias("since"))
    return c.join(F.broadcast(now), F.col("created") >= F.col("since")).orderBy(F.desc("created"), "id", "company_id", "entity_id").limit(20).select("id", "company_id", "entity_id", "created")


def home_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10's clusters: the 5 hottest of the newest day; ties go to the one seen last."""
    c = clusters(spark, sf_dir)
    day = view(spark, sf_dir, "connection").agg(F.max("trade_date").alias("trade_date"))
    return c.join(F.broadcast(day), "trade_date", "left_semi").orderBy(F.desc("heat"), F.desc("first_seen"), "cluster_id").limit(5).select("cluster_id", "headline", "heat", "first_seen")


def home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: the home page's parts as (part, rank, ref_id): the newest day with connections of any state (as days since 1970), that day's
    clusters, memes and movers, and the recent connections. Each part is 20 rows at most."""
    every = connections(spark, sf_dir)
    day = every.agg(F.max("trade_date").alias("trade_date"))
    memes = meme_top(visible(every).join(F.broadcast(day), "trade_date", "left_semi").where(is_meme(F.col("kind"), F.col("meme"))))  # day is one row
    rank = lambda *by: F.row_number().over(Window.orderBy(*by)).alias("rank")
    parts = [
        home_clusters(spark, sf_dir).select(F.lit("cluster").alias("part"), rank(F.desc("heat"), F.desc("first_seen"), "cluster_id"), F.col("cluster_id").alias("ref_id")),
        day.select(F.lit("trade_date"), F.lit(1), F.unix_date("trade_date")),
        memes.select(F.lit("meme"), "rank", F.col("company_id")),
        movers(spark, sf_dir).select(F.lit("mover"), "rank", F.col("company_id")),
        recent_connections(spark, sf_dir).select(F.lit("recent"), rank(F.desc("created"), "id", "company_id", "entity_id"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("part", "rank", F.col("ref_id").cast("long").alias("ref_id"))


def listed_connections(c: DataFrame, types: tuple[str, ...] = (), sort: str = "connection", business_only: bool = False, include_meme: bool = True) -> DataFrame:
    """Of each cluster's 200 best visible connections those that pass the filters, by the chosen score."""
    first = top(visible(c), ["cluster_id"], _order(), 200, "place")
    if types:
        first = first.where(F.col("kind").isin(*types))
    if business_only:
        first = first.where(F.col("kind").isin(*BUSINESS_KINDS))
    if not include_meme:
        first = first.where(~is_meme(F.col("kind"), F.col("meme")))
    by = {"connection": F.col("score"), "market": F.coalesce("mr", F.lit(0)), "business": F.col("br")}[sort]
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(by.desc(), "place"))).select("cluster_id", "rank", "id", "company_id", "entity_id")


def connection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: business connections without memes, by market reaction."""
    return listed_connections(connections(spark, sf_dir), sort="market", business_only=True, include_meme=False)


def connection_list_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: themes, persons and memes by business relevance."""
    return listed_connections(connections(spark, sf_dir), ("THEME", "PERSON", "MEME"), "business")


def stock_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company with its newest snapshot and the last prices of the newest 5 days, from its newest 200 snapshots."""
    w = Window.partitionBy("company_id").orderBy(F.desc("trade_date"))
    days = with_ratio(daily_market(spark, sf_dir)).withColumn("n", F.row_number().over(w)).where("n <= 200")
    spark_line = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("trade_date", "price")))), lambda x: F.floor(x["price"]).cast("string")), ",")
    g = days.groupBy("company_id").agg(*(F.max(F.when(F.col("n") == 1, F.col(c))).alias(c) for c in ("trade_date", "price", "change_pct", "volume_ratio")), spark_line.alias("spark"))
    return view(spark, sf_dir, "company").join(g, "company_id", "left").select("company_id", "ticker", "company_name", "market", "sector", "trade_date", "price", "change_pct", "volume_ratio", "spark")


def stock_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: the visible connections of each company in the 30 days up to the newest, best first."""
    c = visible(connections(spark, sf_dir))
    end = view(spark, sf_dir, "connection").agg(F.max("trade_date").alias("end"))
    c = c.join(F.broadcast(end), within_days(F.col("trade_date"), F.col("end"), 30)).join(view(spark, sf_dir, "company"), "company_id")
    w = Window.partitionBy("company_id").orderBy(F.desc("score"), "id", "entity_id")
    return c.select("company_id", "ticker", "market", "id", "score", F.row_number().over(w).alias("rank"))


def entity_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: the visible connections anchored on each entity, best first."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "id", "company_id")
    return visible(connections(spark, sf_dir)).select("entity_id", "id", "company_id", "score", F.row_number().over(w).alias("rank"))


def connection_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: the connections asked for (here those of orders divisible by 20), whatever their status, with their company."""
    asked = connections(spark, sf_dir).where("floor(id / 10) % 20 = 0")
    return asked.join(view(spark, sf_dir, "company"), "company_id").select("id", "cluster_id", "company_id", "ticker", "company_name", "entity_id", "score", "status")


def found(spark: SparkSession, sf_dir: str, q: str, kind: str = "all") -> DataFrame:
    """(kind, rank, ref_id, name): companies by ticker, name or alias, clusters by headline, entities by name, and without any
    company the names of up to 3 that sound alike. Each list is 10 rows at most."""
    like, norm = f"%{q}%", normalize_name(F.lit(q))
    ranked = lambda df, name, ref, label, *by: df.select(F.lit(name).alias("kind"), F.row_number().over(Window.orderBy(*by)).alias("rank"), F.col(ref).cast("long").alias("ref_id"), F.col(label).alias("name"))
    part, alias = table(spark, sf_dir, "part"), view(spark, sf_dir, "alias")
    by_alias = alias.where(F.col("alias_norm").ilike(like)).select(F.col("company_id").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    by_name = (F.lpad(F.col("p_partkey").cast("string"), 6, "0") == q) | normalize_name(F.col("p_name")).ilike(like)
    companies = part.join(by_alias, "p_partkey", "left").where(by_name | F.col("hit")).orderBy("p_partkey").limit(10)
    out = []
    if kind in ("all", "company"):
        out.append(ranked(companies, "company", "p_partkey", "p_name", "p_partkey"))
    if kind in ("all", "news"):
        news = clusters(spark, sf_dir).where(F.col("headline").ilike(like)).orderBy(F.desc("heat"), F.desc("first_seen"), "cluster_id").limit(5)
        out.append(ranked(news, "news", "cluster_id", "headline", F.desc("heat"), F.desc("first_seen"), "cluster_id"))
    if kind in ("all", "keyword"):
        total = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("mentions"))
        words = part.where(normalize_name(F.col("p_type")).ilike(like)).join(total, "p_partkey").orderBy(F.desc("mentions"), "p_partkey").limit(10)
        out.append(ranked(words, "keyword", "p_partkey", "p_type", F.desc("mentions"), "p_partkey"))
    if kind in ("all", "company"):
        asked = part.limit(1).select(F.lit(0).cast("long").alias("entity_id"), F.lit(q).alias("name"), norm.alias("norm")).withColumn("spelled", F.col("norm"))
        asked = asked.join(companies.limit(1).select(F.lit(q).alias("name")), "name", "left_anti").where("norm <> ''")
        hits = alias_hits(asked, alias.withColumn("alias_spelled", F.col("alias_norm"))).join(part.select(F.col("p_partkey").alias("company_id"), "p_name"), "company_id")
        names = hits.groupBy("p_name").agg(F.max("recall_score").alias("score"), F.min_by("alias_id", F.struct(-F.col("recall_score"), "alias_id")).alias("first"), F.min_by("company_id", F.struct(-F.col("recall_score"), "alias_id")).alias("company_id"))
        out.append(ranked(names.orderBy(F.desc("score"), "first").limit(3), "suggestion", "company_id", "p_name", F.desc("score"), "first"))
    result = out[0]
    for o in out[1:]:
        result = result.union(o)
    return result


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "00001")


def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "Brandd#11", "company")


def alert_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q23: what becomes of each request for an alert keyword: made, known already, or over the limit of 5 of a user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("Kw "), (F.col("event_id") % 9).cast("string")).alias("keyword"), "ts")
    return keyword_requests(e, "event_id", "ts").select("event_id", "user_id", "result")


def entities_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts whose normalised name is not on the stop list, which has every 20th part's."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), normalize_name(F.col("p_name")).alias("name_norm"))
    return unlisted(p, p.where("entity_id % 20 = 0").select("name_norm"))


def lane_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each cluster's connections on four lanes."""
    c = view(spark, sf_dir, "connection").select(F.col("cluster_id").alias("graph_id"), "id", F.col("company_id").alias("tie"), (F.col("hops") % 4).alias("lane"))
    return lanes(c, ["graph_id"], ["id", "tie"], 800, 480).select("graph_id", "id", "lane", "x", (F.floor(F.col("y") * 1e6 + 0.5) / 1e6).alias("y"))


def summary_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as requests; a third of the summaries quote, a fifth are cached, a seventh fail, an eleventh can't be read."""
    a, i = view(spark, sf_dir, "article"), F.col("id")
    hash_ = F.concat_ws(":", "source", F.length("text"))
    quote = F.when(i % 3 == 0, F.substring("text", 2, 30)).otherwise(F.concat(F.lit("About "), F.left("title", F.lit(12))))
    requests = a.select(i.alias("cluster_id"), hash_.alias("input_hash"), F.floor(i / 100).alias("day"), i.alias("at"), F.array("text").alias("sources"))
    cached = a.where("id % 5 = 0").groupBy(hash_.alias("input_hash")).agg(F.concat(F.lit("Cached "), F.min("id").cast("string")).alias("summary"))
    outputs = a.select(i.alias("cluster_id"), F.when(i % 11 != 0, quote).alias("summary"), (1 + i % 4).cast("double").alias("cost"), F.when(i % 7 == 0, "timeout").alias("error"))
    return summaries(requests, cached, outputs, 150.0)


def _extracted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = table(spark, sf_dir, "part")
    m = view(spark, sf_dir, "mention").join(p, F.col("p_partkey") == F.col("entity_id")).select("cluster_id", F.col("p_type").alias("name"), F.col("p_brand").alias("kind"), "importance")
    types = p.select(normalize_entity(F.col("p_type")).alias("name_norm")).distinct()
    canonical = types.where(F.length("name_norm") % 3 == 0).select("name_norm", F.left("name_norm", F.lit(5)).alias("canonical_norm"))
    return extracted(m, types.where(F.length("name_norm") % 7 == 1), canonical)


def entity_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that part types of stories give."""
    return _extracted(spark, sf_dir)["entities"]


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MENTIONS edges of stories."""
    return _extracted(spark, sf_dir)["edges"]


QUERIES = {
    "summary_stage": summary_stage, "entity_stage": entity_stage, "entity_mentions": entity_mentions,
    "cluster_entities": cluster_entities, "cluster_cards": cluster_cards, "cluster_detail": cluster_detail, "movers": movers, "recent_connections": recent_connections, "home_clusters": home_clusters, "home": home,
    "connection_list": connection_list, "connection_list_themes": connection_list_themes, "stock_detail": stock_detail, "stock_connections": stock_connections, "entity_connections": entity_connections, "connection_by_id": connection_by_id,
    "search": search, "search_suggestions": search_suggestions, "alert_keywords": alert_keywords, "entities_unlisted": entities_unlisted, "lane_layout": lane_layout,
}

_HEAT = "floor((log2(greatest(articles, 1)) * 20 + CASE tier WHEN 1 THEN 15 WHEN 2 THEN 8 ELSE 0 END + recent * 5) * 100 + 0.5) / 100"
_BY = "score DESC, id, company_id, entity_id"
_ALL = with_views("connection", "company", "daily", "cluster", "mention") + _BASE.removeprefix(with_views("connection", "company")) + f""", cl AS (SELECT *, {_HEAT} AS heat FROM cluster), newest AS (SELECT max(trade_date) AS d FROM connection),
{RATIO.format(of='daily')}, made AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', trade_date) AS BIGINT) * 1440 + id % 1440 AS created FROM v),
ents AS (SELECT m.cluster_id, m.entity_id, p_name AS name, m.importance, CAST(row_number() OVER (PARTITION BY m.cluster_id ORDER BY m.importance DESC, m.entity_id) AS INT) AS rank FROM mention m JOIN part ON p_partkey = m.entity_id),
mv AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(change_pct) DESC NULLS FIRST, company_id) AS INT) AS rank FROM ratio, newest WHERE trade_date = d QUALIFY rank <= 10),
mb AS (SELECT company_id, id, score FROM v, newest WHERE trade_date = d QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY {_BY}) = 1),
rc AS (SELECT * FROM made WHERE created >= (SELECT max(created) - 60 FROM made) ORDER BY created DESC, id, company_id, entity_id LIMIT 20),
hc AS (SELECT cl.* FROM cl, newest WHERE trade_date = d ORDER BY heat DESC, first_seen DESC, cluster_id LIMIT 5),
li AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {_BY}) <= 200)"""
_NORM = r"lower(regexp_replace(regexp_replace({}, '\s+', '', 'g'), '[.,''\"·\-_/]', '', 'g'))"
_BARE = with_views("cluster", "alias") + f", cl AS (SELECT *, {_HEAT} AS heat FROM cluster)"


def _found_sql(q: str, kinds: str) -> str:
    norm = _NORM.format(f"'{q}'")
    return _BARE + f""", co AS (SELECT p_partkey, p_name FROM part WHERE lpad(CAST(p_partkey AS VARCHAR), 6, '0') = '{q}' OR {_NORM.format('p_name')} ILIKE '%{q}%' OR p_partkey IN (SELECT company_id FROM alias WHERE alias_norm ILIKE '%{q}%') ORDER BY p_partkey LIMIT 10),
ne AS (SELECT * FROM cl WHERE headline ILIKE '%{q}%' ORDER BY heat DESC, first_seen DESC, cluster_id LIMIT 5),
kw AS (SELECT p_partkey, p_type, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part WHERE {_NORM.format('p_type')} ILIKE '%{q}%' AND p_partkey IN (SELECT l_partkey FROM lineitem) ORDER BY n DESC, p_partkey LIMIT 10),
al AS (SELECT *, {norm} AS q, 1 - levenshtein({norm}, alias_norm) / greatest(length({norm}), length(alias_norm)) AS sim FROM alias),
sc AS (SELECT *, CASE WHEN q = alias_norm THEN 1e0 WHEN least(length(q), length(alias_norm)) >= 2 AND (starts_with(alias_norm, q) OR starts_with(q, alias_norm)) THEN 0.55e0 WHEN sim >= 0.6 THEN 0.35e0 + sim * 0.4e0 WHEN left('{q}', 1) = left(alias, 1) THEN 0.55e0 END AS s FROM al),
su AS (SELECT p_name, max(s) AS s, min((-s, alias_id, company_id)) AS m FROM sc JOIN part ON p_partkey = company_id WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM co) GROUP BY p_name ORDER BY s DESC, m LIMIT 3),
every AS (SELECT 'company' AS kind, row_number() OVER (ORDER BY p_partkey) AS rank, p_partkey AS ref_id, p_name AS name FROM co
  UNION ALL SELECT 'news', row_number() OVER (ORDER BY heat DESC, first_seen DESC, cluster_id), cluster_id, headline FROM ne UNION ALL SELECT 'keyword', row_number() OVER (ORDER BY n DESC, p_partkey), p_partkey, p_type FROM kw
  UNION ALL SELECT 'suggestion', row_number() OVER (ORDER BY s DESC, m), m[3], p_name FROM su)
SELECT kind, CAST(rank AS INT) AS rank, CAST(ref_id AS BIGINT) AS ref_id, name FROM every WHERE kind IN ({kinds})"""


ORACLE_SQL = {
    "cluster_entities": _ALL + " SELECT * FROM ents",
    "cluster_cards": _ALL + f""", b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {_BY}) <= 4), bl AS (SELECT cluster_id, string_agg(CAST(id AS VARCHAR), '|' ORDER BY {_BY}) AS connections FROM b GROUP BY 1),
el AS (SELECT cluster_id, string_agg(name, '|' ORDER BY rank) AS entities FROM ents GROUP BY 1), sl AS (SELECT cluster_id, string_agg(DISTINCT sector, '|' ORDER BY sector) AS sectors FROM v JOIN company USING (company_id) GROUP BY 1)
SELECT cluster_id, headline, heat, connections, entities, sectors FROM cl LEFT JOIN bl USING (cluster_id) LEFT JOIN el USING (cluster_id) LEFT JOIN sl USING (cluster_id)""",
    "cluster_detail": _ALL + f", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {_BY}) AS INT) AS rank FROM v) SELECT cluster_id, headline, heat, rank, id, company_id, entity_id, score FROM r JOIN cl USING (cluster_id) WHERE rank <= 100",
    "movers": _ALL + " SELECT rank, mv.company_id, trade_date, change_pct, mb.id AS connection_id, mb.score FROM mv LEFT JOIN mb ON mv.company_id = mb.company_id",
    "recent_connections": _ALL + " SELECT id, company_id, entity_id, created FROM rc",
    "home_clusters": _ALL + " SELECT cluster_id, headline, heat, first_seen FROM hc",
    "connection_list": _ALL + f", f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(mr, 0) DESC, {_BY}) AS r FROM li WHERE kind NOT IN ('NAME_MATCH', 'KEYWORD', 'MEME') AND NOT is_meme) SELECT cluster_id, CAST(r AS INT) AS rank, id, company_id, entity_id FROM f",
    "connection_list_themes": _ALL + f" SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY br DESC, {_BY}) AS INT) AS rank, id, company_id, entity_id FROM li WHERE kind IN ('THEME', 'PERSON', 'MEME')",
    "stock_detail": with_views("company", "daily") + "," + RATIO.format(of="daily") + """, n AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trade_date DESC) AS n FROM ratio),
l AS (SELECT company_id, string_agg(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), ',' ORDER BY trade_date) AS spark FROM n WHERE n <= 5 GROUP BY 1)
SELECT company_id, ticker, company_name, market, sector, trade_date, price, change_pct, volume_ratio, spark FROM company LEFT JOIN (SELECT * FROM n WHERE n = 1) USING (company_id) LEFT JOIN l USING (company_id)""",
    "stock_connections": _ALL + " SELECT v.company_id, ticker, market, id, score, CAST(row_number() OVER (PARTITION BY v.company_id ORDER BY score DESC, id, entity_id) AS INT) AS rank FROM v JOIN company c ON v.company_id = c.company_id, newest WHERE trade_date >= d - 29",
    "entity_connections": _ALL + " SELECT entity_id, id, company_id, score, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, id, company_id) AS INT) AS rank FROM v",
    "connection_by_id": _ALL + " SELECT id, cluster_id, s.company_id, ticker, company_name, entity_id, score, status FROM s JOIN company USING (company_id) WHERE id // 10 % 20 = 0",
    "search": _found_sql("00001", "'company', 'news', 'keyword', 'suggestion'"),
    "search_suggestions": _found_sql("Brandd#11", "'company', 'suggestion'"),
    "alert_keywords": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 9 ORDER BY ts, event_id) = 1 AS fresh FROM events),
b AS (SELECT *, coalesce(sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM e)
SELECT event_id, user_id, CASE WHEN kept >= 5 THEN 'PLAN_LIMIT' WHEN fresh THEN 'OK' ELSE 'DUPLICATE' END AS result FROM b""",
    "entities_unlisted": f"WITH p AS (SELECT p_partkey AS entity_id, {_NORM.format('p_name')} AS name_norm FROM part) SELECT * FROM p WHERE name_norm NOT IN (SELECT name_norm FROM p WHERE entity_id % 20 = 0)",
    "lane_layout": with_views("connection") + """, n AS (SELECT *, hops % 4 AS lane, row_number() OVER (PARTITION BY cluster_id, hops % 4 ORDER BY id, company_id) - 1 AS i, count(*) OVER (PARTITION BY cluster_id, hops % 4) AS k FROM connection)
SELECT cluster_id AS graph_id, id, lane, lane * 200e0 + 100 AS x, floor((CASE WHEN k = 1 THEN 240e0 ELSE 36 + i * 408e0 / (k - 1) END) * 1e6 + 0.5) / 1e6 AS y FROM n""",
}
ORACLE_SQL["home"] = (
    _ALL
    + """, mo AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY meme DESC, score DESC, id, entity_id) AS n FROM v WHERE is_meme AND trade_date = (SELECT d FROM newest)),
me AS (SELECT row_number() OVER (ORDER BY meme DESC, score DESC, id, entity_id) AS rank, company_id FROM mo WHERE n = 1 QUALIFY rank <= 10)
SELECT 'cluster' AS part, CAST(row_number() OVER (ORDER BY heat DESC, first_seen DESC, cluster_id) AS INT) AS rank, cluster_id AS ref_id FROM hc UNION ALL SELECT 'meme', CAST(rank AS INT), company_id FROM me UNION ALL SELECT 'trade_date', 1, date_diff('day', DATE '1970-01-01', d) FROM newest
UNION ALL SELECT 'mover', rank, company_id FROM mv UNION ALL SELECT 'recent', CAST(row_number() OVER (ORDER BY created DESC, id, company_id, entity_id) AS INT), id FROM rc"""
)
ORACLE_SQL["summary_stage"] = (
    with_views("article")
    + """, a AS (SELECT *, source || ':' || length(text) AS h, CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 3 = 0 THEN substr(text, 2, 30) ELSE 'About ' || left(title, 12) END END AS new, CAST(1 + id % 4 AS DOUBLE) AS cost FROM article),
k AS (SELECT h, 'Cached ' || min(id) AS known FROM a WHERE id % 5 = 0 GROUP BY h), r AS (SELECT a.*, known, coalesce(known, new) AS s FROM a LEFT JOIN k USING (h)),
q AS (SELECT *, coalesce(sum(CASE WHEN known IS NULL THEN cost ELSE 0 END) OVER (PARTITION BY id // 100 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  coalesce(len(list_filter(list_transform(range(1, greatest(1, length(s) - 19)), lambda i: substr(s, i, 21)), lambda w: contains(text, w))), 0) > 0 AS blocked FROM r),
t AS (SELECT *, CASE WHEN known IS NULL THEN CASE WHEN spent >= 150 THEN 'SKIPPED_COST_CAP' WHEN id % 7 = 0 THEN 'ERROR' WHEN new IS NULL THEN 'INVALID_JSON' WHEN blocked THEN 'GUARDRAIL_BLOCKED' ELSE 'OK' END END AS run_status FROM q),
g AS (SELECT *, CASE WHEN known IS NULL THEN run_status = 'OK' ELSE NOT blocked END AS good FROM t)
SELECT id AS cluster_id, CASE WHEN good THEN s END AS summary, run_status, CASE WHEN good THEN 'DONE' WHEN run_status = 'SKIPPED_COST_CAP' THEN 'PENDING' ELSE 'FAILED' END AS analysis FROM g"""
)
_MENTIONED = (
    with_views("mention")
    + r""", m AS (SELECT cluster_id, p_type AS name, p_brand AS kind, importance, regexp_replace(regexp_replace(p_type, '\s+', '', 'g'), '[.,''"·\-_/()\[\]{}]', '', 'g') AS n FROM mention JOIN part ON p_partkey = entity_id),
k AS (SELECT cluster_id, name, kind, importance, CASE WHEN length(n) % 3 = 0 THEN left(n, 5) ELSE n END AS name_norm FROM m WHERE n <> '' AND length(n) % 7 <> 1)"""
)
ORACLE_SQL["entity_stage"] = _MENTIONED + " SELECT kind, name_norm, min(name) AS name, count(*) AS mention_total FROM k GROUP BY 1, 2"
ORACLE_SQL["entity_mentions"] = _MENTIONED + " SELECT cluster_id, kind, name_norm, 'MENTIONS' AS edge_type, max(importance) AS weight, 0.8e0 AS confidence FROM k GROUP BY 1, 2, 3"
