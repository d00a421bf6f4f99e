"""Text queries: titles, hashes, names, URLs, guards (N*, F6-F8, P4, J17, K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import DANGER_WORDS, FORBIDDEN_WORDS, NEGATIVE_PERSON_WORDS, SAFE_PHRASES, TRACKING_PARAMETERS
from braidwork.functions import text as X
from braidwork.functions.hashing import simhash32
from braidwork.operators.matching import cache_hits, jaccard_pairs, near_hashes
from braidwork.operators.mappers import expanded_aliases
from braidwork.operators.stories import clustered, representatives, survivors
from braidwork.operators.tables import stored
from braidwork.functions.scoring import heat
from braidwork.plans.views import table, view, with_views


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with tokens, simhash and published_at."""
    a = view(spark, sf_dir, "article")
    tokens = X.title_tokens(X.display_title(F.col("title")))
    return a.withColumn("tokens", tokens).withColumn("simhash", simhash32(F.col("tokens"))).withColumn("published_at", F.timestamp_seconds(1704067200 + 60 * F.col("minute")))


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", F.array_join("tokens", "|").alias("tokens"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", "simhash")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different title hashes within 3 bits."""
    return near_hashes(articles(spark, sf_dir).select("simhash"))


def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(articles(spark, sf_dir).select("id", "simhash", "published_at"))


def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles, the first of each title, whose titles have a Jaccard similarity of 0.5 or more."""
    one = view(spark, sf_dir, "article").groupBy("title").agg(F.min("id").alias("set_id"))
    return jaccard_pairs(one.select("set_id", X.title_tokens(X.display_title(F.col("title"))).alias("tokens"))).select("a", "b", (F.floor(F.col("jaccard") * 1e6 + 0.5) / 1e6).alias("jaccard"))


def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's cluster, and the cluster's representative in the end."""
    return clustered(articles(spark, sf_dir).select("id", "tokens", "published_at", "tier"))


def news_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 before D2, D3: duplicates go first, what is left is clustered; a duplicate is in the cluster of the article that it repeats."""
    a = stored(articles(spark, sf_dir).select("id", "tokens", "simhash", "published_at", "tier"), "articles")
    done = stored(survivors(a.select("id", "simhash", "published_at")), "survivors")
    c = clustered(a.join(done.where("kept").select("id"), "id", "left_semi").select("id", "tokens", "published_at", "tier"))
    of = done.withColumn("of", F.coalesce("duplicate_of", "id"))
    return of.join(c.withColumnRenamed("id", "of"), "of").select("id", "kept", "cluster_id", "representative")


def story_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with one title are a story; its representative, size and heat."""
    a = view(spark, sf_dir, "article").withColumn("cluster_id", F.min("id").over(Window.partitionBy("title")))
    recent = a.groupBy("cluster_id").agg(F.count_if(F.col("fetched_minute") > F.lit(900)).alias("recent"))
    r = representatives(a.select("cluster_id", F.col("id").alias("article_id"), "tier", F.col("minute").alias("published_at")))
    return r.join(recent, "cluster_id").select("cluster_id", "article_id", "articles", heat(F.col("articles"), F.col("tier_min"), F.col("recent")).alias("heat"))


def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each canonical URL."""
    p = table(spark, sf_dir, "pages").withColumn("canonical", X.canonical_url(F.col("url")))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


def page_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out, spaces squashed, 200 characters."""
    return table(spark, sf_dir, "pages").select("page_id", X.lead_text(F.col("html")).alias("lead"))


def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_name(F.col("p_name")).alias("norm"), X.normalize_entity(F.col("p_type")).alias("entity"), X.first_syllable_equal(F.col("p_name"), F.col("p_type")).alias("same_first"))


def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), F.col("p_name").alias("name"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("ticker"), F.lit(None).cast("string").alias("english"), F.array().cast("array<string>").alias("former"), F.array("p_brand", "p_brand").alias("brands"), F.lit(False).alias("holding"))
    return expanded_aliases(p).select("company_id", "alias", "alias_norm", "alias_type", "is_ambiguous")


def title_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F7 on whole texts: the article's, with a word of the lists put into it where its id says so; counts and first place."""
    words = F.array(*map(F.lit, ("추천", "매수 매수", "화재", "투자 추천·자문이 아닙니다", "구속", "", "목표가 사라", "사망")))
    a = view(spark, sf_dir, "article").withColumn("t", F.concat_ws(" ", "text", F.element_at(words, (F.col("id") % 8 + 1).cast("int")), "title"))
    f = X.forbidden_words(F.col("t"))
    return a.select("id", F.size(f).alias("forbidden"), F.array_min(F.transform(f, lambda x: x["index"])).alias("first_at"), X.is_dangerous(F.col("t")).alias("danger"), X.is_negative_person(F.col("t")).alias("negative"))


def verbatim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: different 21-character runs of each article's summary that the article's or the one before's whole text holds. Summaries
    are the text's 40 characters in the middle, of every second article with letters changed, and the title."""
    a = view(spark, sf_dir, "article")
    mid = F.expr("substring(text, cast(length(text) div 2 as int) + 1, 40)")
    s = a.withColumn("summary", F.concat_ws(" / ", F.when(F.col("id") % 2 == 0, mid).otherwise(F.translate(mid, "ae", "ea")), "title"))
    b = a.select((F.col("id") + 1).alias("id"), F.col("text").alias("before"))
    return s.join(b, "id", "left").select("id", F.size(X.long_quotes(F.col("summary"), F.array("text", F.coalesce("before", F.lit(""))))).alias("quotes"))


def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.input_hash(F.col("role"), F.col("text"), F.lit(None).cast("string")).alias("hash"))


def run_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest OK run with the same input for each run."""
    r = view(spark, sf_dir, "run").select("run_id", "stage", F.col("model").alias("prompt_version"), F.floor(F.col("cost_usd") * 10).cast("long").alias("input_hash"), "status", F.col("ts").alias("created_at"))
    q = r.select(F.col("run_id").alias("request_id"), "stage", "prompt_version", "input_hash")
    return cache_hits(q, r).select("request_id", "run_id")


QUERIES = {
    "title_tokens": title_tokens, "simhash32": simhash, "near_dup_pairs": near_dup_pairs, "dedup_survivors": dedup_survivors, "title_jaccard": title_jaccard, "cluster_assign": cluster_assign, "news_clusters": news_clusters, "story_heat": story_heat,
    "canonical_pages": canonical_pages, "page_leads": page_leads, "norm_name": norm_name, "alias_expand": alias_expand, "title_guards": title_guards, "verbatim_quotes": verbatim_quotes, "input_hashes": input_hashes, "run_cache": run_cache,
}

_TOK = r""", c AS (SELECT *, regexp_replace(title, '[^\p{L}\p{N}]', '', 'g') AS s FROM article),
tok AS (SELECT *, CASE WHEN length(s) = 0 THEN [] WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) END AS tokens FROM c)"""
_SIM = _TOK + """, h AS (SELECT id, title, tokens, list_transform(tokens, lambda t: list_reduce(list_transform(string_split(t, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))) AS hs FROM tok),
sim AS (SELECT id, title, CAST(coalesce(list_sum(list_transform(range(32), lambda k: CASE WHEN list_sum(list_transform(hs, lambda x: CASE WHEN (x >> k) & 1 = 1 THEN 1 ELSE -1 END)) > 0 THEN CAST(1 AS BIGINT) << k ELSE 0 END)), 0) AS BIGINT) AS simhash FROM h)"""

_URL = r"regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query'])"


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _masked(column: str) -> str:
    for p in SAFE_PHRASES:
        column = f"replace({column}, '{p}', '{' ' * len(p)}')"
    return column


#: D1 and D2 as loops over the articles in order, over the table `sim`, and over those of `tok` that a table `todo` names.
_D1 = """, o AS (SELECT row_number() OVER (ORDER BY s.id) AS k, s.id, simhash AS h FROM sim s),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS duplicate_of, CAST([] AS STRUCT(h BIGINT, id BIGINT)[]) AS kept
  UNION ALL SELECT o.k, o.id, n.of, CASE WHEN n.of IS NULL THEN list_append(r.kept, {'h': o.h, 'id': o.id}) ELSE r.kept END FROM r JOIN o ON o.k = r.k + 1, LATERAL (SELECT list_filter(r.kept, lambda x: bit_count(xor(x.h, o.h)) <= 3)[1].id AS of) n)"""
_D2 = """, o AS (SELECT row_number() OVER (ORDER BY id) AS k, id, list_distinct(tokens) AS t, minute * 60 AS at, tier FROM tok WHERE id IN (SELECT id FROM todo)),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS cluster_id, CAST([] AS STRUCT(id BIGINT, t VARCHAR[], seen BIGINT, tier INT, rep BIGINT, rep_at BIGINT)[]) AS open
  UNION ALL SELECT o.k, o.id, CASE WHEN n.p IS NULL THEN o.id ELSE r.open[n.p].id END,
    CASE WHEN n.p IS NULL THEN list_append(r.open, {'id': o.id, 't': o.t, 'seen': o.at, 'tier': o.tier, 'rep': o.id, 'rep_at': o.at})
    ELSE r.open[:n.p - 1] || [CASE WHEN o.tier < r.open[n.p].tier OR (o.tier = r.open[n.p].tier AND o.at < r.open[n.p].rep_at) THEN {'id': r.open[n.p].id, 't': o.t, 'seen': greatest(o.at, r.open[n.p].seen), 'tier': o.tier, 'rep': o.id, 'rep_at': o.at}
      ELSE {'id': r.open[n.p].id, 't': r.open[n.p].t, 'seen': greatest(o.at, r.open[n.p].seen), 'tier': r.open[n.p].tier, 'rep': r.open[n.p].rep, 'rep_at': r.open[n.p].rep_at} END] || r.open[n.p + 1:] END
  FROM r JOIN o ON o.k = r.k + 1, LATERAL (SELECT list_transform(r.open, lambda c: CASE WHEN abs(o.at - c.seen) > 86400 THEN -1e0 WHEN len(c.t) + len(o.t) = 0 THEN 1e0 ELSE len(list_intersect(c.t, o.t)) / (len(c.t) + len(o.t) - len(list_intersect(c.t, o.t))) END) AS js) j,
  LATERAL (SELECT CASE WHEN list_max(j.js) >= 0.5 THEN list_position(j.js, list_max(j.js)) END AS p) n),
last AS (SELECT unnest(open) AS c FROM r WHERE k = (SELECT max(k) FROM r))"""

ORACLE_SQL = {
    "title_tokens": with_views("article") + _TOK + " SELECT id, array_to_string(tokens, '|') AS tokens FROM tok",
    "simhash32": with_views("article") + _SIM + " SELECT id, simhash FROM sim",
    "near_dup_pairs": with_views("article") + _SIM + ", d AS (SELECT DISTINCT simhash AS x FROM sim) SELECT p.x AS a, q.x AS b FROM d p JOIN d q ON p.x < q.x AND bit_count(xor(p.x, q.x)) <= 3",
    "dedup_survivors": with_views("article", recursive=True) + _SIM + _D1 + " SELECT id, duplicate_of IS NULL AS kept, duplicate_of FROM r WHERE k > 0",
    "cluster_assign": with_views("article", recursive=True) + _TOK + ", todo AS (SELECT id FROM tok)" + _D2 + " SELECT r.id, cluster_id, c.rep AS representative FROM r JOIN last ON c.id = cluster_id WHERE k > 0",
    "news_clusters": with_views("article", recursive=True) + _SIM + _D1.replace("r AS (", "d AS (", 1).replace("FROM r JOIN", "FROM d r JOIN").replace(", o AS (", ", od AS (", 1).replace("JOIN o ON", "JOIN od o ON") + ", gone AS (SELECT id, duplicate_of FROM d WHERE k > 0), todo AS (SELECT id FROM gone WHERE duplicate_of IS NULL)" + _D2
    + " SELECT g.id, g.duplicate_of IS NULL AS kept, r.cluster_id, c.rep AS representative FROM gone g JOIN r ON r.id = coalesce(g.duplicate_of, g.id) AND r.k > 0 JOIN last ON c.id = r.cluster_id",
    "title_jaccard": with_views("article") + _TOK + """, one AS (SELECT min(id) AS id, list_distinct(first(tokens)) AS t FROM tok GROUP BY title HAVING len(first(tokens)) > 0),
j AS (SELECT p.id AS x, q.id AS y, len(list_intersect(p.t, q.t)) AS c, len(p.t) + len(q.t) AS n FROM one p JOIN one q ON p.id < q.id)
SELECT x AS a, y AS b, floor(c / (n - c) * 1e6 + 0.5) / 1e6 AS jaccard FROM j WHERE c >= 0.5 * (n - c)""",
    "story_heat": with_views("article") + """, g AS (SELECT *, min(id) OVER (PARTITION BY title) AS cluster_id FROM article)
SELECT cluster_id, arg_min(id, (tier, minute, id)) AS article_id, count(*) AS articles,
  floor((log2(greatest(count(*), 1)) * 20 + CASE min(tier) WHEN 1 THEN 15 WHEN 2 THEN 8 ELSE 0 END + count(*) FILTER (fetched_minute > 900) * 5) * 100 + 0.5) / 100 AS heat FROM g GROUP BY cluster_id""",
    "canonical_pages": f"""WITH u AS (SELECT page_id, trim(url) AS url, {_URL} AS p FROM pages),
q AS (SELECT page_id, url, p, list_filter(string_split(substr(p.query, 2), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN {TRACKING_PARAMETERS}) AS k FROM u),
s AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(k, lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'x': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END}})), lambda x: x.x), '&') AS kept FROM q),
c AS (SELECT page_id, CASE WHEN p.scheme = '' OR p.host = '' THEN url ELSE lower(p.scheme) || '://' || lower(p.host) || CASE WHEN p.path = '' THEN '/' WHEN length(p.path) > 1 THEN regexp_replace(p.path, '/$', '') ELSE p.path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM s)
SELECT canonical, min(page_id) AS page_id, count(*) AS pages FROM c GROUP BY canonical""",
    "page_leads": r"SELECT page_id, nullif(substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 200), '') AS lead FROM pages",
    "norm_name": r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '\s+', '', 'g'), '[.,''"·\-_/]', '', 'g')) AS norm,
  regexp_replace(regexp_replace(p_type, '\s+', '', 'g'), '[.,''"·\-_/()\[\]{}]', '', 'g') AS entity, length(p_name) > 0 AND length(p_type) > 0 AND left(p_name, 1) = left(p_type, 1) AS same_first FROM part""",
    "alias_expand": r"""WITH a AS (SELECT p_partkey AS company_id, p_name AS alias, 'OFFICIAL' AS alias_type FROM part UNION SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 'TICKER' FROM part UNION SELECT p_partkey, p_brand, 'BRAND' FROM part),
b AS (SELECT company_id, trim(alias) AS alias, lower(regexp_replace(regexp_replace(alias, '\s+', '', 'g'), '[.,''"·\-_/]', '', 'g')) AS alias_norm, alias_type FROM a)
SELECT company_id, alias, alias_norm, alias_type, length(alias_norm) <= 1 AS is_ambiguous FROM b WHERE alias_norm <> '' AND NOT regexp_matches(alias, '^[A-Za-z]{1,2}$')""",
    "title_guards": with_views("article") + f""", t AS (SELECT id, concat_ws(' ', text, list_extract(['추천', '매수 매수', '화재', '투자 추천·자문이 아닙니다', '구속', '', '목표가 사라', '사망'], id % 8 + 1), title) AS t FROM article),
m AS (SELECT id, t, {_masked("t")} AS m FROM t), w AS (SELECT id, t, m, unnest({_sql_list(FORBIDDEN_WORDS)}) AS w FROM m)
SELECT id, CAST(sum((length(m) - length(replace(m, w, ''))) // length(w)) AS INT) AS forbidden, CAST(min(nullif(instr(m, w), 0)) - 1 AS INT) AS first_at,
  len(list_filter({_sql_list(DANGER_WORDS)}, lambda x: contains(first(t), x))) > 0 AS danger, len(list_filter({_sql_list(NEGATIVE_PERSON_WORDS)}, lambda x: contains(first(t), x))) > 0 AS negative FROM w GROUP BY id""",
    "verbatim_quotes": with_views("article") + """, m AS (SELECT *, substr(text, CAST(length(text) // 2 AS BIGINT) + 1, 40) AS mid FROM article),
s AS (SELECT a.id, concat_ws(' / ', CASE WHEN a.id % 2 = 0 THEN mid ELSE translate(mid, 'ae', 'ea') END, a.title) AS s, a.text, coalesce(b.text, '') AS before FROM m a LEFT JOIN article b ON a.id = b.id + 1)
SELECT id, CAST(len(list_distinct(list_filter(list_transform(range(1, greatest(1, length(s) - 19)), lambda i: substr(s, i, 21)), lambda w: contains(text, w) OR contains(before, w)))) AS INT) AS quotes FROM s""",
    "input_hashes": "SELECT conv_id, turn, sha256(role || chr(0) || text || chr(0)) AS hash FROM conversations",
    "run_cache": with_views("run") + """, r AS (SELECT *, CAST(floor(cost_usd * 10) AS BIGINT) AS h FROM run), ok AS (SELECT stage, model, h, arg_max(run_id, (ts, run_id)) AS run_id FROM r WHERE status = 'OK' GROUP BY 1, 2, 3)
SELECT r.run_id AS request_id, ok.run_id FROM r LEFT JOIN ok ON r.stage = ok.stage AND r.model = ok.model AND r.h = ok.h""",
}
