"""News deduplication and clustering (D1-D3): sequential rules, decided in rounds of joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.functions.similarity import cosine
from braidwork.operators.matching import jaccard_pairs, near_hashes
from braidwork.operators.tables import counted, stored


def survivors(articles: DataFrame, budget: int = 3) -> DataFrame:
    """(id, kept, duplicate_of) of articles (id, simhash, published_at): earliest first, an article within `budget` bits of
    a kept one is its duplicate; a null simhash is always kept. Duplicates don't chain.

    Only the first article of a hash can be kept, and it is unless an earlier hash within the budget is. Rounds over
    the table of links decide: a hash without earlier neighbours that are open is kept, and its later neighbours go.
    Equi-joins on hashes only; each round ends in a written table.
    """
    every = stored(articles.select(F.col("id").cast("long").alias("id"), F.col("simhash").cast("long").alias("simhash"), "published_at"), "articles")
    known = every.where("simhash is not null")
    hashes = stored(known.groupBy("simhash").agg(F.min(F.struct("published_at", "id")).alias("first")), "hashes")
    near = near_hashes(hashes, budget)
    both = stored(near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    of = lambda k, x: hashes.select(F.col("simhash").alias(k), F.col("first").alias(x))
    links = stored(both.join(of("a", "ta"), "a").join(of("b", "tb"), "b").where("tb < ta").select("a", "b"), "links")  # b is earlier
    left, kept = hashes.select(F.col("simhash").alias("a")), None
    while not left.isEmpty():
        now = stored(left.join(links.select("a").distinct(), "a", "left_anti"), "kept")
        gone = stored(links.join(now.select(F.col("a").alias("b")), "b", "left_semi").select("a").distinct(), "gone")
        kept = now if kept is None else kept.union(now)
        left = stored(left.join(now.union(gone), "a", "left_anti"), "left")
        links = stored(links.join(left, "a", "left_semi").join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"), "links")
    if kept is None:
        return every.select("id", F.lit(True).alias("kept"), F.lit(None).cast("long").alias("duplicate_of"))
    kept = stored(kept.join(of("a", "first"), "a").select(F.col("a").alias("b"), "first"), "kept")
    meets = both.union(kept.select(F.col("b").alias("a"), "b")).join(kept, "b").select(F.col("a").alias("simhash"), "first")
    mine = F.struct("published_at", "id")
    hit = known.join(meets, "simhash").where(F.col("first") < mine).groupBy("id", "published_at", "simhash").agg(F.min("first").alias("of"))
    done = known.join(hit.select("id", F.col("of.id").alias("duplicate_of")).distinct(), "id", "left").select("id", F.col("duplicate_of").isNull().alias("kept"), "duplicate_of")
    return done.union(every.where("simhash is null").select("id", F.lit(True), F.lit(None).cast("long")))


def cosine_of(a: list[float] | None, b: list[float] | None) -> float | None:
    """Cosine of two vectors; None without one of them, 0 for zero norms or unequal lengths."""
    if a is None or b is None:
        return None
    if len(a) != len(b):
        return 0.0
    scale = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / scale if scale else 0.0


def step(clusters: list[dict], article: dict, floor: float, hours: float, least_cosine: float) -> dict:
    """D2, D3 for one article: the cluster it joins or opens, after the change. clusters are in the order in which they opened."""
    mine, at = frozenset(article["tokens"]), article["at"]
    best, score = None, -1.0
    for c in clusters:
        if abs(at - c["seen"]) > hours * 3600:
            continue
        union = len(mine | c["tokens"])
        s = len(mine & c["tokens"]) / union if union else 1.0
        near = cosine_of(article.get("vector"), c.get("vector"))
        if s >= floor and s > score and (near is None or near >= least_cosine):
            best, score = c, s
    if best is None:
        best = {"id": article["id"], "tokens": mine, "seen": at, "tier": None, "rep": None, "rep_at": None, "vector": article.get("vector"), "n": 0}
        clusters.append(best)
    if best["tier"] is None or (article["tier"], at) < (best["tier"], best["rep_at"]):  # the least tier of all, and the representative's time
        best |= {"rep": article["id"], "rep_at": at, "tokens": mine}
    best |= {"tier": article["tier"] if best["tier"] is None else min(best["tier"], article["tier"]), "seen": max(best["seen"], at), "n": best["n"] + 1}
    return best


def _sessions(items: DataFrame, key: str, width: int) -> DataFrame:
    """(key, block, opener): items (key, at, id, block) of one key that follow each other within `width` are a session; opener is
    the id of its first one. Two items of a block are never farther apart, so a block is in one session, and only blocks
    are put in order."""
    per = items.groupBy(key, "block").agg(F.min(F.struct("at", "id")).alias("lo"), F.max("at").alias("hi"))
    line = Window.partitionBy(key).orderBy("block")
    starts = F.coalesce(F.col("lo.at") - F.lag("hi").over(line) > width, F.lit(True))
    opener = F.last(F.when(F.col("starts"), F.col("lo.id")), ignorenulls=True).over(line)
    return per.withColumn("starts", starts).select(key, "block", opener.alias("opener"))


#: Taken from the numbers of clusters of earlier batches, so that they come before all articles and stay in their order.
_EARLIER = 4 * 10**18


def _reach(members: DataFrame, width: int, open_clusters: DataFrame | None = None) -> DataFrame:
    """Where and when a cluster can be joined: (headline, block, cluster_id, opened, since, until, lo, past, seen) of members (id, at, title, tier, block, cluster_id).

    A headline begins with the first member of a tier lower than all before, and lasts up to the next such one, it included. In
    a block the cluster is in reach after its first member there (lo), or until `width` after its last one in the block
    before (past). Grouped by cluster and tier, and by cluster and block: no cluster is ever put in order as a whole.
    open_clusters (cluster_id, title, tier, rep_at, seen, opened) come before all members, and are in reach `width` around seen.
    """
    order = F.struct("at", "id")
    rank = 2 * F.col("tier")
    if open_clusters is None:
        ranked = members.withColumn("rank", rank)
    else:  # one tier of an open cluster has its members who are earlier than the representative before it
        known = open_clusters.select("cluster_id", F.col("tier").alias("_tier"), "rep_at")
        ranked = members.join(known, "cluster_id", "left").withColumn("rank", F.when((F.col("tier") == F.col("_tier")) & (F.col("at") < F.col("rep_at")), rank - 1).otherwise(rank))
        ranked = ranked.select("cluster_id", "rank", "at", "id", "title").union(open_clusters.select("cluster_id", 2 * F.col("tier"), F.col("opened") - _EARLIER, "cluster_id", "title"))
    first = ranked.groupBy("cluster_id", "rank").agg(F.min(F.struct("at", "id", "title")).alias("f"))
    lower = Window.partitionBy("cluster_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cluster_id")
    heads = first.withColumn("until", F.min(F.struct("f.at", "f.id")).over(lower)).withColumn("opened", F.min(F.struct("f.at", "f.id")).over(whole))
    heads = heads.select("cluster_id", "opened", F.struct("f.at", "f.id").alias("since"), "until", F.col("f.title").alias("headline")).where("opened.id = cluster_id and (until is null or since < until)")
    per = members.groupBy("cluster_id", "block").agg(F.min(order).alias("lo"), F.max("at").alias("hi"))
    time, pair = F.lit(None).cast("long"), F.lit(None).cast("struct<at:bigint,id:bigint>")
    spans = per.select("cluster_id", "block", "lo", time.alias("past"), time.alias("seen")).union(per.select("cluster_id", F.col("block") + 1, pair, "hi", time))
    if open_clusters is not None:
        at = F.floor(F.col("seen") / width).cast("long")
        spans = spans.union(open_clusters.select("cluster_id", F.explode(F.array(at - 1, at, at + 1)), pair, time, "seen"))
    spans = spans.groupBy("cluster_id", "block").agg(F.min("lo").alias("lo"), F.max("past").alias("past"), F.max("seen").alias("seen"))
    met = spans.join(heads, "cluster_id").where((F.col("since.at") < (F.col("block") + 1) * width) & F.coalesce(F.col("until.at") >= F.col("block") * width, F.lit(True)))
    return met.select("headline", "block", "cluster_id", "opened", "since", "until", "lo", "past", "seen")


def clustered(articles: DataFrame, floor: float = 0.5, hours: float = 24, least_cosine: float = 0.88) -> DataFrame:
    """(id, cluster_id, representative) of articles (id, tokens, published_at, tier, and vector if there is one), oldest first.

    An article joins the cluster whose headline is most similar, at least `floor`, last seen no more than `hours` away,
    and with a cosine of `least_cosine` if both have vectors; else it opens one, named by its id. The headline is the
    representative's; a member of a lower tier than all before takes its place at once. `representative` is the cluster's in
    the end. Null times are the epoch, null tiers 99, null tokens none; ids are unique.
    """
    done = _decided(articles, None, floor, hours, least_cosine)
    shown = done.groupBy("cluster_id").agg(F.min(F.struct("tier", "at", "id")).alias("m")).select("cluster_id", F.col("m.id").alias("representative"))
    return done.select("id", "cluster_id").join(shown, "cluster_id").select("id", "cluster_id", "representative")


#: The columns of open clusters; times in microseconds; opened: numbers in the order in which they opened.
OPEN = "cluster_id bigint, tokens array<string>, tier int, representative bigint, rep_at bigint, seen bigint, opened bigint"


def continued(articles: DataFrame, open_clusters: DataFrame, floor: float = 0.5, hours: float = 24) -> tuple[DataFrame, DataFrame]:
    """D2, D3 for a batch of articles (id, tokens, published_at, tier) after others: (id, cluster_id) of each, and the clusters after them.

    open_clusters (columns OPEN) are as the batches before left them; all their articles count as earlier, whatever their
    times. A member of the representative's tier and earlier than it takes its place as well, which only a late one can be.
    """
    read = stored(articles.select("id", "tokens", "published_at", "tier"), "batch")
    before = stored(open_clusters, "open")
    done = stored(_decided(read, before, floor, hours, 1.0), "done")
    tokens = read.select(F.col("id").cast("long").alias("id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    old = before.select("cluster_id", F.col("tier").alias("_tier"), "rep_at")
    ranked = done.join(tokens, "id").join(old, "cluster_id", "left").withColumn("rank", 2 * F.col("tier") - F.when((F.col("tier") == F.col("_tier")) & (F.col("at") < F.col("rep_at")), 1).otherwise(0))
    new = ranked.groupBy("cluster_id").agg(F.min(F.struct("rank", "at", "id", "tokens", "tier")).alias("m"), F.max("at").alias("last"), F.min(F.struct("at", "id")).alias("first"))
    both = before.join(new, "cluster_id", "full_outer")
    better = F.col("tier").isNull() | (F.col("m.rank") < 2 * F.col("tier"))
    base = before.agg(F.coalesce(F.max("opened"), F.lit(0))).first()[0]
    low = done.agg(F.coalesce(F.min("at"), F.lit(0))).first()[0]
    pick = lambda old, fresh: F.when(better, F.col(fresh)).otherwise(F.col(old)).alias(old)
    after = both.select("cluster_id", pick("tokens", "m.tokens"), pick("tier", "m.tier"), pick("representative", "m.id"), pick("rep_at", "m.at"), F.greatest("seen", "last").alias("seen"), F.coalesce("opened", F.col("first.at") - F.lit(low - base - 1)).alias("opened"))
    return done.select("id", "cluster_id"), after


def _decided(articles: DataFrame, open_clusters: DataFrame | None, floor: float, hours: float, least_cosine: float) -> DataFrame:
    """(id, at, tier, cluster_id) of articles.

    The result of the sequence is the only assignment in which each article's cluster follows, by the rule, from the
    assignment of earlier ones. It is found by rounds: all articles decide at once from the last round's clusters, as they
    stood just before each of them, until nothing changes. After n rounds the first n are right for good, mostly after a few
    rounds all are. Titles without similar ones need no rounds: their clusters are their own sessions, which are also the
    first guess for the others. Every join is by (headline, day) or by id, so a title that is everywhere is one day's
    articles a key; a round ends in a written table.
    """
    width = int(hours * 3_600_000_000)
    has_vector = "vector" in articles.columns
    at = F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0).cast("long"))
    clean = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    read = stored(articles.select(F.col("id").cast("long").alias("id"), at.alias("at"), F.coalesce("tier", F.lit(99)).cast("int").alias("tier"), clean(F.col("tokens")).alias("tokens"), *(["vector"] if has_vector else [])), "articles")
    heads = None if open_clusters is None else open_clusters.select("cluster_id", clean(F.col("tokens")).alias("tokens"), "tier", "rep_at", "seen", "opened")
    named = read.select("tokens", "id") if heads is None else read.select("tokens", "id").union(heads.select("tokens", "cluster_id"))
    titles = stored(named.groupBy("tokens").agg(F.min("id").alias("title")), "titles")
    links = stored(jaccard_pairs(titles.select(F.col("title").alias("set_id"), "tokens"), floor), "links")
    near = links.select("a", "b", "jaccard").union(links.select("b", "a", "jaccard"))
    linked = near.select(F.col("a").alias("title"))
    if heads is not None:
        heads = stored(heads.join(titles, "tokens").select("cluster_id", "title", "tier", "rep_at", "seen", "opened"), "heads")
        linked = linked.union(heads.select("title"))
    block = F.floor(F.col("at") / width).cast("long")
    items = stored(read.join(titles, "tokens").join(linked.distinct().withColumn("linked", F.lit(True)), "title", "left").select("id", "at", "tier", "title", block.alias("block"), F.coalesce("linked", F.lit(False)).alias("linked")), "items")
    guess = items.join(_sessions(items, "title", width), ["title", "block"]).withColumnRenamed("opener", "cluster_id")
    guess = stored(guess.select("id", "at", "tier", "title", "block", "linked", "cluster_id"), "guess")
    if has_vector:  # without a similar title there is still one's own: vectors decide there as well
        open_items, alone = guess.drop("linked"), guess.limit(0)
    else:
        open_items, alone = guess.where("linked").drop("linked"), guess.where("not linked")
    same = open_items.select(F.col("title").alias("a"), F.col("title").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    probes = stored(open_items.select("id", "at", "title", "block").join(near.union(same).withColumnsRenamed({"a": "title", "b": "headline"}), "title").select("id", "at", "block", "headline", "jaccard"), "probes")
    state, mine = open_items, F.struct("at", "id")
    in_reach = (F.col("lo") < mine) | (F.col("at") - F.col("past") <= width) | (F.abs(F.col("at") - F.col("seen")) <= width)
    while True:
        met = probes.join(_reach(state, width, heads), ["headline", "block"]).where((F.col("since") < mine) & (F.col("until").isNull() | (mine <= F.col("until"))) & in_reach)
        if has_vector:
            vectors = read.select("id", "vector")
            met = met.join(vectors, "id").join(vectors.select(F.col("id").alias("cluster_id"), F.col("vector").alias("_v")), "cluster_id")
            met = met.where(F.col("vector").isNull() | F.col("_v").isNull() | (cosine(F.col("vector"), F.col("_v")) >= least_cosine))
        rank = F.struct("jaccard", (-F.col("opened.at")).alias("_a"), (-F.col("opened.id")).alias("_i"))
        best = met.groupBy("id").agg(F.max_by("cluster_id", rank).alias("best"))
        now = state.join(best, "id", "left").withColumn("best", F.coalesce("best", "id"))
        now, seen = counted(now, "round", moved="best <> cluster_id")
        state = stored(now.select("id", "at", "tier", "title", "block", F.col("best").alias("cluster_id")), "state")
        if not seen.get.get("moved"):
            return state.select("id", "at", "tier", "cluster_id").union(alone.select("id", "at", "tier", "cluster_id"))


def representatives(members: DataFrame) -> DataFrame:
    """A10: the representative of each cluster: lowest tier, then earliest, then least id. members: cluster_id, article_id, tier, published_at."""
    best = F.min(F.struct(F.coalesce("tier", F.lit(99)).alias("tier"), "published_at", "article_id"))
    return members.groupBy("cluster_id").agg(best.alias("m"), F.count("*").alias("articles"), F.min("tier").alias("tier_min")).select("cluster_id", F.col("m.article_id").alias("article_id"), "articles", "tier_min")
