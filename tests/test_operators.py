"""Operators, sources, sinks and streams on small frames."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidwork.functions.text import title_tokens
from braidwork.operators import decisions, graph, mappers, matching, stories, subgraph
from braidwork.operators.tables import counted
from braidwork.plans import params
from braidwork.sources import readers, sinks
from braidwork.streaming import stories as streams

NEWS = ["paint maker opens plant", "paint maker opens a plant", "bank cuts rates again", "bank cuts rates", "ship sinks off coast"]


def articles(spark):
    day = dt.datetime(2026, 1, 5)
    rows = [(i, t, day + dt.timedelta(hours=i)) for i, t in enumerate(NEWS)] + [(9, NEWS[0], day + dt.timedelta(hours=60))]
    return spark.createDataFrame(rows, "id long, title string, published_at timestamp").withColumn("tokens", title_tokens(F.col("title"))).withColumn("tier", F.lit(1))


def test_clusters(spark):
    got = {r["id"]: r["cluster_id"] for r in stories.clustered(articles(spark)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 9: 9}


@pytest.mark.parametrize(("seed", "span", "vectors"), [(3, 3000, True), (4, 3000, False), (5, 20000, False), (6, 90, False)])
def test_clusters_are_the_sequential_ones(spark, seed, span, vectors):
    """Random titles, tiers and times, ties and empty titles, with and without vectors, against the rule over all articles in one loop."""
    rng = random.Random(seed)
    rows, day = [], dt.datetime(2026, 1, 5)
    for i in range(150):
        tokens = [] if i % 40 == 0 else rng.sample("abcdefghij", rng.randint(2, 6))
        vector = None if i % 3 == 0 or not vectors else [rng.random(), rng.random()]
        rows.append((i, tokens, day + dt.timedelta(minutes=rng.randint(0, span)), rng.randint(1, 3), vector))
    open_, want = [], {}
    for i, tokens, at, tier, vector in sorted(rows, key=lambda r: (r[2], r[0])):
        best, score = None, -1
        for c in open_:
            jaccard = len(c["t"] & set(tokens)) / len(c["t"] | set(tokens)) if c["t"] | set(tokens) else 1.0
            if abs((at - c["seen"]).total_seconds()) <= 86400 and jaccard >= 0.5 and jaccard > score:
                v = c["v"]
                if not (v and vector) or sum(x * y for x, y in zip(v, vector, strict=True)) / math.hypot(*v) / math.hypot(*vector) >= 0.88:
                    best, score = c, jaccard
        if best is None:
            open_.append(best := {"id": i, "t": set(tokens), "seen": at, "tier": tier, "rep": i, "at": at, "v": vector})
        elif (tier, at) < (best["tier"], best["at"]):
            best |= {"t": set(tokens), "rep": i, "at": at}
        best |= {"tier": min(best["tier"], tier), "seen": max(best["seen"], at)}
        want[i] = best
    df = spark.createDataFrame(rows, "id long, tokens array<string>, published_at timestamp, tier int, vector array<double>")
    got = {r["id"]: (r["cluster_id"], r["representative"]) for r in stories.clustered(df if vectors else df.drop("vector")).collect()}
    assert got == {i: (c["id"], c["rep"]) for i, c in want.items()}
    assert 10 < len(open_) < 140 and any(c["rep"] != c["id"] for c in open_)


def test_hot_titles_are_grouped_by_day(spark):
    """Two similar titles by turns for 30 days, every third row of the table: clusters are the loop's, and no group of the plan holds more than a day of them."""
    day = dt.datetime(2026, 1, 5)
    titles = [list("abcdef"), list("abcdeg")]
    rows = [(i, titles[i % 2] if i % 3 else [f"t{i}", f"u{i}", "a"], day + dt.timedelta(minutes=15 * i), 3 - (i == 700) - (i == 900)) for i in range(2880)] + [(5000, titles[0], day + dt.timedelta(days=33), 1)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, published_at timestamp, tier int")
    got = {r["id"]: (r["cluster_id"], r["representative"]) for r in stories.clustered(df).collect()}
    open_, want = [], {}
    for i, tokens, at, tier in rows:
        want[i] = stories.step(open_, {"id": i, "tokens": tokens, "at": at.timestamp(), "tier": tier}, 0.5, 24, 0.88)
    assert got == {i: (c["id"], c["rep"]) for i, c in want.items()} and got[5000] == (5000, 5000)
    seen = df.selectExpr("id", "unix_micros(published_at) as at", "hash(tokens) as title", "tier", "floor(unix_micros(published_at) / 86400000000) as block", "0L as cluster_id")
    reach = stories._reach(seen, 86_400_000_000)
    assert reach.groupBy("headline", "block").count().agg(F.max("count")).first()[0] <= 2 and reach.count() <= 3 * 40


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "id long, tokens array<string>, published_at timestamp, tier int")
    assert stories.clustered(df).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (2, [], None, 1)], "id long, tokens array<string>, published_at timestamp, tier int")
    assert {tuple(r) for r in stories.clustered(odd).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_survivors_do_not_chain(spark):
    t = dt.datetime(2026, 1, 5)
    rows = [(1, 0b0, t), (2, 0b111, t + dt.timedelta(1)), (3, 0b111111, t + dt.timedelta(2)), (4, None, t)]
    got = {r["id"]: (r["kept"], r["duplicate_of"]) for r in stories.survivors(spark.createDataFrame(rows, "id long, simhash long, published_at timestamp")).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None)}


def test_merges_flatten(spark):
    e = spark.createDataFrame([(1, "ORG", None), (2, "ORG", None), (3, "ORG", 2), (4, "PERSON", None)], "id long, kind string, canonical_id long")
    s = spark.createDataFrame([(2, 1), (4, 1)], "a long, b long")
    assert {r["id"]: r["canonical_id"] for r in graph.flatten_merges(e, s).collect()} == {1: None, 2: 1, 3: 1, 4: None}


def test_walk_keeps_first_hop_under_floor(spark):
    e = spark.createDataFrame([(1, 1, 2, "PRODUCES", 0.1), (2, 2, 3, "SUPPLY_CHAIN", 0.9), (3, 1, 4, "X", 0.9), (4, 4, 3, "X", 0.85), (5, 3, 1, "X", 1.0)], "edge_id long, src long, dst long, edge_type string, weight double")
    w = graph.walks(spark.createDataFrame([(1,)], "start long"), e)
    assert {tuple(r["nodes"]) for r in w.collect()} == {(1, 2), (1, 4), (1, 4, 3)}


def test_closure_is_deep(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(53)], "src long, dst long")
    got = graph.closure(spark.createDataFrame([(0,)], "start long"), e).collect()
    assert sorted((r["node_id"], r["side"]) for r in got) == [(i, "descendant") for i in range(1, 54)]


def test_merge_caps_at_40(spark):
    c = spark.createDataFrame([(1, i, i / 100, i) for i in range(50)] + [(1, 49, 0.1, 99)], "start long, company_id long, recall_score double, ordinal long")
    got = graph.merged(c, ["start"]).collect()
    assert len(got) == 40 and min(r["company_id"] for r in got) == 10


def test_budget_skips_whole_connections(spark):
    c = spark.createDataFrame([(1, 1, 9, [1, 2, 3]), (1, 2, 8, [4, 5]), (1, 3, 7, [1])], "cluster_id long, connection_id long, score long, node_ids array<long>")
    assert {r["connection_id"]: r["kept"] for r in subgraph.kept_connections(c, 5).collect()} == {1: True, 2: False, 3: True}


def test_all_empty_keywords_meet_all(spark):
    texts = spark.createDataFrame([(1, ["ab"]), (2, ["c"])], "text_id long, texts array<string>")
    k = spark.range(1001).select(F.col("id").alias("keyword_id"), F.lit("").alias("keyword_norm"))
    assert matching.keyword_hits(texts, k).count() == 2002


def test_as_of_and_similar(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "k string, t int")
    facts = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t int, v string")
    got = matching.as_of(left, facts.withColumnRenamed("t", "ft"), "k", "t", "ft").collect()
    assert {(r["k"], r["t"], r["v"]) for r in got} == {("a", 1, None), ("a", 5, "y"), ("b", 1, None)}
    with pytest.raises(ValueError):
        matching.similar_spellings(left, left, 0.4)


def test_similar_spellings_is_complete(spark):
    import random

    rng = random.Random(3)
    xs = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in xs for b in xs if 1 - lev(a, b) / max(len(a), len(b)) >= 0.6 - 1e-12}
    d = spark.createDataFrame([(x,) for x in xs], "x string")
    assert {(r["x"], r["y"]) for r in matching.similar_spellings(d, d.withColumnRenamed("x", "y"), 0.6).collect()} == want


def test_mappers(spark):
    raw = spark.createDataFrame([("005930", "삼성전자", None, "유가증권", "19750611", None, " "), ("12", "x", None, "KOSPI", None, None, None), ("000001", "", "abbr", "KOSDAQ", "1", "KR1", "Tech")], "ISU_SRT_CD string, ISU_NM string, ISU_ABBRV string, MKT_NM string, LIST_DD string, ISU_CD string, IDX_IND_NM string")
    got = [(r["ticker"], r["name"], r["market"], r["listed_at"], r["sector"]) for r in mappers.company_rows(raw).orderBy("ticker").collect()]
    assert got == [("000001", "abbr", "KOSDAQ", None, "Tech"), ("005930", "삼성전자", "KOSPI", "1975-06-11", None)]
    c = spark.createDataFrame([(1, "노루홀딩스", "000320", "SK", ["옛이름"], ["B", "B"], True)], "company_id long, name string, ticker string, english string, former array<string>, brands array<string>, holding boolean")
    assert {(r["alias_type"], r["alias"], r["is_ambiguous"]) for r in mappers.expanded_aliases(c).collect()} == {("OFFICIAL", "노루홀딩스", False), ("TICKER", "000320", False), ("FORMER", "옛이름", False), ("SHORT", "노루", True)}
    h = spark.createDataFrame([(1, 0, "b", "50.5", None), (1, 1, "b", "10", None), (1, 2, "a", "9", None), (2, 0, "a", "1,000", None)], "company_id long, ordinal int, name_norm string, stake_end string, stake_begin string")
    k = spark.createDataFrame([(1, "a"), (2, "b")], "company_id long, name_norm string")
    assert {(r["company_id"], r["related_id"], r["weight"]) for r in mappers.affiliation_edges(h, k).collect()} == {(1, 2, 0.628), (2, 1, 0.3)}
    one = spark.range(1).select(mappers.rendered("Hi {{a}}{{zz}}: {{#each xs}} - {{n}} {{/each}}!", {"a": F.lit("you")}, {"xs": (F.array(F.struct(F.lit(1).alias("n")), F.struct(F.lit(2).alias("n"))), ["n"])}).alias("x")).first()["x"]
    assert one == "Hi you: - 1\n- 2!"
    q = spark.createDataFrame([(1, "100", "-2.5", "2", "7"), (2, "100", "2.5", "5", "7")], "company_id long, stck_prpr string, prdy_ctrt string, prdy_vrss_sign string, acml_vol string")
    assert [r["change_pct"] for r in mappers.quote_rows(q).orderBy("company_id").collect()] == [2.5, -2.5]
    j = mappers.judgement_rows(spark.createDataFrame([(1, '{"company_id":1,"verdict":"ACCEPT","connection_type":"MEME","business_relevance":10,"meme":5,"confidence":90,"explanation":"x"}'), (2, "no json"), (3, '{"company_id":1,"verdict":"ACCEPT","business_relevance":101}')], "run_id int, json string"))
    assert {r["run_id"]: r["valid"] for r in j.collect()} == {1: True, 2: False, 3: False}


def test_golden(spark):
    cases = spark.createDataFrame([("a", ["1"], ["2"], "MEME", None, None, True), ("b", ["9"], [], None, None, None, False), ("c", ["1"], [], "MEME", [0, 5], None, False)], "id string, must_include array<string>, must_exclude array<string>, expect_type string, br_range array<int>, score_range array<int>, needs_llm boolean")
    seen = spark.createDataFrame([("a", "1", "MEME", 10, 50), ("a", "2", "MEME", 10, 50), ("c", "1", "MEME", 10, 50)], "id string, ticker string, type string, business_relevance long, score long")
    out = decisions.golden_outcomes(cases, seen)
    assert {r["id"]: r["outcome"] for r in out.collect()} == {"a": "NEEDS_LLM_REVIEW", "b": "FAIL", "c": "FAIL"}
    assert decisions.pass_rate(out).first()[0] == 0 and decisions.pass_rate(out.limit(0)).first()[0] == 1
    t = spark.createDataFrame([("/api/v1/search/x", "GET"), ("/api/v1/discovery/requests", "POST"), ("/api/v1/home", "GET"), ("/x", "GET")], "p string, m string")
    assert [r["t"] for r in t.select(decisions.request_tier(F.col("p"), F.col("m")).alias("t")).collect()] == ["SEARCH", "DISCOVERY_REQUEST", "ANONYMOUS_READ", None]


def test_sources(spark):
    xml = '<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>http://a/1</link><pubDate>d1</pubDate></item></channel></rss><feed><entry><title>C</title><link rel="x" href="http://a/2"/><published>p</published></entry></feed>'
    got = readers.feed_items(spark.createDataFrame([(1, "o", xml)], "source_id int, outlet string, xml string")).collect()
    assert [(r["title"], r["link"], r["pub_date"]) for r in got] == [("A & B", "http://a/1", "d1"), ("C", "http://a/2", "p")]
    txt = "User-agent: me\nUser-agent: you # x\nDisallow: /a\n\nUser-agent: *\nDisallow: /\nDisallow:"
    rules = readers.robots_rules(spark.createDataFrame([("s", txt)], "site string, text string"))
    paths = spark.createDataFrame([("s", "/a/b"), ("s", "/c"), ("t", "/a")], "site string, path string")
    ok = lambda who: {(r["site"], r["path"]): r["allowed"] for r in readers.allowed(paths, rules, who).collect()}
    assert ok("You") == {("s", "/a/b"): False, ("s", "/c"): True, ("t", "/a"): True}
    assert ok("other")[("s", "/c")] is False
    assert readers.prompt("<!-- version: v1 | stage: S -->\n## SYSTEM\nbe\n## TOOL SCHEMA\n## USER (x)\n```\nhi {{a}}\n```")["user"] == "hi {{a}}"


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 1)], "id long, v string, n int")
    rows = spark.createDataFrame([(1, None, 5), (2, "b", 1), (2, "c", 2)], "id long, v string, n int")
    once = sinks.insert_ignore(t, rows, ["id"], ["v"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", 1), (2, "b", 1)}
    assert sinks.insert_ignore(once, rows, ["id"], ["v"]).count() == 2
    up = sinks.upsert(t, rows.where("v is null or v = 'b'"), ["id"], {"n": sinks.add})
    assert {tuple(r) for r in up.collect()} == {(1, "a", 6), (2, "b", 1)}
    assert sinks.delete(t, rows, ["id"]).count() == 0
    sinks.commit(t, str(tmp_path), 1)
    sinks.commit(up, str(tmp_path), 2)
    assert sinks.current(spark, str(tmp_path)).count() == 2
    n = sinks.ensure_nodes(spark.createDataFrame([(7, "A", 1, "old")], "node_id long, kind string, ref_id long, label string"), spark.createDataFrame([("A", 1, "new"), ("B", 1, "b")], "kind string, ref_id long, label string"))
    assert sorted((r["node_id"], r["kind"], r["label"]) for r in n.collect()) == [(7, "A", "old"), (8, "B", "b")]


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_streams(spark, small, tmp_path):
    path = str(tmp_path / "articles")
    articles(spark).withColumn("url", F.col("title")).coalesce(1).write.parquet(path)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    assert len(run_stream(streams.unique_articles(s), "urls")) == len(NEWS)
    got = {r["id"]: r["cluster_id"] for r in run_stream(streams.clustered(s.select("id", "tokens", "published_at", "tier"), F.lit(0)), "clusters")}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 9: 9}
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert streams.windowed_counts(e, "1 hour").agg(F.sum("n")).first()[0] == e.count()
    assert streams.session_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_guards_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(x, str) for x in entry.oracle_sql().values())


def test_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, check=True, timeout=120)


def test_trends_prices_and_seeds(spark, tmp_path):
    xml = "<rss><channel><item><title> A </title><ht:approx_traffic>200+</ht:approx_traffic><ht:news_item><ht:news_item_title><![CDATA[t1]]></ht:news_item_title><ht:news_item_url>u1</ht:news_item_url><ht:news_item_source>s1</ht:news_item_source></ht:news_item><ht:news_item><ht:news_item_title>t2</ht:news_item_title></ht:news_item></item><item><title>B</title><pubDate>d</pubDate></item></channel></rss>"
    a, b = readers.trend_topics(spark.createDataFrame([("KR", xml)], "geo string, xml string")).collect()
    assert (a["title"], a["traffic"], a["pub_date"], [tuple(n) for n in a["news_items"]]) == ("A", "200+", None, [("t1", "u1", "s1"), ("t2", "", "")])
    assert (b["title"], b["traffic"], b["pub_date"], b["news_items"]) == ("B", None, "d", [])
    with pytest.raises(Exception, match="without items"):
        readers.trend_topics(spark.createDataFrame([("KR", "<rss/>")], "geo string, xml string")).collect()
    (tmp_path / "p.json").write_text('{"company_id": 1, "output": {"stck_prpr": "100", "prdy_ctrt": "2.5", "prdy_vrss_sign": "5", "acml_vol": "7"}}\n{"company_id": 2}\n')
    q = mappers.quote_rows(readers.prices(spark, str(tmp_path / "p.json"))).collect()
    assert [(r["company_id"], r["price"], r["change_pct"], r["volume"]) for r in q] == [(1, 100, -2.5, 7)]
    (tmp_path / "s.json").write_text('{"concepts": [{"name": "steel", "kind": "THEME"}], "supply_edges": [{"src": "a", "dst": "b", "weight": 0.5}], "stop_entities": ["x", "y"]}')
    s = readers.seeds(spark, str(tmp_path / "s.json"))
    assert s["companies"].count() == 0 and s["concepts"].first()["name"] == "steel" and s["supply_edges"].first()["weight"] == 0.5 and s["stop_entities"].count() == 2


def test_parameters():
    assert [params.graph_nodes(x) for x in (None, "abc", 500, "7", 0)] == [60, 60, 200, 7, 1]
    assert params.stock_days(99) == 30 and params.meme_limit() == 10 and params.keyword(" ab ") == "ab" and len(params.request_text("x" * 40)) == 40
    for bad in ("", "  ", "x" * 31):
        with pytest.raises(ValueError, match="characters"):
            params.keyword(bad)


def test_stage_counters(spark):
    df, seen = counted(spark.range(10), "stage", even="id % 2 = 0", big="id > 7")
    assert df.count() == 10 and seen.get == {"rows": 10, "even": 5, "big": 2}


def test_joins_lose_no_pair(spark):
    """Near hashes and similar sets against all pairs, with clustered values, equal sets and every rarity."""
    rng = random.Random(1)
    base = [rng.getrandbits(32) for _ in range(30)]
    values = {b ^ sum(1 << k for k in rng.sample(range(32), rng.randint(0, 4))) for b in base for _ in range(8)}
    got = {(r["a"], r["b"]) for r in matching.near_hashes(spark.createDataFrame([(v,) for v in values], "simhash long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3} and len(got) > 100
    sets = {i: rng.sample("abcdefghijklmnopqrst", rng.choice((1, 2, 3, 5, 8, 13))) for i in range(150)}
    for floor in (0.5, 0.8):
        out = matching.jaccard_pairs(spark.createDataFrame(list(sets.items()), "set_id long, tokens array<string>"), floor).collect()
        real = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a in sets for b in sets if a < b}
        assert {(r["a"], r["b"]): pytest.approx(r["jaccard"]) for r in out} == {k: v for k, v in real.items() if v >= floor}


def test_mappers_of_pages(spark):
    row = spark.range(1).select(
        mappers.business_summary(F.lit("A"), F.lit("KOSPI"), F.lit("steel"), F.lit("19700101"), F.lit(None).cast("string")).alias("s"), mappers.disclosure_titles(F.sequence(F.lit(1), F.lit(12))).alias("d"), mappers.edge_label(F.lit("PRODUCES")).alias("e"),
        mappers.path_previews(F.array(F.array(F.struct(F.lit("x").alias("label")), F.struct(F.lit("y").alias("label")))), F.lit("A")).alias("p"), graph.concatenated(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("c"),
    ).first()
    assert row["s"].startswith("A은(는) steel 업종의 KOSPI 상장기업으로, 1970년") and len(row["d"]) == 10 and row["e"] == "생산" and row["p"] == ["x → y → A"] and row["c"] == [1, 2, 3]
    items = spark.createDataFrame([(1, "Out", "Head - Out", "HTTP://A.b/x/?utm_source=1&z=2", "bad date", "<p>lead</p>"), (1, "Out", "", "http://a.b", None, None)], "source_id long, outlet string, title string, link string, pub_date string, description string")
    a = mappers.article_rows(items, F.lit("2026-01-05 00:00:00").cast("timestamp")).collect()
    assert [(r["title"], r["url"], r["lead"], r["published_at"]) for r in a] == [("Head", "http://a.b/x?z=2", "lead", dt.datetime(2026, 1, 5))]
    e = mappers.analytics_events(spark.createDataFrame([("open", {"k": 1}, dt.datetime(2026, 1, 5)), ("other", {}, None)], "name string, payload map<string,int>, at timestamp"), ("open",)).collect()
    assert [(r["name"], r["payload"], r["at"]) for r in e] == [("open", '{"k":1}', "2026-01-05T00:00:00.000Z")]


def test_switched_off_edges_and_sources(spark):
    e = spark.createDataFrame([(1, 1, 2, "A", 0.9, True), (2, 2, 3, "A", 0.9, False), (3, 2, 4, "A", 0.9, True)], "edge_id long, src long, dst long, edge_type string, weight double, active boolean")
    assert sorted(r["nodes"] for r in graph.walks(spark.createDataFrame([(1,)], "start long"), e).collect()) == [[1, 2], [1, 2, 4]]
    f = spark.createDataFrame([(s, k, k, s == 2) for s in (1, 2, 3) for k in range(3)], "source_id long, at long, fetch_id long, failed boolean")
    robots = spark.createDataFrame([(1, True), (3, False)], "source_id long, allowed boolean")
    assert {r["source_id"]: (r["errors"], r["active"]) for r in decisions.source_health(f, 3, robots).collect()} == {1: (0, True), 2: (3, False), 3: (0, False)}


def rows_and_moved(spark, make):
    """(rows of a frame that is made and collected, rows that its stages wrote for later ones)."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    seen = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = max([seen().apply(i).stageId() for i in range(seen().size())], default=-1)
    rows = make().collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = seen()
    stages = [found.apply(i) for i in range(found.size())]
    return rows, sum(s.shuffleWriteRecords() + s.outputRecords() for s in stages if s.stageId() > before)


def test_copies_of_names_do_not_meet_one_by_one(spark):
    """40 copies of each name against 60 companies of each kind: the best alias of each pair, and rows between stages follow the copies, not their pairs."""
    names = ["steel ring", "steel ringx", "blue bolt", "q", "", None]
    entities = spark.createDataFrame([(i, n, n, n) for i, n in enumerate(names * 40)], "entity_id long, name string, norm string, spelled string")
    kinds = [["steel ring", "steel"], ["steel", "steel ring"], ["blue bold", "bl"], ["quiet", None], ["zinc", "steel"]]
    rows = [(1000 - 3 * c + k, c, t, t, t) for c in range(300) for k, t in enumerate(kinds[c % 5] + kinds[c % 5][:1])]
    aliases = spark.createDataFrame(rows, "alias_id long, company_id long, alias string, alias_norm string, alias_spelled string")
    columns = ["entity_id", "company_id", "alias_id", "rule", "recall_score"]
    got, moved = rows_and_moved(spark, lambda: matching.best_aliases(entities, aliases).select(*columns))
    want = matching.best_per_company(matching.alias_hits(entities, aliases)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) > 19000 and moved < len(got) / 3


def test_copies_of_texts_do_not_meet_one_by_one(spark):
    """2,000 texts of four kinds and 100 keywords of five; an id with several rows, and one without a text."""
    kinds = [["steel ring", None], ["bolt", "steel"], ["x"], [None]]
    texts = spark.createDataFrame([(i, kinds[i % 4]) for i in range(2000)] + [(1, ["xenon"]), (9000, None)], "text_id long, texts array<string>")
    words = ["st", "x", "", "teel", None]
    keywords = spark.createDataFrame([(i, words[i % 5]) for i in range(100)] + [(0, "ring"), (2, "x")], "keyword_id long, keyword_norm string")
    got, moved = rows_and_moved(spark, lambda: matching.keyword_hits(texts, keywords))
    have = [(i, t) for i in range(2000) for t in kinds[i % 4] if t is not None] + [(1, "xenon")]
    asked = [(i, words[i % 5]) for i in range(100) if i % 5 < 4] + [(0, "ring"), (2, "x")]
    every = {(t, k) for t in [*range(2000), 9000] for k, w in asked if w == ""}
    assert Counter(map(tuple, got)) == Counter({(t, k) for t, s in have for k, w in asked if w in s} | every) and len(got) > 80000 and moved < len(got) / 3


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Similar sets by tokens and in small blocks, tiles and bits that many tokens share, against all pairs; titles meet in blocks, not as rows."""
    rng = random.Random(2)
    monkeypatch.setattr(matching, "BLOCK_ROWS", (16, 16))
    monkeypatch.setattr(matching, "TILE", (5, 7))
    monkeypatch.setattr(matching, "LOOKUPS", 400)
    letters = [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]
    base = [rng.sample(letters, rng.choice((1, 2, 5, 20, 40, 300))) for _ in range(60)]
    sets = dict(enumerate(base + [[*x[len(x) // 4 :], *rng.sample(letters, len(x) // 4), *x[:1]] for x in base for _ in range(2)] + [[], []]))
    df = spark.createDataFrame(list(sets.items()), "set_id long, tokens array<string>")
    for floor in (0.3, 0.5, 0.8):
        real = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x in sets.items() for b, y in sets.items() if a < b and x and y}
        want = {k: pytest.approx(v) for k, v in real.items() if v >= floor}
        for blocks in (True, False, None):
            out = matching.jaccard_pairs(df, floor, blocks).collect()
            assert {(r["a"], r["b"]): r["jaccard"] for r in out} == want and len(out) == len(want) > 20
    assert matching.jaccard_pairs(df.limit(0), 0.5, True).count() == 0


def test_frequent_tokens_meet_in_blocks_and_rare_ones_as_rows(spark, monkeypatch):
    """1,500 titles of the same few letter pairs, 1.1 million pairs that nearly all share a rare token, never meet as rows; titles of many words do."""
    rng = random.Random(3)
    letters = [a + b for a in "etaoinsh" for b in "etaoinsh"]
    for tokens, size, way in ((letters, 20, "_met_by_tokens"), ([str(i) for i in range(30000)], 8, "_met_in_blocks")):
        sets = [frozenset(rng.sample(tokens, size)) for _ in range(1490)]
        sets += [frozenset([*sorted(x)[1:], "new"]) for x in sets[:10]]
        df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "set_id long, tokens array<string>")
        with monkeypatch.context() as m:
            m.delattr(matching, way)
            got = matching.jaccard_pairs(df).collect()
        want = {(i, j) for i, x in enumerate(sets) for j in range(i + 1, 1500) if 2 * len(x & sets[j]) >= len(x | sets[j])}
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) >= 10


def test_clusters_of_frequent_tokens_meet_in_blocks(spark, monkeypatch):
    """Titles of the same few letter pairs, a third of them near copies: clusters are the loop's, and no rows of titles meet."""
    rng, day = random.Random(4), dt.datetime(2026, 1, 5)
    letters = [a + b for a in "etaoinsh" for b in "etaoinsh"]
    titles = [rng.sample(letters, 20) for _ in range(200)]
    titles += [[*x[4:], *rng.sample(letters, 4)] for x in titles[:100]]
    rng.shuffle(titles)
    rows = [(i, t, day + dt.timedelta(minutes=20 * i), 1 + i * 7 % 3) for i, t in enumerate(titles)]
    monkeypatch.delattr(matching, "_met_by_tokens")
    got = {r["id"]: (r["cluster_id"], r["representative"]) for r in stories.clustered(spark.createDataFrame(rows, "id long, tokens array<string>, published_at timestamp, tier int")).collect()}
    open_, want = [], {}
    for i, tokens, at, tier in rows:
        want[i] = stories.step(open_, {"id": i, "tokens": tokens, "at": at.timestamp(), "tier": tier}, 0.5, 24, 0.88)
    assert got == {i: (c["id"], c["rep"]) for i, c in want.items()} and len(open_) < 270
