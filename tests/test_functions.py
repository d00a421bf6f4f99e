"""Pinned values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from braidwork.functions import hashing, scoring, similarity, text, timeutil


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


def names(**k):
    return {a: L(b) for a, b in k.items()}


def test_names(spark):
    assert one(spark, text.normalize_name(L("(주) 노루-홀딩스 SK"))) == "노루홀딩스sk"
    assert one(spark, text.normalize_entity(L("[A] b.C (주)"))) == "AbC주"
    assert one(spark, text.jamo(L("원희"))) == "ㅇㅜㅓㄴㅎㅢ"
    assert one(spark, text.jamo(L("a닭"))) == "aㄷㅏㄹㄱ"
    assert one(spark, similarity.jamo_similarity(L("원희"), L("원익"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, text.first_syllable_equal(L(""), L(""))) is False
    assert one(spark, text.nfc(L("é"))) == "é"


def test_titles(spark):
    assert one(spark, text.display_title(L("[속보][단독] Ａ１　“x”  y - 매체"), L("매체"))) == 'A1 "x" y'
    assert one(spark, text.title_tokens(L("a b-c!"))) == ["ab", "bc"]
    assert one(spark, text.title_tokens(L("!"))) == []
    assert one(spark, text.title_tokens(L(" z"))) == ["z"]
    assert one(spark, text.lead_text(L("<p>a&nbsp; <b>b</b></p>"))) == "a&nbsp; b"
    assert one(spark, text.lead_text(L("<p> </p>"))) is None


def test_urls(spark):
    assert one(spark, text.canonical_url(L(" HTTPS://Ex.com/a/?b=2&utm_source=x&a=1&ref=q#f "))) == "https://ex.com/a?a=1&b=2"
    assert one(spark, text.canonical_url(L("no url "))) == "no url"
    escaped = {
        "http://a.com:80/뉴스/한글?q=한글&b=": "http://a.com/%EB%89%B4%EC%8A%A4/%ED%95%9C%EA%B8%80?b=&q=%ED%95%9C%EA%B8%80", "http://a.com/%eb%89%b4?x=a%2fb+c~": "http://a.com/%eb%89%b4?x=a%2Fb+c%7E",
        "http://a.com/a b?k": "http://a.com/a%20b?k=", "http://a.com/?x=100%&%75tm_source=1": "http://a.com/?x=100%25", "http://a.com:8080/😀?a=2&a=1": "http://a.com:8080/%F0%9F%98%80?a=2&a=1",
        "http://a.com/?a=b=c&&=v": "http://a.com/?=v&a=b%3Dc", "http://x.com/p/%zz": "http://x.com/p/%zz", "https://x.com:443/{a}?": "https://x.com/%7Ba%7D",
    }
    df = spark.createDataFrame([(k,) for k in escaped], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", text.canonical_url(F.col("u")).alias("c")).collect()} == escaped
    assert one(spark, text.canonical_url(L("http://x.y"))) == "http://x.y/"


def test_guards(spark):
    found = one(spark, text.forbidden_words(L("매수 그리고 매수, 투자 추천·자문이 아닙니다. 추천")))
    assert [(x["word"], x["index"]) for x in found] == [("추천", 27), ("매수", 0), ("매수", 7)]
    assert one(spark, text.is_dangerous(L("공장 화재"))) is True
    assert one(spark, text.is_negative_person(L(None).cast("string"))) is False
    s = "abcdefghijklmnopqrstuvwxyz"
    assert one(spark, text.long_quotes(L(s), F.array(L("__" + s[3:24] + "__")))) == [s[3:24]]
    assert one(spark, text.long_quotes(L("short"), F.array(L("short")))) == []


def test_hashes(spark):
    h = 2166136261
    for c in "ab":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    assert one(spark, hashing.fnv1a(L("ab"))) == h
    assert one(spark, hashing.simhash32(F.array(L("ab")))) == h
    assert one(spark, hashing.simhash32(F.array().cast("array<string>"))) == 0
    assert one(spark, hashing.hamming(L(5), L(6))) == 2
    lists = [["ab", "bc", "c😀"], [], None, ["", None, "é"], ["ab"] * 3 + ["x"]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, t array<string>").coalesce(1)
    hashes = {t: one(spark, hashing.fnv1a(L(t))) for ts in lists if ts for t in ts if t is not None}
    for r in df.select("k", hashing.simhash32("t").alias("h")).collect():
        hs = [hashes[t] for t in lists[r["k"]] or [] if t is not None]
        assert r["h"] == (None if lists[r["k"]] is None else sum(1 << b for b in range(32) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))


def test_sets_and_vectors(spark):
    a, b = F.array(L("a"), L("b"), L("c")), F.array(L("b"), L("c"), L("d"))
    e = F.array().cast("array<string>")
    assert one(spark, similarity.jaccard(a, b)) == 0.5
    assert one(spark, similarity.jaccard(e, e)) == 1
    assert one(spark, similarity.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0)))) == pytest.approx(0.7071067811865475)
    assert one(spark, similarity.cosine(F.array(L(1.0)), F.array(L(1.0), L(1.0)))) == 0


def test_scores(spark):
    s = names(business_relevance=10, keyword_match=95, supply_chain=0, market_reaction=81, meme=87, confidence=90)
    no = L(False)
    assert one(spark, scoring.connection_score(s, L("NAME_MATCH"), L(2), no, no, no)) == 71
    km = lambda exact, e, a, t, amb=False: one(spark, scoring.keyword_match(L(True), L(exact), L(e), L(a), L(t), L(amb)))
    assert km(False, "원희", "원익", "OFFICIAL") == 69
    assert km(True, "노루", "노루", "SHORT") == 95
    assert km(True, "노루", "노루", "OFFICIAL", True) == 75
    assert km(True, "가", "가", "OFFICIAL") == 60
    assert one(spark, scoring.keyword_match(no, no, L("a"), L("b"), L("SHORT"), no)) == 0
    assert one(spark, scoring.meme(L(85), L(10), L(81), L("NAME_MATCH"))) == 86
    assert one(spark, scoring.meme(L(0), L(90), L(0), L("MEME"))) == 50
    assert one(spark, scoring.confidence(F.array(L(0.95), L(0.99)), L(95))) == 90
    assert one(spark, scoring.confidence(F.array(L(0.9), L(0.3), L(0.95)), L(100))) == 30
    assert one(spark, scoring.market_reaction(L(1.0), L(0.0))) == 50
    assert one(spark, scoring.market_reaction(L(4.0), L(0.0))) == 80
    assert one(spark, scoring.supply_chain(F.array(L("PRODUCES"), L("SUPPLY_CHAIN")), F.array(L(1.0), L(0.85)))) == 85
    assert one(spark, scoring.relevance_band(L(40))) == "MEDIUM"
    assert one(spark, scoring.graph_recall_score(L("SUPPLY_DICT"), L(0.765))) == pytest.approx(0.75 * 0.765)
    assert one(spark, scoring.heat(L(4), L(1), L(2))) == 65.0
    assert one(spark, scoring.review_state(L(80), L(1), L(1), L(1), no, no)) == "PENDING"


def test_times(spark):
    at = lambda x: L(dt.datetime.fromisoformat(x)).cast("timestamp")
    assert one(spark, timeutil.trade_date(at("2026-01-05T16:00:00"))) == dt.date(2026, 1, 6)
    assert one(spark, timeutil.quiet_hours(at("2026-01-05T13:00:00"))) is True
    assert one(spark, timeutil.market_status(at("2026-01-05T00:00:00"))) == "OPEN"
    assert one(spark, timeutil.market_status(at("2026-01-01T00:00:00"))) == "CLOSED"
    assert one(spark, timeutil.market_status(at("2026-01-04T23:10:00"))) == "PRE_MARKET"
    assert one(spark, timeutil.relative_time(at("2026-01-05T00:00:00"), at("2026-01-05T02:30:00"))) == "2시간 전"
    assert one(spark, timeutil.fixed_window(at("1970-01-01T00:02:01"), 60)) == 2
