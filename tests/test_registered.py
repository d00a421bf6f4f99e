"""Registered functions against the DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from braidwork.functions import registered, similarity, text
from braidwork.functions.hashing import hamming
from braidwork.operators.mappers import expanded_aliases

COMPANIES = [
    (1, "노루홀딩스", "000320", "Noroo", ["옛 이름", "옛이름", None], ["A", "Brand-X"], True), (2, "대한", "000001", None, None, [], False),
    (3, "(주)한 샘", "000002", "LG", ["한샘"], None, False), (4, "지주", "000003", " ", [""], ["지주"], True), (5, None, None, None, None, None, None),
]
SCHEMA = "company_id long, name string, ticker string, english string, former array<string>, brands array<string>, holding boolean"


@pytest.fixture(scope="module", autouse=True)
def names(spark):
    assert registered.register(spark) == registered.register(spark)


def test_alias_expand(spark):
    c = spark.createDataFrame(COMPANIES, SCHEMA)
    c.createOrReplaceTempView("companies")
    got = spark.sql("SELECT company_id, x.* FROM companies, LATERAL alias_expand(name, ticker, english, former, brands, holding) x").collect()
    want = expanded_aliases(c).select("company_id", "alias", "alias_norm", "alias_type", "is_ambiguous").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and ("SHORT", "노루") in {(r["alias_type"], r["alias"]) for r in got}
    one = spark.sql("SELECT * FROM alias_expand('삼성지주', '1', NULL, array('a b c'), NULL, true)").collect()
    assert [(r["alias"], r["alias_type"]) for r in one] == [("삼성지주", "OFFICIAL"), ("1", "TICKER"), ("a b c", "FORMER"), ("삼성", "SHORT")]


def test_alias_expand_over_parts(spark, small):
    """All parts of the smallest tables, as the query alias_expand has them."""
    from braidwork.plans.catalog import QUERIES

    spark.read.parquet(f"{small}/part.parquet").createOrReplaceTempView("parts")
    got = spark.sql("SELECT p_partkey AS company_id, x.alias, x.alias_norm, x.alias_type, x.is_ambiguous FROM parts, LATERAL alias_expand(p_name, lpad(CAST(p_partkey AS STRING), 6, '0'), NULL, CAST(array() AS ARRAY<STRING>), array(p_brand, p_brand), false) x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["alias_expand"](spark, small).collect()))


def test_title_tokens(spark):
    titles = ["paint maker", "a", "", None, "한국 1등!", "é-b", "²x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")
    df.createOrReplaceTempView("titles")
    got = {}
    for r in spark.sql("SELECT id, x.* FROM titles, LATERAL title_tokens(title) x ORDER BY id, place").collect():
        got.setdefault(r["id"], []).append(r["token"])
    want = {r["id"]: r["t"] for r in df.select("id", text.title_tokens(F.col("title")).alias("t")).collect() if r["t"]}
    assert got == want and got[0][0] == "pa" and got[1] == ["a"]


def test_scalars(spark):
    df = spark.createDataFrame([("(주) Ab·C", 5, 6, ["a", "b"], ["b", "c"]), ("x's-\"y\"", -1, 0, [], []), (None, None, 1, ["a"], [])], "n string, a long, b long, x array<string>, y array<string>")
    df.createOrReplaceTempView("rows_")
    got = spark.sql("SELECT name_norm(n), hamming(a, b), jaccard(x, y) FROM rows_").collect()
    want = df.select(text.normalize_name(F.col("n")), hamming(F.col("a"), F.col("b")), similarity.jaccard(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert spark.sql("SELECT half_up(2.5D), half_up(-0.5D)").first()[:] == (3.0, 0.0)
