"""Filter interaction audit: what each filter removes in any order of the filters, from sums over the edges of their subset lattice."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: The filters of the query; a filter's bit in a mask is its place here.
FILTERS = "ABCDE"


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), place)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: under 100 words; less than four words in five distinct; more than one
    character in ten a capital; a symbol. Works on the whole text inside the JVM; a long text's words are one array."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 100, F.lit(100).cast("long") * distinct < F.lit(80).cast("long") * n, capitals.cast("long") * 100 > F.length(text).cast("long") * 10, text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def repeated(rows: DataFrame, bit: int) -> DataFrame:
    """rows (key, digest, mask, n, ...) with `bit` set in the mask where a smaller key has the same digest.

    One row a digest, its least key, is joined on digest and key: what it meets is first, all else with a key is not. So a
    digest with a third of all rows is spread by key. A null key is neither smaller nor has smaller ones.
    """
    first = rows.where("key is not null").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    met = rows.join(first, ["digest", "key"], "left")
    late = F.col("first").isNull() & F.col("key").isNotNull()
    return met.withColumn("mask", F.when(late, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))).drop("first")


def lattice_edges(patterns: DataFrame, filters: str, counts: dict[str, Column]) -> DataFrame:
    """patterns (part, mask, n, ...) summed over the edges of the lattice: part, applied (bits of the filters applied before),
    next (the filter's place), kept, removed, redundant, unique_fails, and a sum of rows removed for each of counts.

    For k filters there are k * 2^(k-1) edges; each row of patterns goes to all of them, so patterns should be counts by mask.
    """
    k = len(filters)
    edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(i).alias("next")) for s in range(1 << k) for i in range(k) if not s >> i & 1))
    at = patterns.withColumn("edge", F.explode(edges)).select("*", "edge.*")
    bit = _bit(F.col("next"))
    fails, gone = F.col("mask").bitwiseAND(bit) > 0, F.col("mask").bitwiseAND(F.col("applied")) > 0
    tally = lambda cond, n: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    n = F.col("n")
    return at.groupBy("part", "applied", "next").agg(
        tally(~gone & ~fails, n).alias("kept"), tally(~gone & fails, n).alias("removed"), tally(gone & fails, n).alias("redundant"), tally(F.col("mask") == bit, n).alias("unique_fails"),
        *(tally(~gone & fails, c).alias(name) for name, c in counts.items()),
    )


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, step, applied, next: each step of each permutation of the filters is an edge on a path through the lattice."""
    letters = F.array(*map(F.lit, filters))
    out = spark.range(1).select(F.lit("").alias("filter_order"))
    for _ in filters:
        left = F.filter(letters, lambda x: ~F.contains(F.col("filter_order"), x))
        out = out.select("filter_order", F.explode(left).alias("x")).select(F.concat("filter_order", "x").alias("filter_order"))
    steps = out.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = lambda c: F.instr(F.lit(filters), c) - 1
    before = F.split(F.expr("substring(filter_order, 1, step - 1)"), "")
    applied = F.aggregate(F.filter(before, lambda x: x != ""), F.lit(0), lambda acc, x: acc.bitwiseOR(_bit(F.instr(F.lit(filters), x) - 1)))
    return steps.select("filter_order", "step", applied.alias("applied"), place(F.expr("substring(filter_order, step, 1)")).alias("next"))


def audited(patterns: DataFrame, filters: str, counts: dict[str, Column]) -> DataFrame:
    """part, filter_order, step, the sums of lattice_edges() and shapley, for each part, order and step; zeros included.

    Each order is a path of edges, so its steps are looked up, not counted again. shapley is the filter's removed over all
    orders: its edges' sums, each as often as orders go over it. Small tables from here on: parts times 80 and times 600 rows.
    """
    k = len(filters)
    edges = lattice_edges(patterns, filters, counts)
    paths = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k))), F.bit_count("applied") + 1)
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * paths).cast("long").alias("shapley"))
    steps = F.broadcast(orders(patterns.sparkSession, filters))  # k times k! rows: 600 for five filters
    found = edges.join(shares, ["part", "next"]).join(steps, ["applied", "next"])
    return found.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of the query over docs (doc_id, text, lang), with what labels (doc_id, quality, toxic) say of the rows removed.

    A map over the texts leaves a digest and a mask a row, in a table; the copies' filter and the labels join that table by
    keys that no group of copies shares. Rows are counted by (part, mask, labels) before they reach the lattice.

    * null text is empty; null lang is the part of the empty text; a null doc_id has no label, and neither is nor has a smaller id;
    * rows that repeat count as often as they are there, and are no copies of each other by their own id;
    * a document is good (toxic) if any of its labels says so; labels of other documents, and null labels, say nothing;
    * an empty table has no parts and gives no rows; other columns are not read, so their names don't matter;
    * a very long text is one array of its words in the JVM (some 60 bytes a word).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("key"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("mask"))
    rows = stored(read.groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = repeated(rows, 1 << FILTERS.index("E")).join(said, "key", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0))
    patterns = told.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * one("good")).alias("n_good"), F.sum(F.col("n") * one("toxic")).alias("n_toxic"))
    return audited(patterns, FILTERS, {"good_lost": F.col("n_good"), "toxic_lost": F.col("n_toxic")})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the five filters, in all orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS bad FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox FROM labels GROUP BY doc_id),
g AS (SELECT part, bad, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(tox), 0) AS n_tox FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bad),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT x AS p FROM letters UNION ALL SELECT p || x FROM o, letters WHERE length(p) < 5 AND NOT contains(p, x)),
s AS (SELECT p, k, instr('ABCDE', p[k]) AS now, [instr('ABCDE', c) FOR c IN string_split(p[1:k - 1], '') IF c <> ''] AS past FROM o, range(1, 6) r(k) WHERE length(p) = 5),
c AS (SELECT part, p, k, now, n, n_good, n_tox, bad[now] AS hit, len([i FOR i IN past IF bad[i]]) > 0 AS gone, bad[now] AND len([b FOR b IN bad IF b]) = 1 AS lone FROM s, g),
t AS (SELECT part, p, k, now, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN lone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND hit THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN n_tox ELSE 0 END) AS toxic_lost FROM c GROUP BY part, p, k, now)
SELECT part, p AS filter_order, CAST(k AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, now) AS BIGINT) AS shapley FROM t"""
