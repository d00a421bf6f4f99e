"""Analysis stages over landed outputs of a model (D15-D17): what each request becomes, and the rows that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.functions.text import long_quotes, normalize_entity
from braidwork.operators.matching import unlisted

#: Confidence of an edge from a story to an entity that it mentions (fixed value).
MENTION = 0.8


def run_status(over_cap: Column, error: Column, readable: Column, blocked: Column) -> Column:
    """The status of a model run, the first that holds."""
    return F.when(over_cap, "SKIPPED_COST_CAP").when(error.isNotNull(), "ERROR").when(~readable, "INVALID_JSON").when(blocked, "GUARDRAIL_BLOCKED").otherwise("OK")


def summaries(requests: DataFrame, cached: DataFrame, outputs: DataFrame, cap: float) -> DataFrame:
    """(cluster_id, summary, run_status, analysis) of requests (cluster_id, input_hash, day, at, sources array).

    A cached summary (input_hash, summary) needs no run (run_status is null). Others run in the order of `at` while the day's runs before
    cost less than `cap`; their landed outputs are (cluster_id, summary, cost, error). A summary with a verbatim quote of a
    source is blocked. Analysis is DONE with a summary, PENDING if the cap skipped it, else FAILED.
    """
    r = requests.join(cached.select("input_hash", F.col("summary").alias("known")).dropDuplicates(["input_hash"]), "input_hash", "left")
    r = r.join(outputs.select("cluster_id", F.col("summary").alias("new"), "cost", "error"), "cluster_id", "left")
    runs = F.col("known").isNull()
    before = Window.partitionBy("day").orderBy("at", "cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("spent", F.coalesce(F.sum(F.when(runs, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).over(before), F.lit(0.0)))
    text = F.coalesce("known", "new")
    r = r.withColumn("blocked", F.size(long_quotes(text, F.col("sources"))) > 0)
    status = run_status(F.col("spent") >= cap, F.col("error"), F.col("new").isNotNull(), F.col("blocked"))
    r = r.withColumn("run_status", F.when(runs, status))
    good = F.when(runs, F.col("run_status") == "OK").otherwise(~F.col("blocked"))
    analysis = F.when(good, "DONE").when(F.col("run_status") == "SKIPPED_COST_CAP", "PENDING").otherwise("FAILED")
    return r.select("cluster_id", F.when(good, text).alias("summary"), "run_status", analysis.alias("analysis"))


def extracted(mentions: DataFrame, stoplist: DataFrame, canonical: DataFrame) -> dict[str, DataFrame]:
    """Entities, their links to stories and MENTIONS edges from extracted mentions (cluster_id, name, kind, importance).

    Names are normalised, those on the stop list (name_norm) or empty go; aliases (name_norm, canonical_norm) take
    their canonical name. An entity is a (kind, name_norm) with its mentions in all; a story names an entity once, with its highest
    importance.
    """
    m = mentions.withColumn("name_norm", normalize_entity(F.col("name"))).where("name_norm <> ''")
    m = unlisted(m, stoplist).join(canonical, "name_norm", "left").withColumn("name_norm", F.coalesce("canonical_norm", "name_norm"))
    entities = m.groupBy("kind", "name_norm").agg(F.min("name").alias("name"), F.count("*").alias("mention_total"))
    links = m.groupBy("cluster_id", "kind", "name_norm").agg(F.max("importance").alias("importance"))
    edges = links.select("cluster_id", "kind", "name_norm", F.lit("MENTIONS").alias("edge_type"), F.col("importance").alias("weight"), F.lit(MENTION).alias("confidence"))
    return {"entities": entities, "links": links, "edges": edges}
