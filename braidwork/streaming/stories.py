"""Streams: event-time windows, keyed deduplication, and clustering of arriving articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidwork.operators.stories import OPEN, continued, step
from braidwork.operators.tables import stored
from braidwork.sources.sinks import commit, current


def unique_articles(articles: DataFrame, late: str = "48 hours") -> DataFrame:
    """K1 on a stream: the first article of each url; state older than the watermark goes."""
    return articles.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling (T9) or sliding (W8) counts and sums by event time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: runs of events with no gap longer than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def snapshots(quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The last quote of each company in each 5-minute window."""
    return quotes.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes").alias("w"), "company_id").agg(F.max_by("price", "ts").alias("price"), F.max_by("volume", "ts").alias("volume")).select("company_id", F.col("w.start").alias("start"), "price", "volume")


MEMBERS = "id bigint, cluster_id bigint, batch bigint"


class ClusterStream:
    """D2, D3 over a stream: clusters are a versioned table in `path`, which each micro-batch carries on by stories.continued().

    The work of a batch is joins over all executors, so no key and no task holds the stream's state. Version n of the
    tables `clusters` and `members` follows from version n - 1 and batch n alone and is written whole under its own
    name, so a batch that is run again after a failure, or replayed from the start, leaves the same tables.

    Articles more than `late_hours` older than the newest one of earlier batches are dropped, as a watermark would. Clusters
    not seen for close_hours before it can't be joined any more and leave the state; `members` keeps what they had.
    `then` is called with (batch's members, version) once a version is committed: the next stage of the chain. It has to
    be idempotent itself, as deliver() is.
    """

    def __init__(self, path: str, floor: float = 0.5, hours: float = 24, late_hours: float = 48, close_hours: float = 73, then: Callable[[DataFrame, int], None] | None = None) -> None:
        if close_hours < hours + late_hours:
            raise ValueError("a late article could still join a cluster that is closed so early")
        self.path, self.floor, self.hours, self.late, self.close, self.then = path.rstrip("/"), floor, hours, late_hours, close_hours, then

    def _version(self, spark: SparkSession, name: str, version: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{name}/v={version:012d}") if version >= 0 else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, version: int) -> None:
        """For writeStream.foreachBatch()."""
        spark = batch.sparkSession
        before = self._version(spark, "clusters", version - 1, OPEN + ", newest bigint")
        newest = before.agg(F.max("newest")).first()[0]
        rows = batch.select(F.col("id").cast("long").alias("id"), "tokens", "published_at", "tier")
        if newest is not None:
            rows = rows.where(F.coalesce(F.unix_micros("published_at"), F.lit(0)) >= int(newest - self.late * 3_600_000_000))
        rows = stored(rows.dropDuplicates(["id"]), "batch")
        done, after = continued(rows, before.drop("newest"), self.floor, self.hours)
        done = stored(done, "done")
        last = rows.agg(F.max(F.coalesce(F.unix_micros("published_at"), F.lit(0)))).first()[0]
        mark = max(x for x in (newest, last, 0) if x is not None)
        left = after.where(F.col("seen") >= int(mark - self.close * 3_600_000_000)).withColumn("newest", F.lit(mark).cast("long"))
        commit(done.withColumn("batch", F.lit(version).cast("long")), f"{self.path}/members", version)
        commit(left, f"{self.path}/clusters", version)
        if self.then:
            self.then(self._version(spark, "members", version, MEMBERS), version)

    def start(self, articles: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = articles.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def members(self, spark: SparkSession) -> DataFrame:
        """All articles that were let in: id, cluster_id, batch."""
        return spark.read.schema(MEMBERS).option("recursiveFileLookup", "true").parquet(f"{self.path}/members")

    def clusters(self, spark: SparkSession) -> DataFrame:
        """The open clusters of the newest version."""
        return current(spark, f"{self.path}/clusters").drop("newest")


def deliver(path: str, alerts: Callable[[DataFrame], DataFrame], key: list[str]) -> Callable[[DataFrame, int], None]:
    """The end of a chain: what `alerts` makes of a batch's members is sent once a key, of rows with one key the least. Version n
    holds what batch n was first to send, so running a batch again sends nothing twice."""

    def run(members: DataFrame, version: int) -> None:
        found = alerts(members)
        rest = [c for c in found.columns if c not in key]
        one = found.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else found.select(*key).distinct()
        if version > 0:
            sent = members.sparkSession.read.schema(f"_batch bigint, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.select(*key).schema)}").option("recursiveFileLookup", "true").parquet(path)
            one = one.join(sent.where(F.col("_batch") < version).select(*key), key, "left_anti")
        commit(one.withColumn("_batch", F.lit(version).cast("long")), path, version)

    return run


def clustered(articles: DataFrame, block: Column, floor: float = 0.5, hours: float = 24, close_hours: float = 25, late: str = "48 hours") -> DataFrame:
    """D2, D3 on a stream: (id, cluster_id, representative) of articles (id, tokens, published_at, tier); the representative is
    that of the moment.

    State is kept for each value of `block`: the clusters seen in the last close_hours. A block without articles for
    so long after the watermark loses its state. Articles of two blocks never join, so F.lit(0) is the exact rule, one
    state in one task; a finer block trades joins for parallel state.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = ("id", "tokens", "seen", "tier", "rep", "rep_at", "n")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clusters = [dict(zip(fields, x, strict=True)) for x in (state.get[0] if state.exists else [])]
        for c in clusters:
            c["tokens"] = frozenset(c["tokens"])
        out, newest = [], 0.0
        for r in pd.concat(list(batches)).sort_values(["published_at", "id"]).to_dict("records"):
            at = r["published_at"].timestamp()
            newest = max(newest, at)
            clusters = [c for c in clusters if at - c["seen"] <= close_hours * 3600]
            c = step(clusters, r | {"at": at}, floor, hours, 0.0)
            out.append((int(r["id"]), int(c["id"]), int(c["rep"])))
        state.update(([(int(c["id"]), sorted(c["tokens"]), c["seen"], int(c["tier"]), int(c["rep"]), c["rep_at"], c["n"]) for c in clusters],))
        state.setTimeoutTimestamp(int(max(newest * 1000, state.getCurrentWatermarkMs()) + close_hours * 3_600_000) + 1)
        yield pd.DataFrame(out, columns=["id", "cluster_id", "representative"])

    keyed = articles.withWatermark("published_at", late).withColumn("_block", block).groupBy("_block")
    kind = "open array<struct<id:bigint,tokens:array<string>,seen:double,tier:bigint,rep:bigint,rep_at:double,n:bigint>>"
    return keyed.applyInPandasWithState(run, "id long, cluster_id long, representative long", kind, "append", GroupStateTimeout.EventTimeTimeout)
