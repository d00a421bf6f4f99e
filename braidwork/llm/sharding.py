"""Balanced label propagation: documents move to their neighbours' shards under exact quotas."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import columns, free_names, null_safe, scratch, stored, table

SHARDS = 24
ROUNDS = 8
#: Rows are ranked in two steps: within cells of about this many rows, then by the cells' counts.
CELL_ROWS = 20_000


def _at(values: list[int], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (i + 1).cast("int"))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: a gapless rank from 0 within `by`, by (cell, order). rows needs `cell`.

    Only (by, cell) counts are summed along the cells, so no key's rows meet in one task.
    """
    counts = rows.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    offsets = counts.select(*by, "cell", (F.sum("n").over(Window.partitionBy(*by).orderBy("cell")) - F.col("n")).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(*order)) - 1
    return rows.withColumn("_r", within).join(offsets, [*by, "cell"]).withColumn(name, (F.col("_r") + F.col("offset")).cast("long")).drop("_r", "offset")


def flows(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the wanted[s][t] moves may happen so that no shard gains more than its room: those into a shard
    that would overflow are scaled down to its room plus what leaves it, until none overflows. Rows of `wanted` beyond
    the shards are of members that are nowhere yet."""
    f = [list(map(int, row)) for row in wanted]
    while True:
        over = False
        for t in range(len(room)):
            into, out = sum(row[t] for row in f), sum(f[t])
            if into > (most := room[t] + out):
                over = True
                for row in f:
                    row[t] = row[t] * most // into
        if not over:
            return f


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked (row, cell, grp, shard) with new shards: members of a group gather, no shard ever exceeds its quota of rows.
    A member without a label yet has shard -1.

    Each round, a group's best shard is the open one that holds most of its members, ties by a hash of both; without
    one its members without label go to an open shard by a hash. A member moves if it has no label, or its own shard
    holds fewer of the group (or as many, and loses the tie). How many move from each shard to each other follows from
    flows(), which lets full shards swap; the movers of a pair of shards are ranked, larger groups first. A shard that
    could take none of those who wanted in is closed to others from then on, so what a huge group has left gathers
    elsewhere. A round is one aggregate and two joins by group (the side of the members is split by adaptive execution
    where a group is huge) and ends in a written table; the driver sees counts of shard pairs only. Stops early when
    nothing wants to move.
    """
    shards, closed = len(quota), set()
    for k in range(rounds):
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
        room = [quota[s] - held.get(s, 0) for s in range(shards)]
        closed |= {s for s in range(shards) if not quota[s]}
        fresh = [s for s in range(shards) if room[s] > 0 and s not in closed]
        share = stored(linked.groupBy("grp", "shard").agg(F.count("*").alias("n")), "shares")
        score = F.struct(F.col("n"), F.xxhash64("grp", "shard").alias("tie"), F.col("shard").alias("shard"))
        best = share.groupBy("grp").agg(F.max(F.when(~F.col("shard").isin([-1, *closed]), score)).alias("to"), F.sum("n").alias("members"))
        own = share.select("grp", "shard", "n", score.alias("own"))
        other = _at(fresh, F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(len(fresh)))) if fresh else F.lit(None)
        target = F.coalesce("to.shard", F.when(F.col("shard") < 0, other)).cast("int")
        moves = own.join(best, "grp").where((F.col("shard") < 0) | (F.col("to").isNotNull() & (F.col("to") > F.col("own")))).select("grp", "shard", "n", target.alias("target"), "members")
        moves = stored(moves.where("target is not null"), "moves")
        wanted = [[0] * shards for _ in range(shards + 1)]
        for r in moves.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():  # one row a pair of shards
            wanted[r["shard"]][r["target"]] = r["n"]  # -1 is the last row
        if not any(map(any, wanted)):
            break
        granted = flows(wanted, room)
        closed |= {t for t in range(shards) if any(row[t] for row in wanted) and not any(row[t] for row in granted)}
        large_first = F.greatest(F.lit(0), 40 - F.floor(F.log2("members"))).cast("int") * 1024 + F.pmod("cell", F.lit(1024))
        movers = linked.join(moves.select("grp", "shard", "target", "members"), ["grp", "shard"]).withColumn("cell", large_first)
        most = _at([x for row in granted for x in row], F.when(F.col("shard") < 0, shards).otherwise(F.col("shard")) * shards + F.col("target"))
        movers = ranked(movers, ["shard", "target"], ["grp", "row"], "place").where(F.col("place") < most).select("row", "target")
        linked = stored(linked.join(movers, "row", "left").select("row", "cell", "grp", F.coalesce("target", "shard").alias("shard")), "labels")
    return linked


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards whose row counts differ by one at most.

    Documents with equal texts are linked. One of each group starts in a shard by its number; labels propagate from it
    under quotas of rows, and the others, which have no neighbours, fill what room is left. A group larger than a quota
    fills whole shards and goes on in further ones. `slot` counts a shard's rows from 0.

    A null text has size 8, and the crc32 of no bytes; null and empty texts are linked with each other. Null ids and
    repeated rows are rows like any other. An empty table gives no rows; extra columns are ignored.
    """
    placed = _placed(docs, shards, rounds)
    if placed is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _placed(docs: DataFrame, shards: int, rounds: int) -> DataFrame | None:
    """(doc_id, grp, size, text_crc32, shard, slot); None if there are no rows."""
    text = F.coalesce("text", F.lit(""))
    flat = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(1)).alias("g1"), F.xxhash64(text, F.lit(2)).alias("g2")
    )
    with scratch() as written:
        flat = stored(flat.withColumn("grp", F.struct("g1", "g2", "size")).drop("g1", "g2").withColumn("copy", F.lit(0)), "rows")
        n = flat.count()
        if not n:
            return None
        cells = max(1, -(-n // CELL_ROWS))
        # a row's number: gapless over the table, so rows that repeat each other are told apart
        numbered = ranked(flat.withColumn("cell", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(cells)).cast("int")).withColumn("all", F.lit(0)), ["all"], ["doc_id", "grp"], "row").drop("all", "copy")
        numbered = stored(numbered, "rows")
        quota = [n // shards + (s < n % shards) for s in range(shards)]
        # a table, so that the join below is one of two shuffles, whose hot groups adaptive execution splits
        multi = stored(numbered.groupBy("grp").agg(F.count("*").alias("members"), F.min("row").alias("seed")).where("members > 1").select("grp", "seed"), "groups")
        start = F.when(F.col("row") == F.col("seed"), F.pmod("row", F.lit(shards))).otherwise(-1).cast("int")
        linked = stored(numbered.join(multi, "grp").select("row", "cell", "grp", start.alias("shard")), "labels")
        linked = stored(propagate(linked, quota, rounds).where("shard >= 0"), "labels")
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
        ends = list(accumulate(quota[s] - held.get(s, 0) for s in range(shards)))
        free = numbered.join(linked.select("row"), "row", "left_anti").select("row", "cell").withColumn("all", F.lit(0))
        free = ranked(free, ["all"], ["row"], "k").select("row", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("k"))).alias("shard"))
        labels = stored(linked.select("row", "shard").union(free), "labels")
        for df in (numbered, labels):  # read by the rows that are returned
            written.remove(df)
    placed = numbered.join(labels, "row")
    return ranked(placed, ["shard"], ["row"], "slot").select("doc_id", "grp", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs, with all their columns, and each row's shard and slot. Columns of docs that have these two names go.

    Rows are matched by doc_id and two hashes of the text; of rows alike in these each gets one of their slots. Nulls,
    ties, repeated rows and empty tables as in balanced_shards().
    """
    id_, g1, g2, turn = free_names(docs, "id", "g1", "g2", "turn")
    alike = Window.partitionBy(id_, g1, g2)
    text = F.coalesce("text", F.lit(""))
    rest = docs.select(*columns(docs.drop("shard", "slot")), F.col("doc_id").cast("long").alias(id_), F.xxhash64(text, F.lit(1)).alias(g1), F.xxhash64(text, F.lit(2)).alias(g2))
    numbered = rest.withColumn(turn, F.row_number().over(alike.orderBy(F.lit(0))))
    spots = _placed(docs, shards, rounds)
    if spots is None:
        return rest.select(*columns(docs.drop("shard", "slot")), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    spots = spots.select(F.col("doc_id").alias(id_), F.col("grp.g1").alias(g1), F.col("grp.g2").alias(g2), "shard", "slot").withColumn(turn, F.row_number().over(alike.orderBy("shard", "slot")))
    return null_safe(numbered, spots, [id_, g1, g2, turn]).select(*columns(docs.drop("shard", "slot")), "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
