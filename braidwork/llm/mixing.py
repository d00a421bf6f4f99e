"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import columns, free_names, null_safe, partitions_for, scratch, stored, table, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is used more often than this.
MOST_REPEATS = 3
#: A source is cut into blocks of about BLOCK_DOCS documents, into LEAST_BLOCKS at least. Sums along a source's blocks
#: are taken within cells of CELL_BLOCKS blocks, then over the cells.
BLOCK_DOCS, LEAST_BLOCKS, CELL_BLOCKS = 256, 32, 4096
#: Output shards of a mix.
SHARDS = 16


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sources (source, source_size) with target: shares by weight of the sum of all sizes, none over most * source_size.

    The excess of capped sources goes to the others by weight until none is above: with sources in order of
    cap / weight, the capped ones are a prefix, and the first source at which the shared level stays under its own
    ratio ends it. One row a source is all that is ranked here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy()
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_after", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("cap_before")) / F.col("weight_after"))
    )
    free = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("share").alias("share")))).over(every)
    return ranked.withColumn("level", free["share"]).select(
        "source", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target")
    )


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, walked back; exact to about 1e-13."""
    x = n + 10.0
    back = F.lit(0.0)
    for i in range(1, 11):
        back = back + F.log(n + float(i))
    return x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - back


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """The number of good ones among `draws` of `total`, as the inverse distribution function at u in [0, 1).

    Exact up to rounding: sums the probabilities of the values within 12 standard deviations of the mean (beyond lies
    less than 1e-30) from the bottom and takes the first whose sum exceeds u.
    """
    good, total, draws = good.cast("double"), total.cast("double"), draws.cast("double")
    mean = F.when(total > 0, draws * good / total).otherwise(0.0)
    spread = 12 * F.sqrt(F.when(total > 1, mean * (1 - good / total) * (total - draws) / (total - 1)).otherwise(0.0)) + 12
    low = F.greatest(F.greatest(F.lit(0.0), draws + good - total), F.floor(mean - spread).cast("double"))
    high = F.least(F.least(draws, good), F.ceil(mean + spread).cast("double"))
    fixed = log_factorial(good) + log_factorial(total - good) - log_factorial(total) + log_factorial(draws) + log_factorial(total - draws)

    def step(s: Column, k: Column) -> Column:
        kd = k.cast("double")
        p = F.exp(s["fixed"] - log_factorial(kd) - log_factorial(s["good"] - kd) - log_factorial(s["draws"] - kd) - log_factorial(s["total"] - s["good"] - s["draws"] + kd))
        done = s["value"] >= 0
        sum_ = F.when(done, s["sum"]).otherwise(s["sum"] + p)
        value = F.when(done, s["value"]).when(sum_ > s["u"], k).otherwise(F.lit(-1).cast("long"))
        return F.struct(s["fixed"].alias("fixed"), s["good"].alias("good"), s["draws"].alias("draws"), s["total"].alias("total"), s["u"].alias("u"), sum_.alias("sum"), value.alias("value"))

    start = F.struct(fixed.alias("fixed"), good.alias("good"), draws.alias("draws"), total.alias("total"), u.alias("u"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("value"))
    return F.aggregate(F.sequence(low.cast("long"), high.cast("long")), start, step, lambda s: F.when(s["value"] >= 0, s["value"]).otherwise(high.cast("long")))


def splitting_tree(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, first, units) from units (source, units): how many units of each source each shard gets.

    The root holds every source's exact count. Each node halves its shards and draws the left child's counts source by
    source, each hypergeometric given what the earlier ones took, so the children's counts add up to the node's. A
    level is one pass over (node, source) rows, of which there are as many as sources times shards; a node's sources
    are kept as an array. `first` is the number of the source's units that lie in shards before.
    """
    order = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("source"), F.lit("")).alias("key"), "source", F.col("units").cast("long").alias("units"))))
    nodes = units.agg(order.alias("s")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "s")
    while shards > 1:
        mid = ((F.col("low") + F.col("high")) / 2).cast("int")
        total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["units"])
        left_total = F.floor(total * (mid - F.col("low")) / (F.col("high") - F.col("low")) + F.pmod(F.xxhash64(F.lit(seed), "low", "high"), F.lit(1000)) / 1000.0).cast("long")

        def draw(a: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.col("low"), F.col("high"), x["source"]), F.lit(1 << 52)) / float(1 << 52)
            k = hypergeometric(u, x["units"], a["total"], a["draws"])
            k = F.when(F.col("high") - F.col("low") > 1, k).otherwise(x["units"])
            return F.struct((a["total"] - x["units"]).alias("total"), (a["draws"] - k).alias("draws"), F.concat(a["got"], F.array(k)).alias("got"))

        begin = F.struct(total.alias("total"), F.when(F.col("high") - F.col("low") > 1, left_total).otherwise(total).alias("draws"), F.array().cast("array<bigint>").alias("got"))
        drawn = nodes.withColumn("got", F.aggregate("s", begin, draw, lambda a: a["got"]))
        left = F.struct(F.col("low").alias("low"), F.when(F.col("high") - F.col("low") > 1, mid).otherwise(F.col("high")).alias("high"), F.zip_with("s", "got", lambda x, k: F.struct(x["key"].alias("key"), x["source"].alias("source"), k.alias("units"))).alias("s"))
        right = F.struct(mid.alias("low"), F.col("high").alias("high"), F.zip_with("s", "got", lambda x, k: F.struct(x["key"].alias("key"), x["source"].alias("source"), (x["units"] - k).alias("units"))).alias("s"))
        nodes = stored(drawn.select(F.explode(F.when(F.col("high") - F.col("low") > 1, F.array(left, right)).otherwise(F.array(left))).alias("n")).select("n.*"), "tree")
        shards = (shards + 1) // 2
    per = nodes.select(F.col("low").alias("shard"), F.explode("s").alias("x")).select("shard", "x.source", "x.units")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("first", F.coalesce(F.sum("units").over(before), F.lit(0))).where("units > 0")


def before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (source, block, ...), one a block, with `name`: the sum of `value` over the source's lower blocks."""
    celled = rows.withColumn("cell", F.floor(F.col("block") / CELL_BLOCKS))
    cells = celled.groupBy("source", "cell").agg(F.sum(value).alias("all"))
    lower = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "cell", F.coalesce(F.sum("all").over(lower), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = null_safe(celled.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))), cells, ["source", "cell"])
    return summed.withColumn(name, (F.col(name) + F.col("offset")).cast("long")).drop("cell", "offset")


def planned(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target, passes, rest, blocks): a source passes whole through the mix `passes` times, and once
    more up to `rest` words; its documents are in so many blocks."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = F.floor("target").cast("long")
    return (
        null_safe(targets(sums.select("source", "source_size"), weights, most), sums.select("source", "n"), ["source"])
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
        .select("source", "source_size", "target", "passes", (goal - F.col("passes") * F.col("source_size")).alias("rest"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / BLOCK_DOCS)).cast("long").alias("blocks"))
    )


def drawn(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, to) from blocks (source, block, block_size, passes, rest): the units of each block as structs of unit,
    shard and words, the words that the unit offers from the block's first document on.

    A unit is a block in one pass. The exact numbers of units of the sources go down the splitting tree; a shard draws
    the next so many of each source's units, which are in permuted order, so that shards share none.
    """
    placed = before(blocks, "block_size", "begin")
    placed = placed.withColumn("uses", F.col("passes") + F.when((F.col("begin") < F.col("rest")) & (F.col("block_size") > 0), 1).otherwise(0))
    placed = stored(before(placed, "uses", "unit"), "units")
    tree = splitting_tree(placed.groupBy("source").agg(F.sum("uses").alias("units")), shards, seed)
    one = placed.where("uses > 0").select("source", "block", "block_size", "begin", "passes", "rest", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)).alias("pass"))
    one = one.select("source", "block", (F.col("unit") + F.col("pass")).alias("unit"), F.when(F.col("pass") < F.col("passes"), F.col("block_size")).otherwise(F.least(F.col("block_size"), F.col("rest") - F.col("begin"))).alias("words"))
    dealt = null_safe(one, tree, ["source"], extra=(F.col("unit") >= F.col("first")) & (F.col("unit") < F.col("first") + F.col("units")))
    return dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("unit", "shard", "words"))).alias("to"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """What a mix at the target weights takes of each document, and where its copies go.

    Every source's documents are permuted by a hash and cut into blocks; a source's target makes so many units of them
    (blocks in a pass), of which the last may offer a part of its words only. The splitting tree deals the units out
    to the shards; a document is taken as often as shards have drawn its block, and as far as their units' words reach,
    so the sum is the target rounded down and one document at most is cut. `place` orders a shard: a shuffle within it.

    Returns doc_id, source, turn (the permutation's hash), size, source_size, target, taken, parts (the shard and the
    words of each copy) and place. Null texts have size 0; sizes of 0 are taken 0 times. A null source is a source of
    its own, the last one. Ties and repeated rows are permuted by all their columns and share a place in the
    permutation only if they are alike, where either order gives the same rows. An empty table gives no rows; other
    columns are ignored. Sources are one row each where they are ranked and one array for each tree node: 5 MB for
    100,000 sources.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("turn")), "sizes")
    plan = stored(planned(sized, weights, most), "plan")
    placed = null_safe(sized, plan, ["source"]).withColumn("block", F.pmod(F.shiftright("turn", 20), F.col("blocks")))
    blocks = stored(placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest")), "blocks")
    to = drawn(blocks, shards, seed)
    within = Window.partitionBy("source", "block").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    final = null_safe(inside, to, ["source", "block"], "left")
    part = F.transform("to", lambda u: F.struct(u["shard"].alias("shard"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), u["words"] - F.col("ahead"))).alias("words")))
    final = final.withColumn("parts", F.filter(F.coalesce(part, F.array().cast("array<struct<shard:int,words:bigint>>")), lambda x: x["words"] > 0))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return final.select("doc_id", "source", "turn", "size", "source_size", "target", taken.alias("taken"), "parts", F.xxhash64(F.lit(seed + 1), "turn", "doc_id").alias("place"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, each as often as shards have drawn its document, laid out by shard
    and in shuffled order within it.

    A copy counts if at least half of the document's words are in it. Documents of size 0 stay once. Rows are matched
    by doc_id and a hash of source and text; rows alike in these share their copies, each the rounded mean. Null texts, sources and
    ids are handled as in mixed(); an empty table gives no rows; columns of any name pass through.
    """
    turn, source, id_, to, place = free_names(docs, "turn", "source", "id", "to", "place")
    with scratch() as written:
        plan = mixed(docs, weights, most, shards, seed)
        whole = F.transform(F.filter("parts", lambda x: 2 * x["words"] >= F.col("size")), lambda x: x["shard"])
        whole = F.when(F.col("size") > 0, whole).otherwise(F.array(F.pmod("place", F.lit(shards)).cast("int")))
        times = plan.groupBy("doc_id", "source", "turn").agg(F.count("*").alias("n"), F.flatten(F.collect_list(whole)).alias("all"), F.first("place").alias("place"))
        each = F.slice("all", 1, F.round(F.size("all") / F.col("n")).cast("int"))
        times = stored(times.select(F.col("source").alias(source), F.col("turn").alias(turn), F.col("doc_id").alias(id_), each.alias(to), F.col("place").alias(place)).where(F.size(to) > 0), "times")
        written.remove(times)  # read by the rows that are returned
    keyed = docs.withColumn(turn, F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn(source, F.col("source").cast("string")).withColumn(id_, F.col("doc_id").cast("long"))
    copies = null_safe(keyed, times, [id_, turn, source]).withColumn(to, F.explode(to))
    n = partitions_for(docs.sparkSession)
    return copies.repartition(n, to, F.pmod(place, F.lit(-(-n // shards)))).sortWithinPartitions(to, place).select(*columns(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source", "turn")
