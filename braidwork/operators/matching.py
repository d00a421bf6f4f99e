"""Joins by similarity, containment and time (J7-J12, J15, J17), as equi-joins on blocking keys."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import RECALL, Recall
from braidwork.functions.hashing import hamming
from braidwork.functions.scoring import alias_recall_score
from braidwork.operators.tables import stored


def alias_hits(entities: DataFrame, aliases: DataFrame, cfg: Recall = RECALL) -> DataFrame:
    """The rule and score of each (entity, alias) pair that any rule accepts.

    entities: entity_id, name, norm, spelled; aliases: alias_id, company_id, alias, alias_norm, alias_spelled. `spelled`
    is what edit similarity compares. Instead of comparing all pairs, candidates meet on keys that no rule can miss: the
    whole name, its first two letters for prefixes, the first letter of the raw texts, and for similarity a
    pair of neighbouring letters (see similar_spellings). Distinct spellings are compared once, whatever the number of aliases.
    """
    e = entities.select("entity_id", "name", "norm", "spelled")
    a = aliases.select("alias_id", "company_id", "alias", "alias_norm", "alias_spelled")
    ids = ["entity_id", "alias_id"]
    exact = e.join(a, e.norm == a.alias_norm).select(*ids)
    head = lambda c: F.left(c, F.lit(2))
    prefix = e.where(F.length("norm") >= 2).join(a.where(F.length("alias_norm") >= 2), head(e.norm) == head(a.alias_norm)).where(F.startswith("alias_norm", F.col("norm")) | F.startswith("norm", F.col("alias_norm"))).select(*ids)
    letter = e.join(a, (F.left(e["name"], F.lit(1)) == F.left(a["alias"], F.lit(1))) & (F.length("name") > 0) & (F.length("alias") > 0)).select(*ids)
    similar = similar_spellings(e.select(F.col("spelled").alias("x")).distinct(), a.select(F.col("alias_spelled").alias("y")).distinct(), cfg.similar_floor)
    near = e.join(similar, e.spelled == similar.x).join(a, F.col("y") == a.alias_spelled).select(*ids)
    pairs = exact.union(prefix).union(letter).union(near).distinct()
    full = pairs.join(e, "entity_id").join(a, "alias_id").join(similar, (F.col("spelled") == F.col("x")) & (F.col("alias_spelled") == F.col("y")), "left")
    is_prefix = (F.least(F.length("norm"), F.length("alias_norm")) >= 2) & (F.startswith("alias_norm", F.col("norm")) | F.startswith("norm", F.col("alias_norm")))
    rule = F.when(F.col("norm") == F.col("alias_norm"), "ALIAS_EXACT").when(is_prefix, "ALIAS_PREFIX").when(F.col("sim").isNotNull(), "ALIAS_JAMO_SIMILAR").otherwise("ALIAS_PREFIX")
    return full.withColumn("rule", rule).select("entity_id", "alias_id", "company_id", "rule", alias_recall_score(F.col("rule"), F.col("sim"), cfg).alias("recall_score"))


def similar_spellings(xs: DataFrame, ys: DataFrame, floor: float) -> DataFrame:
    """(x, y, sim): pairs of distinct texts with edit similarity of at least `floor`, and no others.

    With both ends marked, a text of n letters has n + 1 overlapping pairs, and an edit destroys at most two. Of n
    letters, at most (1 - floor) * n may be edited, which for floor > 0.5 leaves a pair in common as soon as
    n + 1 > 2 * (1 - floor) * n, that is always.
    Met pairs are cut by length and compared at last.
    """
    if floor <= 0.5:
        raise ValueError("texts under a similarity of one half need not share a pair of letters")
    marked = lambda c: F.concat(F.lit("\x02"), c, F.lit("\x03"))

    def keys(c: str) -> Column:
        t = marked(F.col(c))
        grams = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.array_distinct(grams)

    a = xs.where(F.length("x") > 0).select("x", F.explode(keys("x")).alias("k"))
    b = ys.where(F.length("y") > 0).select("y", F.explode(keys("y")).alias("k"))
    longest = F.greatest(F.length("x"), F.length("y"))
    met = a.join(b, "k").where(F.abs(F.length("x") - F.length("y")) <= (1 - floor) * longest + 1e-9).groupBy("x", "y").agg(F.count("*").alias("shared"))
    sim = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(1 - F.levenshtein("x", "y") / longest)
    return met.select("x", "y", sim.alias("sim")).where(F.col("sim") >= floor)


def best_per_company(hits: DataFrame, key: str = "entity_id") -> DataFrame:
    """A company's best hit; ties go to the smaller alias_id."""
    w = Window.partitionBy(key, "company_id").orderBy(F.desc("recall_score"), "alias_id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_aliases(entities: DataFrame, aliases: DataFrame, cfg: Recall = RECALL) -> DataFrame:
    """best_per_company of alias_hits, with columns entity_id, company_id, alias_id, rule, recall_score.

    A hit depends on texts alone. So names meet alias texts, and of each list of texts that companies have, in the order of
    alias_id, the best one is chosen; only then do names and lists become the entities and companies that have them.
    """
    named, written = ["name", "norm", "spelled"], ["alias", "alias_norm", "alias_spelled"]
    names, asked = _classes(entities.select("entity_id", *named), named, "entity_class")
    texts, known = _classes(aliases.select("alias_id", "company_id", *written), written, "text")
    hits = alias_hits(names.withColumnRenamed("entity_class", "entity_id"), texts.select(F.col("text").alias("alias_id"), F.col("text").alias("company_id"), *written), cfg)
    own = known.groupBy("company_id", "text").agg(F.min("alias_id").alias("alias_id"))  # of one text, the smaller alias_id
    own = own.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("alias_id", "text"))).alias("own"))
    lists, companies = _classes(own.select("company_id", F.transform("own", lambda x: x["text"]).alias("texts"), F.transform("own", lambda x: x["alias_id"]).alias("alias_ids")), ["texts"], "company_class")
    places = lists.select("company_class", F.posexplode("texts").alias("place", "text"))
    met = hits.select(F.col("entity_id").alias("entity_class"), F.col("alias_id").alias("text"), "rule", "recall_score").join(places, "text")
    best = met.groupBy("entity_class", "company_class").agg(F.min(F.struct((-F.col("recall_score")).alias("s"), "place", "rule")).alias("b"))
    pairs = best.select("entity_class", "company_class", "b.place", "b.rule", (-F.col("b.s")).alias("recall_score"))
    every = _members(pairs, companies, "company_class", asked, "entity_class")
    return every.select("entity_id", "company_id", F.element_at("alias_ids", F.col("place") + 1).alias("alias_id"), "rule", "recall_score")


def _classes(rows: DataFrame, by: list[str], number: str) -> tuple[DataFrame, DataFrame]:
    """The different values of the columns `by`, each with its number, and the rows with that number instead of them."""
    kinds = stored(rows.select(*by).distinct().withColumn(number, F.monotonically_increasing_id()), "classes")
    same = functools.reduce(Column.__and__, (rows[c].eqNullSafe(kinds[c]) for c in by))
    return kinds, stored(rows.join(kinds, same).select(*(rows[c] for c in rows.columns if c not in by), number), "members")


#: Members of a class that are in one task, on average.
MEMBERS = 1024


def _members(pairs: DataFrame, many: DataFrame, m: str, few: DataFrame, f: str) -> DataFrame:
    """Pairs of classes (columns m and f, and what goes along) as pairs of their members, rows of `many` with m and of `few` with f.

    A class of `many` is dealt out in parts of about MEMBERS rows and its pairs go to each part, so no class is one task. Nothing is shuffled
    after that if `few` can be broadcast, else rows once more by f: pairs of members are returned as they are made.
    """
    parts = F.ceil(F.count("*") / MEMBERS).cast("int")
    sizes = many.groupBy(m).agg(parts.alias("_parts"))
    ids = F.pmod(F.xxhash64(*many.columns), F.col("_parts")).cast("int")
    rows = many.join(sizes, m).withColumn("_part", ids).drop("_parts")
    met = stored(pairs.join(sizes, m).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"), "pairs")
    return dealt(met, m, "_part").join(dealt(rows, m, "_part"), [m, "_part"]).join(few, f).drop(m, f, "_part")


def concept_hits(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name_id, concept_id) where one normalised name (columns norm, concept_norm) contains the other; both of 2 letters or more.

    A text that contains another has the other's first 2-gram among its own, so both directions are equi-joins.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))
    n = names.where(F.length("norm") >= 2).select("name_id", "norm")
    c = concepts.where(F.length("concept_norm") >= 2).select("concept_id", "concept_norm")
    inside = n.withColumn("k", F.explode(grams("norm"))).join(c.withColumn("k", F.left("concept_norm", F.lit(2))), "k").where(F.contains("norm", F.col("concept_norm")))
    around = n.withColumn("k", F.left("norm", F.lit(2))).join(c.withColumn("k", F.explode(grams("concept_norm"))), "k").where(F.contains("concept_norm", F.col("norm")))
    return inside.select("name_id", "concept_id").union(around.select("name_id", "concept_id")).distinct()


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(text_id, keyword_id) where a text of the array `texts` contains `keyword_norm`. An empty keyword meets all.

    Different lists of texts meet different keywords by their first 2 letters (1 if they have one only); only then do they become the ids that
    have them.
    """
    mine = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.coalesce("texts", F.array().cast("array<string>")))), lambda x: x.isNotNull())))
    lists, owners = _classes(texts.groupBy("text_id").agg(mine.alias("texts")), ["texts"], "text_class")
    asked = keywords.where("keyword_norm is not null").groupBy("keyword_id").agg(F.array_sort(F.collect_set("keyword_norm")).alias("norms"))
    sets, askers = _classes(asked, ["norms"], "keyword_class")
    k = sets.select("keyword_class", F.explode("norms").alias("keyword_norm"))
    words = k.select("keyword_norm").distinct()
    t = lists.select("text_class", F.explode("texts").alias("t"))
    different = t.select("t").distinct()
    grams = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(F.col("t"), i, F.lit(n))))
    cut = different.where(F.length("t") > 0)
    long = cut.withColumn("g", F.explode(grams(2))).join(words.where(F.length("keyword_norm") >= 2).withColumn("g", F.left("keyword_norm", F.lit(2))), "g").where(F.contains("t", F.col("keyword_norm")))
    one = cut.withColumn("g", F.explode(grams(1))).join(words.where(F.length("keyword_norm") == 1), F.col("g") == F.col("keyword_norm"))
    hits = long.select("t", "keyword_norm").union(one.select("t", "keyword_norm"))
    every = lists.select("text_class").crossJoin(k.where("keyword_norm = ''").select("keyword_class"))
    pairs = hits.join(t, "t").join(k, "keyword_norm").select("text_class", "keyword_class").union(every).distinct()
    return _members(pairs, owners, "text_class", askers, "keyword_class").select("text_id", "keyword_id")


def as_of(left: DataFrame, facts: DataFrame, key: str, left_time: str, fact_time: str) -> DataFrame:
    """Each left row with the newest fact of its key that is not later; null facts where there is none.

    One sort by key and time over the union of both, and the last fact seen: no range join.
    """
    cols = [c for c in facts.columns if c not in (key, fact_time)]
    l = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(facts.select(F.struct(fact_time, *cols).alias("s")).schema["s"].dataType).alias("_f"))
    r = facts.select(key, F.col(fact_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(fact_time, *cols).alias("_f"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.union(r).withColumn("_last", F.last("_f", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", "_last.*")


def latest(facts: DataFrame, keys: list[str], time: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return facts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys to all shuffle partitions: small rows that meet many others in a join must not be put together in few tasks
    by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def near_hashes(hashes: DataFrame, budget: int = 3, bits: int = 32) -> DataFrame:
    """(a, b) of different `bits`-bit values within `budget` bits, a below b.

    Of 2 * budget bands, at most `budget` differ, so two such values agree on `budget` bands at least: they meet under
    each choice of so many bands (20 keys of about 16 bits for 3 of 32), and the first choice that both agree on
    reports them.
    """
    h = stored(hashes.select(F.col("simhash").alias("h")).where("h is not null").distinct(), "hashes")
    n = 2 * budget
    edges = [bits * i // n for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    choices = list(combinations(range(n), budget))
    key = lambda c: F.struct(F.lit(sum(1 << i for i in c)).alias("choice"), F.col("h").bitwiseAND(F.lit(sum(masks[i] for i in c)).cast("long")).alias("part"))
    e = h.select("h", F.explode(F.array(*[key(c) for c in choices])).alias("p")).select("h", "p.choice", "p.part")
    e = dealt(e, "choice", "part")
    met = e.select(F.col("h").alias("a"), "choice", "part").join(e.select(F.col("h").alias("b"), "choice", "part"), ["choice", "part"])
    x = F.col("a").bitwiseXOR(F.col("b"))
    agreed = sum((F.when(x.bitwiseAND(F.lit(m).cast("long")) == 0, 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    first = [sum([1 << i for i in range(n) if s >> i & 1][:budget]) for s in range(1 << n)]  # of each set of bands that agree, the lowest ones
    return met.where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= budget) & (F.element_at(F.array(*map(F.lit, first)), agreed + 1) == F.col("choice"))).select("a", "b")


def jaccard_pairs(sets: DataFrame, floor: float = 0.5, blocks: bool | None = None) -> DataFrame:
    """(a, b, jaccard) of different token sets with Jaccard of at least `floor`; sets: set_id, tokens (array).

    There are two ways, neither of which misses a pair. Where rare tokens tell sets apart, sets meet by them (_met_by_tokens); where they
    don't, as with the letter pairs of titles, all pairs are compared as blocks of bits (_met_in_blocks), at a small part of the
    cost of a met row. Which way is cheaper follows from how many of a few thousand sets would meet by tokens; `blocks` chooses
    without looking.
    """
    s = stored(sets.select("set_id", F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0), "sets")
    flat = s.select("set_id", F.explode("tokens").alias("t"))
    rarity = stored(flat.groupBy("t").agg(F.count("*").alias("df")), "rarity")
    n = s.count()
    if blocks is None:
        few = s.where(F.pmod(F.xxhash64("set_id"), F.lit(max(1, n // LOOKED_AT))) == 0)
        small, large = _prefixes(_by_rarity(few, rarity), floor)
        meet = small.groupBy("t").agg(F.count("*").alias("x")).join(large.groupBy("t").agg(F.count("*").alias("y")), "t")
        blocks = (meet.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0) > MEET_BY_TOKENS * few.count() ** 2
    if blocks:
        return _met_in_blocks(s, rarity, n, floor).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    pairs = _met_by_tokens(s, rarity, floor)
    side = lambda k: s.select(F.col("set_id").alias(k), F.col("tokens").alias(f"t{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    similar = both.withColumn("jaccard", common / (F.size("ta") + F.size("tb") - common)).where(F.col("jaccard") >= floor)
    return similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


#: Sets of which jaccard_pairs counts how many meet, and the share of their pairs up to which meeting by tokens is cheaper.
LOOKED_AT, MEET_BY_TOKENS = 4096, 0.02


def _by_rarity(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """sets with their tokens by rarity, and s0 to s3: 256 bits, of which each token sets one."""
    place = F.pmod(F.xxhash64("t"), F.lit(256))
    bit = lambda k: F.bit_or(F.when(F.floor(place / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    rows = sets.select("set_id", F.explode("tokens").alias("t")).join(rarity, "t").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("items"), *(bit(k).alias(c) for k, c in enumerate(BITS)))
    return rows.select("set_id", F.transform("items", lambda x: x["t"]).alias("tokens"), *BITS)


BITS = ["s0", "s1", "s2", "s3"]


def _prefixes(lists: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """Rows (set_id, n, r, t, bits) of the rarest tokens of lists that the smaller and the larger set of a similar pair share one of."""
    ranked = lists.select("set_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("r", "t"), *BITS)
    small = ranked.where(F.col("r") <= F.col("n") - F.ceil(2 * floor / (1 + floor) * F.col("n") - 1e-9))
    return small, ranked.where(F.col("r") <= F.col("n") - F.ceil(floor * F.col("n") - 1e-9))


def _met_by_tokens(s: DataFrame, rarity: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) that may be similar, by a join on rare tokens.

    Tokens are ordered by rarity. Of two sets so similar, the smaller one's first n - ceil(2 * floor / (1 + floor) * n) + 1 rarest
    tokens and the larger one's first n - ceil(floor * n) + 1 share one, and after the first that they share enough
    others must be left in both. Only those meet. A meeting set has 256 bits with it, one set for each token: a bit that
    the other lacks is a token that it lacks, which rules out nearly all pairs before the exact value decides.
    """
    small, large = _prefixes(stored(_by_rarity(s, rarity), "sets"), floor)
    a, b = (dealt(side, "t").select(F.col("set_id").alias(k), F.col("n").alias(f"n{k}"), F.col("r").alias(f"r{k}"), "t", *(F.col(c).alias(f"{c}{k}") for c in BITS)) for side, k in ((small, "a"), (large, "b")))
    need = floor / (1 + floor) * (F.col("na") + F.col("nb")) - 1e-9
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{c}{x}").bitwiseAND(F.bitwise_not(f"{c}{y}"))) for c in BITS), F.lit(0))
    met = a.join(b, "t").where(ordered & (F.col("na") >= floor * F.col("nb")) & (F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= need))
    return met.where((F.col("na") - lacks("a", "b") >= need) & (F.col("nb") - lacks("b", "a") >= need)).select("a", "b").distinct()


#: Sets of a block, at least and at most on average; between them, a table has about BLOCKS of them.
BLOCK_ROWS, BLOCKS = (8192, 65536), 32
#: The most frequent tokens, which have a bit of their own.
OWN = 192


def _met_in_blocks(s: DataFrame, rarity: DataFrame, n: int, floor: float) -> DataFrame:
    """Similar pairs (a, b, jaccard), out of all pairs whose sizes allow it.

    A set becomes 256 bits, one each for the 192 most frequent tokens and 64 that the others share, and the hashes of those others; a
    hash is one token's alone. Sets of about one size are dealt into blocks, and each pair of blocks is a group, in which a
    product of matrices tells how many bits two sets share. So no row is made for a pair but for the similar ones.
    """
    spark, kind, seed = s.sparkSession, s.schema["set_id"].dataType.simpleString(), 0
    hashed = lambda t: F.xxhash64(t, F.lit(seed))
    while rarity.groupBy(hashed("t")).count().where("count > 1").limit(1).count():
        seed += 1
    top = [r[0] for r in rarity.orderBy(F.desc("df"), "t").limit(OWN).select(hashed("t")).collect()]
    sized = s.select("set_id", F.transform("tokens", hashed).alias("hashes"))
    words = stored(sized.mapInArrow(_bits(top), f"set_id {kind}, n int, {', '.join(f'{c} long' for c in BITS)}, others array<long>"), "bits")
    step = lambda c: F.floor(F.log2(c) * 4 + 1e-9).cast("int")
    rows = min(max(n // BLOCKS, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    steps, first = [], 0
    for r in words.groupBy(step("n").alias("step")).count().orderBy("step").collect():  # four rows for each doubling of the size
        parts = -(-r["count"] // rows)
        steps.append((r["step"], first, parts))
        first += parts
    known = spark.createDataFrame(steps, "step int, first int, parts int")
    apart = int(math.log2(1 / floor) * 4 + 1e-9) + 1
    each = known.select("step", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block"))
    x, y = (each.select(F.col("step").alias(f"s{k}"), F.col("block").alias(k)) for k in ("x", "y"))
    meet = x.join(y, (F.col("x") <= F.col("y")) & (F.abs(F.col("sx") - F.col("sy")) <= apart)).select("x", "y")
    sides = meet.select(F.col("x").alias("block"), "x", "y").union(meet.where("x < y").select(F.col("y").alias("block"), "x", "y"))
    block = F.col("first") + F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    placed = words.withColumn("step", step("n")).join(F.broadcast(known), "step").withColumn("block", block)
    groups = placed.join(F.broadcast(sides), "block").select("x", "y", (F.col("block") == F.col("x")).alias("left"), "set_id", "n", *BITS, "others")
    return dealt(groups, "x", "y").groupBy("x", "y").applyInArrow(_close(floor), f"a {kind}, b {kind}, jaccard double")


def _bits(top: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (set_id, hashes of tokens) as (set_id, n, s0 to s3, others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(top, np.int64))
        known = np.array(top, np.int64)[order]
        for b in batches:
            n, hashes = pc.list_value_length(b.column(1)).to_numpy(), pc.list_flatten(b.column(1)).to_numpy()
            row, at = np.repeat(np.arange(len(n)), n), np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            own = known[at] == hashes
            bits = np.zeros((len(n), 256), bool)
            bits[row, np.where(own, order[at], OWN + (hashes & 63))] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~own], minlength=len(n)))])
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[~own]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), *(pa.array(words[:, k].copy()) for k in range(4)), others], names=["set_id", "n", *BITS, "others"])

    return run


#: Rows and columns of a product (32 MB), and tokens that are looked up at a time.
TILE, LOOKUPS = (1024, 8192), 1 << 21


def _close(floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The similar pairs (a, b, jaccard) of a pair of blocks.

    Sets of na and nb tokens and pa and pb bits that share q bits share q + min(na - pa, nb - pb) tokens at most, and need
    floor / (1 + floor) * (na + nb). The product is over 128 bits, with the mean in place of the least and all that depends on one set as two
    columns more, so that what is left is what isn't below zero. Then all 256 bits are counted, and at last the bits of
    frequent tokens and the other tokens that both have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        left, n = t.column("left").to_numpy(), t.column("n").to_numpy().astype(np.float64)
        ids, words = t.column("set_id").combine_chunks(), np.stack([t.column(c).to_numpy() for c in BITS], 1).view(np.uint64)
        rows, alone = np.flatnonzero(left), bool(left.all())
        columns = rows if alone else np.flatnonzero(~left)
        share, lost = floor / (1 + floor), n - np.bitwise_count(words).sum(1)
        slack, others = 1e-2 + 1e-6 * float(n.max(initial=0)), _Others(t.column("others"))
        for i in range(0, len(rows), TILE[0]):
            r = rows[i : i + TILE[0]]
            x = _halves(words[r], n[r], share, True)
            for j in range(i if alone else 0, len(columns), TILE[1]):
                c = columns[j : j + TILE[1]]
                p, q = np.divmod(np.flatnonzero((x @ _halves(words[c], n[c], share, False).T).ravel() >= -slack), len(c))
                p, q = r[p], c[q]
                may = np.minimum(n[p], n[q]) >= floor * np.maximum(n[p], n[q]) - 1e-9
                if alone:
                    may &= p < q
                p, q = p[may], q[may]
                may = np.bitwise_count(words[p] & words[q]).sum(1) + np.minimum(lost[p], lost[q]) >= share * (n[p] + n[q]) - 1e-9
                p, q = p[may], q[may]
                for k in range(0, len(p), others.pairs):
                    u, v = p[k : k + others.pairs], q[k : k + others.pairs]
                    common = np.bitwise_count(words[u, :3] & words[v, :3]).sum(1) + others.shared(u, v)
                    jaccard = common / (n[u] + n[v] - common)
                    yes = jaccard >= floor
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(u[yes])), ids.take(pa.array(v[yes])), pa.array(jaccard[yes])], names=["a", "b", "jaccard"])

    return run


class _Others:
    """Lists of hashes without repeats, and how many two of them share."""

    def __init__(self, lists: pa.ChunkedArray) -> None:
        self.n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        kinds, self.code = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
        self.kinds = max(1, len(kinds))
        self.keys = np.sort(np.repeat(np.arange(len(self.n)), self.n) * self.kinds + self.code)
        self.pairs = max(1, LOOKUPS // max(1, int(self.n.max(initial=0))))

    def shared(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        many = self.n[u]
        pair = np.repeat(np.arange(len(u)), many)
        code = self.code[np.arange(len(pair)) + np.repeat(self.start[u] - (np.cumsum(many) - many), many)]
        want = v[pair] * self.kinds + code
        at = np.searchsorted(self.keys, want)
        found = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want) if len(self.keys) else np.zeros(0, bool)
        return np.bincount(pair[found], minlength=len(u))


def _halves(words: np.ndarray, n: np.ndarray, share: float, first: bool) -> np.ndarray:
    """256 bits of each set folded to 128, a column of ones, and one with what n tokens need less half of what the fold may hide."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    out = np.ones((len(words), 130), np.float32)
    out[:, :128] = bits[:, :128] | bits[:, 128:]
    out[:, 129 if first else 128] = (n - out[:, :128].sum(1)) / 2 - share * n
    return out


#: Query vectors that meet the vectors in one pass, on average, and vectors that a task multiplies with them at a time (32 MB of products).
QUERY_BLOCK, ROWS = 4096, 1024


def best_vector(queries: DataFrame, vectors: DataFrame, floor: float = 0.0, block: int = QUERY_BLOCK) -> DataFrame:
    """M9: (query_id, vec_id, cosine): for each query vector the nearest other vector by cosine, `floor` at least; ties (to 12 digits) to the smaller id.

    Queries are made unit vectors once and sent to all tasks a block at a time, about `block` of them, whatever the
    table's size; each block is one pass, in which a task multiplies its Arrow batches by the block and keeps the best of
    each query. So a pass is matrix products, and its shuffle a row a task and query. Zero vectors, null ones and those of
    another length than the query's have cosine 0 with everything.
    """
    spark = vectors.sparkSession
    q = stored(queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct(), "queries")
    passes, parts = -(-q.count() // block), []
    for k in range(passes):
        rows = [(r[0], r[1]) for r in q.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == k).collect()]
        if rows:
            part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").mapInArrow(_nearest(spark.sparkContext.broadcast(rows)), "query_id long, vec_id long, cosine double")
            parts.append(stored(part, "nearest") if passes > 1 else part)
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, cosine double")
    best = functools.reduce(DataFrame.union, parts).where(F.col("cosine") >= floor).groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("vec_id")).alias("n"))).alias("m"))
    return best.select("query_id", (-F.col("m.n")).alias("vec_id"), F.col("m.cosine").alias("cosine"))


def _units(lists: list[list[float] | None], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        if x is not None and len(x) == width:
            out[i] = x
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _nearest(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(sent.value):
            by_width.setdefault(len(v or []), []).append(i)
        ids = np.array([k for k, _ in sent.value], np.int64)
        units = {w: _units([sent.value[i][1] for i in at], w) for w, at in by_width.items()}
        best, who = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            keys, lists = b.column(0).to_numpy(), b.column(1)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            for w, at in by_width.items():
                at = np.array(at)
                c = np.round(units[w] @ _batch(lists, w)[order].T, 12)
                c[keys[None, :] == ids[at][:, None]] = -np.inf
                top = c.argmax(1)  # the first, so the smallest id
                value, key = c[np.arange(len(at)), top], keys[top]
                better = (value > best[at]) | ((value == best[at]) & (key < who[at]))
                best[at[better]], who[at[better]] = value[better], key[better]
        hit = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(who[hit]), pa.array(best[hit])], names=["query_id", "vec_id", "cosine"])

    return run


def _batch(lists: pa.Array, width: int) -> np.ndarray:
    """The unit vectors of a batch, zero where the length is another; without a loop if all have the width."""
    if width and lists.null_count == 0 and len(lists) and (pc.list_value_length(lists).to_numpy() == width).all():
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)
        norm = np.sqrt((flat * flat).sum(1, keepdims=True))
        return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)
    return _units(lists.to_pylist(), width)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among nodes (node_id); a union of two semi-joins, never an OR join."""
    src = edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi")
    return src.union(edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*src.columns)).distinct()


def cache_hits(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Each request with the newest OK run of its (stage, prompt_version, input_hash); null run_id without one."""
    keys = ["stage", "prompt_version", "input_hash"]
    ok = latest(runs.where("status = 'OK'"), keys, "created_at", "run_id").select(*keys, "run_id")
    return requests.join(ok, keys, "left")


def unlisted(entities: DataFrame, stoplist: DataFrame) -> DataFrame:
    """entities whose name_norm is not on the stop list (name_norm); a null name stays."""
    return entities.join(stoplist.select("name_norm").distinct(), "name_norm", "left_anti").select(*entities.columns)
