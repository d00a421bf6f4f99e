"""SimHash fingerprints and their binary-trie self-join."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from braidwork.llm.common import bytes_of, columns, components, discard, free_names, partitions_for, scratch, stored, table

SEED = 42
#: A subtree with more fingerprints than this is split among tasks by its next SPLIT_BITS bits.
HOT_SUBTREE, SPLIT_BITS = 20_000, 8
#: Node pairs that are expanded at once; more wait on a stack.
FRONT = 1 << 20


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined word n-grams, repeats included, of the ASCII-lower-cased text; the whole sequence if it is shorter."""
    w = text.lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def hashed(items: list[bytes]) -> np.ndarray:
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(x, SEED) for x in items), np.uint64, len(items))


def majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are those that over half of h have; 0 for none. Counts in blocks, so memory stays small."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed bigint. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((majority(hashed(shingles(t, words))) for t in bytes_of(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def bands(budget: int) -> list[tuple[int, int]]:
    """(start, width) of budget + 1 bands of the 64 bits; two fingerprints within the budget agree on one band at least."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def turned(fp: Column, start: int) -> Column:
    """The fingerprint rotated so that the band that begins at bit start (from the top) leads."""
    return fp if not start else F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, 64 - start))


def trie_pairs(v: np.ndarray, roots: tuple[np.ndarray, np.ndarray], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted distinct fingerprints v that lie in one root range and differ in budget bits or fewer.

    A trie node at some depth is a range of v. Pairs of nodes descend together, one bit a step: children that took
    different bits add one to the pair's count, and pairs over the budget end. Pairs of single leaves are settled by
    their whole difference at once. Long fronts are halved and wait, so memory is bounded.
    """
    lo, hi = roots
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            stack += [(depth, alo[s], ahi[s], blo[s], bhi[s], diff[s]) for s in (slice(0, half), slice(half, None))]
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            rest = ~leaf
            alo, ahi, blo, bhi, diff = alo[rest], ahi[rest], blo[rest], bhi[rest], diff[rest]
        if not len(alo) or depth == 64:
            continue
        if depth not in ones:
            ones = {k: x for k, x in ones.items() if k > depth - 4} if len(ones) > 8 else ones
            ones[depth] = np.concatenate(([0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        parts = []
        for a0, a1, b0, b1, add, keep in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~same)):
            ok = (a1 > a0) & (b1 > b0) & (diff + add <= budget)
            if keep is not None:
                ok &= keep
            ok &= ~((a0 == b0) & (a1 - a0 == 1))
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], (diff[ok] + add).astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def linked(fps: DataFrame, budget: int = 2, hot: int = HOT_SUBTREE) -> DataFrame:
    """(a, b), a before b: all pairs of distinct values of fps.fp that differ in budget bits or fewer.

    The trie is laid out once for each of budget + 1 rotations; a rotation's subtrees below its leading band are dealt
    out to tasks, since pairs that agree on the band lie in one subtree. A pair is reported by the first band on which
    it agrees. A subtree of over `hot` fingerprints is dealt out again by its next bits: each fingerprint goes to its
    own part and, as a partner, to the parts within the budget.
    """
    spark, plan = fps.sparkSession, bands(budget)
    flat = fps.select("fp").where("fp is not null").distinct()
    rows = flat.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("band"), turned(F.col("fp"), s).alias("fp"), F.shiftrightunsigned(turned(F.col("fp"), s), 64 - w).alias("head")) for k, (s, w) in enumerate(plan)])).alias("x")
    ).select("x.*")
    rows = stored(rows, "subtrees")
    large = rows.groupBy("band", "head").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("band", "head", F.lit(True).alias("large"))
    near = [x for x in range(1 << SPLIT_BITS) if bin(x).count("1") <= budget]
    width = F.element_at(F.array(*[F.lit(w) for _, w in plan]), F.col("band") + 1)
    own = F.shiftrightunsigned(F.call_function("shiftleft", F.col("fp"), width), 64 - SPLIT_BITS).cast("int")
    flips = F.when(F.col("large"), F.array(*[F.lit(x) for x in near])).otherwise(F.array(F.lit(0)))
    dealt = (
        rows.join(large, ["band", "head"], "left")
        .withColumn("flip", F.explode(flips))
        .select("band", "head", "fp", F.when(F.col("large"), own.bitwiseXOR(F.col("flip"))).otherwise(-1).alias("part"), (F.col("flip") == 0).alias("home"))
    )
    n = partitions_for(spark)
    widths, starts = [w for _, w in plan], [s for s, _ in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        band, head, part, home = (held.column(k).to_numpy() for k in ("band", "head", "part", "home"))
        fp = held.column("fp").to_numpy().view(np.uint64)
        for k in range(len(plan)):
            for split in (False, True):
                at = np.nonzero((band == k) & ((part >= 0) == split))[0]
                if not len(at):
                    continue
                at = at[np.lexsort((fp[at], part[at], head[at]))]
                v, g = fp[at], np.stack((head[at], part[at].astype(np.int64)))
                cut = np.nonzero(np.any(g[:, 1:] != g[:, :-1], axis=0))[0] + 1
                lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
                many = hi - lo > 1
                for i, j in trie_pairs(v, (lo[many], hi[many]), widths[k], budget):
                    if split:  # a pair is met in the parts of both its ends, or in those between; the smaller end's own part reports it
                        i, j = np.where(v[i] < v[j], i, j), np.where(v[i] < v[j], j, i)
                        ok = home[at][i]
                        i, j = i[ok], j[ok]
                    s = np.uint64(starts[k])
                    a, b = ((x >> s) | (x << np.uint64(64 - s)) if s else x for x in (v[i], v[j]))
                    x = a ^ b
                    first = np.ones(len(x), bool)
                    for e in range(k):
                        first &= (x >> np.uint64(64 - starts[e] - widths[e])) & np.uint64((1 << widths[e]) - 1) != 0
                    a, b = a[first].view(np.int64), b[first].view(np.int64)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.repartition(n, "band", "head", "part").mapInArrow(run, "a long, b long")


def grouped(prints: DataFrame, budget: int = 2) -> DataFrame:
    """prints (doc_id, fp) with component_id: the smallest doc_id reachable over links of budget bits or fewer.

    Documents with one fingerprint are a group before any link is sought, so copies are never paired with each other.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    links = stored(linked(nodes, budget), "pairs")
    if links.isEmpty():
        return prints.join(nodes, "fp").withColumnRenamed("least", "component_id")
    roots = components(links)
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(nodes.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp")


def near_components(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document.

    Nulls and texts without words have the fingerprint 0 and link like any other. Repeated rows appear as often as
    they occur. A null doc_id keeps its row; it is never a component's id unless nothing else is in the component
    (then the id is null). An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    return grouped(prints, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-duplicate stage: words of a shingle, similarity of shingle sets, partial fingerprints of a text, shingles in each.
STAGE_WORDS, STAGE_SIMILARITY, STAGE_PARTS, STAGE_EACH = 5, 0.8, 16, 4


#: Bits of a text's sketch: the parities of its shingles by hash.
SKETCH = 256
#: Members of a bucket that meet all others in the next round are ROUND_GROWTH times those that did before; once at most
#: ALL_PAIRS pairs are left, all of them meet.
ROUND_GROWTH, ALL_PAIRS = 8, 1 << 20
#: Pairs of a bucket that one task makes.
TASK_PAIRS = 1 << 20


def least_prints(h: np.ndarray, parts: int, each: int) -> np.ndarray:
    """The different SimHashes of the `each` least of the sorted hashes h in each of `parts` classes."""
    if not len(h):
        return h
    kind = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    start = np.nonzero(np.diff(kind, prepend=-1))[0]
    size = np.minimum(np.diff(np.append(start, len(h))), each)
    first = np.cumsum(size) - size
    taken = order[np.repeat(start - first, size) + np.arange(size.sum())]
    ones = np.add.reduceat(np.unpackbits(h[taken].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
    return np.unique(np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view("<u8").ravel())


def partial_prints(texts: DataFrame, words: int = STAGE_WORDS, parts: int = STAGE_PARTS, each: int = STAGE_EACH) -> DataFrame:
    """(key, n, s0 to s3, fps) from texts (key, text): number, sketch and partial fingerprints of each text's distinct shingles.

    Shingles fall into `parts` classes by hash; a class's fingerprint is the SimHash of its `each` least shingles. A whole
    text's fingerprint moves by many bits when a fifth of its shingles differ, but then several of the samples are the
    same: with similarity 0.8, all 16 samples of 4 differ in 2 texts of 10,000. Two texts' sketches differ in no more
    bits than their sets do in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sketches, prints = [], [], []
            for t in bytes_of(b.column(1)):
                h = np.unique(hashed(shingles(t, words)))
                odd = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=SKETCH) & 1
                sizes.append(len(h))
                sketches.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
                prints.append(least_prints(h, parts, each).view(np.int64))
            s = np.array(sketches, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array(s[:, i]) for i in range(4)), pa.array(prints, pa.list_(pa.int64()))], names=["key", "n", "s0", "s1", "s2", "s3", "fps"])

    return texts.select(F.col("key").cast("long"), "text").mapInArrow(run, "key long, n long, s0 long, s1 long, s2 long, s3 long, fps array<long>")


@F.pandas_udf(T.DoubleType())
def shingle_similarity(a: pd.Series, b: pd.Series, words: pd.Series) -> pd.Series:
    """Jaccard similarity of two texts' sets of shingles; 1 for two without words."""
    known = functools.lru_cache(64)(lambda text, n: frozenset(shingles(text.encode(), n)))
    out = []
    for x, y, n in zip(a, b, words, strict=True):
        s, t = known(x, n), known(y, n)
        out.append(len(s & t) / len(s | t) if s or t else 1.0)
    return pd.Series(out)


def may_be_near(similarity: float) -> Column:
    """Whether the sketches and sizes of a (a_n, a_s0 ...) and b allow a Jaccard similarity of `similarity`; never false for a pair that has it."""
    most = (F.col("a_n") + F.col("b_n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-9)
    bits = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(4)), F.lit(0))
    return (F.abs(F.col("a_n") - F.col("b_n")) <= most) & (bits <= most)


def near_links(texts: DataFrame, words: int, similarity: float, budget: int, all_pairs: int = ALL_PAIRS) -> DataFrame | None:
    """(node, root) of the groups of near copies of texts (key, text), None without any.

    Texts meet if they share a partial fingerprint or have two within the budget. Every pair that meets is compared,
    unless its texts are in one group already: in rounds, the texts of a bucket that have most partners meet all
    others first, and buckets that have become one group are done. Pairs whose sketches differ in more bits than so
    similar texts can aren't compared word by word.
    """
    prints = stored(partial_prints(texts, words).distinct(), "prints")
    flat = prints.select("key", F.explode("fps").alias("fp"))
    sizes = stored(flat.groupBy("fp").agg(F.count("*").alias("members")), "sizes")
    close = stored(linked(sizes, budget), "close")
    shared = sizes.where("members > 1").select("fp")
    meets = shared.select(F.col("fp").alias("fa"), F.col("fp").alias("fb")).union(close.select("a", "b"))
    buckets = stored(sizes.join(shared.union(close.select("a")).union(close.select("b")).distinct(), "fp"), "buckets")
    rows = stored(flat.join(buckets, "fp"), "shared")
    hub = rows.groupBy("key").agg(F.sum("members").alias("hub"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("hub"), "key"))
    live = rows.select("fp", "key").join(hub, "key").withColumn("place", place).drop("hub").join(prints.drop("fps"), "key")
    live = stored(live.withColumn("root", F.col("key")), "members")
    met, upto, roots = 0, 1, None
    while True:
        stats = live.groupBy("fp").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
        side = lambda x: stats.select(F.col("fp").alias(f"f{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("members", "low", "high")))  # noqa: E731, B023
        mixed = F.least("low_a", "low_b") != F.greatest("high_a", "high_b")
        left = F.col("members_a") > F.lit(met) + F.when(F.col("fa") == F.col("fb"), 1).otherwise(0)
        meets = stored(meets.select("fa", "fb").join(side("a"), "fa").join(side("b"), "fb").where(mixed & left).select("fa", "fb", "members_a", "members_b"), "meets")
        work = meets.agg(F.sum((F.col("members_a") - met) * F.col("members_b"))).first()[0]
        if work is None:
            return roots
        if work <= all_pairs:
            upto = 2**31 - 1
        pairs_in = F.least(F.col("members_a"), F.lit(upto)) - met
        salts = F.ceil(pairs_in * F.col("members_b") / F.lit(TASK_PAIRS)).cast("int")
        blocks = stored(meets.withColumn("salts", F.least(salts, F.col("members_b").cast("int"))), "blocks")
        a = live.select(*(F.col(c).alias(f"a_{c}") for c in live.columns)).where((F.col("a_place") > met) & (F.col("a_place") <= upto))
        a = a.join(blocks.select("fa", "fb", "salts"), F.col("a_fp") == F.col("fa")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = blocks.select(F.col("fb").alias("b_fp"), F.col("salts").alias("b_salts")).distinct()
        b = live.select(*(F.col(c).alias(f"b_{c}") for c in live.columns)).join(dealt, "b_fp").withColumn("b_salt", F.pmod(F.xxhash64("b_key"), F.col("b_salts")).cast("int"))
        both = a.join(b, (F.col("fb") == F.col("b_fp")) & (F.col("salts") == F.col("b_salts")) & (F.col("salt") == F.col("b_salt")))
        new = (F.col("a_root") != F.col("b_root")) & ((F.col("fa") != F.col("fb")) | (F.col("b_place") > F.col("a_place")))
        pairs = stored(both.where(new & may_be_near(similarity)).select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct(), "candidates")
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        held = stored(texts.join(ends, "key").groupBy("key").agg(F.first("text").alias("text")), "texts")
        compared = pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        links = stored(compared.where(shingle_similarity("ta", "tb", F.lit(words)) >= similarity).select("a", "b"), "links")
        discard(held)
        found = not links.isEmpty()
        if found:
            roots = components(links if roots is None else links.union(roots.select("node", "root")))
        if upto == 2**31 - 1:
            return roots
        if found:
            now = live.drop("root").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
            left_in = meets.select(F.col("fa").alias("fp")).union(meets.select(F.col("fb").alias("fp"))).distinct()
            before, live = live, stored(now.join(left_in, "fp", "left_semi").select(*live.columns), "members")
            discard(before)
        met, upto = upto, upto * ROUND_GROWTH


def text_nodes(docs: DataFrame, key: str, sha: str, hashed_by: Callable[[Column], Column]) -> DataFrame:
    """docs with a bigint for each different text in column `key`: a hash, or another one where texts with different
    SHA-256 digests share it. Column `sha` is a helper."""
    named = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).withColumn(key, hashed_by(F.col(sha)))
    texts = stored(named.select(F.col(key).alias("k"), F.col(sha).alias("d")).distinct(), "texts")  # copies are one row from here
    clash = stored(texts.join(texts.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k", "left_semi"), "clash")
    discard(texts)
    if clash.isEmpty():
        return named
    turn, (other,) = F.row_number().over(Window.partitionBy("k").orderBy("d")), free_names(named, "other")
    again = stored(clash.withColumn("turn", turn).where("turn > 1").select(F.col("d").alias(sha), F.xxhash64("d", "turn").alias(other)), "clash")
    return named.join(again, sha, "left").withColumn(key, F.coalesce(other, key)).drop(other)


def one_of_each(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = STAGE_SIMILARITY, budget: int = 2, hashed_by: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of docs, with all their columns, that stay when of each group of near copies one document stays.

    Equal texts (by SHA-256) are one node. All nodes that share a partial fingerprint, or have two within the
    budget, are candidates of each other; a candidate pair is a link if the texts' shingle sets really are as similar
    as asked. Groups are the components of links; of each the row with the least doc_id stays.

    Null texts are one group with the empty ones. A null doc_id ranks last. Of rows with one doc_id and text one
    stays. An empty table gives no rows. Columns of any name pass through.
    """
    key, sha, id_, again_ = free_names(docs, "key", "sha", "id", "again")
    keyed = text_nodes(docs, key, sha, hashed_by).withColumn(id_, F.col("doc_id").cast("long"))
    texts = keyed.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch() as written:
        roots = near_links(texts, words, similarity, budget)
        ids = stored(keyed.select(F.col(key).alias("key"), F.col(id_).alias("id")), "ids")
        sums = ids.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        if roots is not None:
            sums = sums.join(roots, sums["key"] == roots.node, "left").select("key", "id", "n", F.coalesce("root", "key").alias("root"))
            # of a group, the node with the least id stays; nodes without id rank last
            rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
            sums = sums.join(sums.groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.key").alias("key")), "key")
        stay = stored(sums.select(F.col("key").alias(key), F.col("id").alias(again_)), "stay")
        many = ids.groupBy("key", "id").agg(F.count("*").alias("n")).where("n > 1")
        kept = keyed.join(stay, key).where(F.col(id_).eqNullSafe(F.col(again_))).drop(again_)
        again = stored(many.join(stay, (F.col("key") == F.col(key)) & F.col("id").eqNullSafe(F.col(again_))).select(F.col(key), F.lit(True).alias(again_)), "again")
        for df in (stay, again):  # read by the rows that are returned
            written.remove(df)
    if again.isEmpty():
        return kept.select(*columns(docs))
    kept = kept.join(again, key, "left")
    single = kept.where(F.col(again_).isNull()).select(*columns(docs))
    return single.union(kept.where(F.col(again_)).dropDuplicates([key]).select(*columns(docs)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
