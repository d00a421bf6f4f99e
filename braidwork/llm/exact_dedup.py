"""Exact deduplication: binary-fuse filters of an immutable snapshot screen an incoming batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import fold_of, partitions_for, stored, table

#: Filters are cut by digest into parts of about this many keys.
PART_KEYS = 200_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: two multiply-xorshift rounds of the seeded key."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A 3-wise binary-fuse filter of 8-bit fingerprints over 64-bit keys: no false negatives, 1/256 false positives.

    Slots lie in overlapping segments; a key's three slots are in three consecutive ones. Building peels slots that
    one key holds, all such slots of a round at once, and fills the fingerprints in reverse order of peeling.
    """

    def __init__(self, seed: int, segment: int, slots: np.ndarray) -> None:
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        mask = np.uint64(segment - 1)
        base = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = base * np.uint64(segment)
        place = np.stack((first + (h & mask), first + np.uint64(segment) + ((h >> np.uint64(11)) & mask), first + np.uint64(2 * segment) + ((h >> np.uint64(21)) & mask)))
        return place.astype(np.int64), ((h ^ (h >> np.uint64(45))) >> np.uint64(3)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = len(keys)
        segment = 1 << max(2, min(11, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        size = max(1.13, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) * n
        count = max(1, int(np.ceil(size / segment)) - 2)
        for seed in range(1, 200):
            if seed % 8 == 0:
                count = count + count // 8 + 1
            place, mark = cls._places(keys, seed, segment, count)
            total = (count + 2) * segment
            flat = place.ravel()
            degree = np.bincount(flat, minlength=total)
            owner = np.zeros(total, np.int64)  # xor of the keys' numbers in a slot
            np.bitwise_xor.at(owner, flat, np.tile(np.arange(n), 3))
            order, left = [], n
            single = np.nonzero(degree == 1)[0]
            while len(single):
                who, at = np.unique(owner[single], return_index=True)
                spot = single[at]
                order.append((who, spot))
                left -= len(who)
                gone = place[:, who].ravel()
                np.subtract.at(degree, gone, 1)
                np.bitwise_xor.at(owner, gone, np.tile(who, 3))
                gone = np.unique(gone)
                single = gone[degree[gone] == 1]
            if left:
                continue
            slots = np.zeros(total, np.uint8)
            for who, spot in reversed(order):
                p = place[:, who]
                slots[spot] = mark[who] ^ slots[p[0]] ^ slots[p[1]] ^ slots[p[2]] ^ slots[spot]
            return cls(seed, segment, slots)
        raise ValueError("no seed peels this filter")

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.slots) or not len(keys):
            return np.zeros(len(keys), bool)
        p, mark = self._places(keys, self.seed, self.segment, len(self.slots) // self.segment - 2)
        return (self.slots[p[0]] ^ self.slots[p[1]] ^ self.slots[p[2]]) == mark


def sha256(text: Column) -> Column:
    """SHA-256 of the UTF-8 text (null: empty) in hex."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, sha, key): each text's digest and its first 64 bits."""
    return docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("sha")).withColumn("key", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))


def filters(snapshot: DataFrame, parts: int) -> DataFrame:
    """(part, seed, segment, slots): one filter for each part of the snapshot's distinct keys. Built once for a snapshot."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        part, key = t.column("part").to_numpy(), t.column("key").to_numpy().view(np.uint64)
        for p in np.unique(part):
            f = BinaryFuse.build(key[part == p])
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([f.seed]), pa.array([f.segment]), pa.array([f.slots.tobytes()], pa.binary())], names=["part", "seed", "segment", "slots"])

    keys = snapshot.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key").distinct()
    return keys.repartition(partitions_for(snapshot.sparkSession), "part").mapInArrow(build, "part int, seed long, segment long, slots binary")


def screened(batch: DataFrame, built: DataFrame, parts: int) -> DataFrame:
    """The distinct (sha, key) of the batch that the snapshot's filters let through: no digest of the snapshot is missed.

    Distinct digests are dealt out by part and meet their part's filter there; a filter is 9 bits a key and never
    leaves its task.
    """

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0).select(["sha", "key"])
        f = BinaryFuse(right.column("seed")[0].as_py(), right.column("segment")[0].as_py(), np.frombuffer(right.column("slots")[0].as_py(), np.uint8))
        return left.filter(pa.array(f.has(left.column("key").to_numpy().view(np.uint64)))).select(["sha", "key"])

    keys = batch.select("sha", "key", F.pmod("key", F.lit(parts)).cast("int").alias("part")).distinct()
    return keys.groupBy("part").cogroup(built.groupBy("part")).applyInArrow(test, "sha string, key long")


def exact_groups(snapshot: DataFrame, batch: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of snapshot and batch, two tables (doc_id, text).

    Incoming digests that pass the snapshot's filters join the snapshot's exact buckets by the whole digest; texts that
    meet there are compared byte by byte with their bucket's. The others are grouped among themselves, with the same
    comparison. Different texts with one digest are told apart by their bytes. Of equal texts the row with the largest
    doc_id stays. Copies are joined by a task's first one only, so a group may hold any share of the rows.

    A null text counts as empty. A null doc_id keeps its row, ranks below all ids, and is kept only if its group has
    no id (then keep_id is null and all rows of the group say kept). Rows with one doc_id and text twice count twice
    in group_size and both say kept. Empty tables and extra columns are fine.
    """
    old, new = stored(digests(snapshot, digest), "digests"), stored(digests(batch, digest), "digests")
    parts = max(1, -(-old.count() // PART_KEYS))
    passed = screened(new, stored(filters(old, parts), "filters"), parts)
    buckets = old.groupBy("sha").agg(F.count("*").alias("n_old"), F.max("doc_id").alias("id_old"))
    hits = stored(passed.join(buckets, "sha").select("sha", "n_old", "id_old"), "hits")
    fresh = new.groupBy("sha").agg(F.count("*").alias("n_new"), F.max("doc_id").alias("id_new"))
    sums = buckets.join(hits.select("sha"), "sha", "left_anti").select("sha", F.col("n_old").alias("n"), F.col("id_old").alias("id"))
    joined = fresh.join(hits, "sha", "left").select("sha", (F.col("n_new") + F.coalesce("n_old", F.lit(0))).alias("n"), F.greatest("id_new", "id_old").alias("id"))
    groups = stored(sums.union(joined), "groups")
    every = old.select("doc_id", "sha").union(new.select("doc_id", "sha"))
    texts = snapshot.select(F.col("doc_id").cast("long"), "text").union(batch.select(F.col("doc_id").cast("long"), "text"))
    full = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest(F.col("text")).alias("sha"))
    # Each task hands on one copy of a text, so a group's bytes meet without its members, however many there are.
    different = full.select("sha", "text").distinct().groupBy("sha").agg(F.count("*").alias("texts"))
    unequal = stored(different.where("texts > 1").select("sha"), "unequal")
    out = every.join(groups, "sha").select(
        "doc_id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    if unequal.isEmpty():
        return out
    # Texts that differ under one digest are grouped by their bytes instead.
    clashing = full.join(unequal, "sha")
    own = clashing.groupBy("sha", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("id"))
    apart = clashing.join(own, ["sha", "text"]).select("doc_id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return out.join(unequal, out.text_sha256 == unequal.sha, "left_anti").union(apart)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot is the half of documents with an even crc32 of the id, the batch is the other half."""
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs.where(fold_of(F.col("doc_id"), 2) == 0), docs.where(fold_of(F.col("doc_id"), 2) == 1))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
