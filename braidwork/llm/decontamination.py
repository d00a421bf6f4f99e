"""Benchmark decontamination: seeds that no leak can lack find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import table

#: Items with fewer words leak only where they stand whole: one of their words says nothing.
SEED_WORDS = 3
#: A seed is a pair of words that lie this far apart, in the item and in the text: a link of two matches and one error at most.
STEPS = (1, 2)
#: Seeds of an item that must meet within a leak's length before it is aligned (fewer if a leak is sure of fewer).
MEET = 3
#: Alignment scores: a pair of equal words, of unequal words, a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's highest possible score from which a passage is a leak.
LEAK = 0.5
#: The test items are taken in blocks of at most this many bytes of text, which bounds what tasks get.
BLOCK_BYTES = 16 << 20
#: Alignments that run together, and the cells that their arrays have together at most (one alignment may have more).
TOGETHER, CELLS = 256, 1 << 22

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits: marks glued to words and lone signs don't matter."""
    return _WORD.findall(text.lower()) if text else []


def smith_waterman(items: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """The best local alignment score of each pair of rows. Word numbers; the padding is -1 in items and -2 in passages.

    Goes down the items' words for all pairs at once. Gaps along the passage are a running maximum, since a gap costs
    the same for each word.
    """
    n, width = passages.shape
    best, above = np.zeros(n, np.int32), np.zeros((n, width + 1), np.int32)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        pair = np.where((passages == word) & (word >= 0), MATCH, MISMATCH)
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(0, np.maximum(above[:, :-1] + pair, above[:, 1:] + GAP))
        row = np.where(word >= 0, np.maximum.accumulate(row + slope, axis=1) - slope, 0)
        np.maximum(best, row.max(axis=1), out=best)
        above = row
    return best


class Searcher:
    """Finds passages of a block of test items in texts.

    An alignment of m matches that scores S = 2 * threshold * n or more of an item of n words has 2m - S errors at most
    between its matches, so at least S / 2 - 1 (rounded up) of its m - 1 links of consecutive matches hold one error or
    none, and it spans 3n - S words of the text at most. Such a link is a pair of words, one or two words apart in the
    item and in the text: a seed. An item's seeds at its most frequent places are left out, but so few that every leak
    keeps MEET of the seeds it is sure of, or all; no leak is lost.
    """

    def __init__(self, items: list[tuple[int | None, list[str]]], counts: dict[str, int], total: int, threshold: float = LEAK) -> None:
        self.items = [(k, w) for k, w in items if w]
        vocabulary = sorted({x for _, w in self.items for x in w})
        self.number = {x: i for i, x in enumerate(vocabulary)}
        self.bits = max(1, len(vocabulary).bit_length())
        log = np.log((np.array([counts.get(x, 0) for x in vocabulary]) + 0.5) / (total + 0.5 * (len(vocabulary) + 1)))
        self.ids = [np.array([self.number[x] for x in w], np.int64) for _, w in self.items]
        self.need, self.span = np.ones(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        self.share = [threshold if len(ids) >= SEED_WORDS else 1.0 for ids in self.ids]
        keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.single: dict[int, list[int]] = defaultdict(list)
        for k, ids in enumerate(self.ids):
            n = len(ids)
            if n == 1:
                self.single[int(ids[0])].append(k)
                continue
            least = int(np.ceil(MATCH * threshold * n - 1e-9))
            sure = max(1, -(-least // 2) - 1)
            self.need[k], self.span[k] = min(sure, MEET), max(n, 3 * n - least) + max(STEPS)
            chance = np.zeros(n - 1)
            for d in STEPS:
                chance[: n - d] += np.exp(log[ids[:-d]] + log[ids[d:]])
            places = np.sort(np.argsort(chance, kind="stable")[: n - 1 - (sure - self.need[k])])
            for d in STEPS:
                at = places[places < n - d]
                keys.append((ids[at] << self.bits) | ids[at + d])
                owners.append(np.full(len(at), k, np.int64))
        flat = np.unique(np.stack((np.concatenate(keys), np.concatenate(owners))), axis=1)
        self.sorted, self.start = np.unique(flat[0], return_index=True)
        self.start, self.owner = np.append(self.start, flat.shape[1]), flat[1]

    def passages(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The text's word numbers (-2: in no item), and (item, begin, end) of passages around seeds."""
        number = self.number
        ids = np.array([number.get(x, -2) for x in words(text)], np.int64)
        found = []
        if self.single:
            for x, p in zip(*(y.tolist() for y in np.unique(ids, return_index=True)), strict=True):
                found += [(k, p, p + 1) for k in self.single.get(x, ())]
        if len(ids) < 2 or not len(self.sorted):
            return ids, found
        met = []
        for d in STEPS:
            u, w = ids[:-d], ids[d:]
            p = np.nonzero((u >= 0) & (w >= 0))[0]
            keys = (u[p] << self.bits) | w[p]
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            hit = self.sorted[at] == keys
            p, at = p[hit], at[hit]
            n = self.start[at + 1] - self.start[at]
            which = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            met.append(self.owner[which] * len(ids) + np.repeat(p, n))
        met = np.unique(np.concatenate(met))  # a leak's links begin at different words of the text
        k, p = met // len(ids), met % len(ids)
        if not len(k):
            return ids, found
        last = np.arange(len(k)) + self.need[k] - 1
        ok = last < len(k)
        last = np.minimum(last, len(k) - 1)
        ok &= (k[last] == k) & (p[last] - p <= self.span[k])
        done: dict[int, int] = {}
        for k, p in zip(k[ok].tolist(), p[ok].tolist(), strict=True):
            if p <= done.get(k, -1):
                continue
            span = int(self.span[k])
            done[k] = p + span  # a leak whose first seed lies up to here lies in this passage
            found.append((k, max(0, p - span), min(len(ids), p + 2 * span)))
        return ids, found

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text: (number of the item, share of its highest score, first word, words) of passages that score."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        waiting: list[tuple[int, int, int, np.ndarray]] = []

        def settle() -> None:
            waiting.sort(key=lambda x: -len(x[3]))
            i = 0
            while i < len(waiting):
                part = waiting[i : i + max(1, min(TOGETHER, CELLS // (len(waiting[i][3]) + 1)))]
                i += len(part)
                a = np.full((len(part), max(len(self.ids[k]) for _, k, _, _ in part)), -1, np.int64)
                b = np.full((len(part), max(len(x) for *_, x in part)), -2, np.int64)
                for r, (_, k, _, x) in enumerate(part):
                    a[r, : len(self.ids[k])], b[r, : len(x)] = self.ids[k], x
                for (t, k, begin, x), s in zip(part, smith_waterman(a, b).tolist(), strict=True):
                    out[t].append((k, s / (MATCH * len(self.ids[k])), begin, len(x)))
            waiting.clear()

        for t, text in enumerate(texts):
            ids, found = self.passages(text)
            waiting += [(t, k, begin, ids[begin:end]) for k, begin, end in found]
            if len(waiting) >= 8 * TOGETHER:
                settle()
        settle()
        return out


def searchers(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, threshold: float = LEAK) -> Iterator[Searcher]:
    """One Searcher for each block of different test items, of half of block_bytes on average, whatever the table's size.

    Word probabilities come from all whole texts of docs: each task counts the block's own words, of which there are
    as many as the block has.
    """
    spark = docs.sparkSession
    sized = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    blocks = max(1, -(-2 * (sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # bounded by block_bytes
        items = sorted(((r["item_id"], words(r["text"])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        known = spark.sparkContext.broadcast(frozenset(x for _, w in items for x in w))

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            seen, total, own = Counter(), 0, known.value
            for b in batches:
                for t in b.column(0):
                    w = words(t.as_py())
                    total += len(w)
                    seen.update(own.intersection(w) and [x for x in w if x in own])
            yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.string()), pa.array([total, *seen.values()], pa.int64())], names=["word", "n"])

        counts = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        yield Searcher(items, counts, counts.pop(None, 0) or 1, threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = LEAK) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words): one row for each document and test item whose best passage leaks.

    score is the alignment's share of the item's highest, 1 for an unchanged copy. Null and empty texts or items have
    no leaks; items under three words leak where they stand whole, word beside word. All leaks are found, whatever their
    words. A repeated document is reported once a row, an item that repeats with its id and text once. Null ids stay
    null. Empty tables give no rows; extra columns are ignored.
    """
    out = None
    for s in searchers(docs, benchmark, threshold=threshold):
        held = docs.sparkSession.sparkContext.broadcast(s)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            s = held.value
            for b in batches:
                rows = []
                for d, found in zip(b.column(0).to_pylist(), s.search(b.column(1).to_pylist()), strict=True):
                    best: dict[int, tuple[int, float, int, int]] = {}
                    for x in found:
                        if x[1] >= s.share[x[0]] and (x[0] not in best or x[1] > best[x[0]][1]):
                            best[x[0]] = x
                    rows += [(d, s.items[k][0], *x[1:]) for k, x in best.items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "score", "first_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, first_word int, n_words int")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = LEAK) -> DataFrame:
    """The rows of docs, with all their columns, in which no test item leaks; nulls, short items, repeated rows and empty
    tables as in leaks()."""
    out = docs
    for s in searchers(docs, benchmark, threshold=threshold):
        held = docs.sparkSession.sparkContext.broadcast(s)

        @F.pandas_udf("boolean")
        def clean(texts, held=held):  # noqa: ANN001, ANN202
            import pandas as pd

            s = held.value
            return pd.Series([all(x[1] < s.share[x[0]] for x in found) for found in s.search(list(texts))], dtype=bool)

        out = out.where(clean("text"))
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
