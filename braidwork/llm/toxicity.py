"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import fold_of, stored, table

#: Entries of the learned lexicon and exception phrases, at most; an entry needs this share of the toxic texts.
LEXICON, EXCEPTIONS, SUPPORT = 500, 500, 0.02
#: Lengths of stems.
STEMS = (5, 6, 7, 8)
#: Labelled rows of either label that the lexicon is learned from (the least by a hash of the id): the bound of the sample.
LABELLED = 20_000
#: Of these, rows of either label that the length-normalised score is calibrated on.
SAMPLE = 4000
#: Words that a task counts before it passes its counts on.
COUNTED = 200_000
#: From this score on a text is predicted toxic.
TOXIC = 0.3

#: Letters of other scripts that look like Latin ones, in pairs (fixed values).
HOMOGLYPHS = "аaеeоoрpсcхxуyіiјjѕsԁdһhкkмmтtвbнhαaοoνvιiρpεeτtκkυuıiɡgℓlⅼl"
#: Digits and signs that stand for letters inside words, in pairs (fixed values).
SUBSTITUTES = "0o1i3e4a5s7t8b9g@a$s!i|l+t"

_FOLD = str.maketrans(HOMOGLYPHS[::2], HOMOGLYPHS[1::2]) | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
_FOLD |= {ord(c) + 0xFEE0: c for c in "abcdefghijklmnopqrstuvwxyz0123456789@$!"}  # full-width forms
_DIGIT = str.maketrans(SUBSTITUTES[::2], SUBSTITUTES[1::2])
_INSIDE = re.compile(r"(?<![^\W\d_])[0-9@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9@$!|+]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def folded(text: str | None) -> str:
    """Lower-cased text with lookalikes as Latin letters; digits and signs that touch letters become letters."""
    t = (text or "").lower().translate(_FOLD)
    return _INSIDE.sub(lambda m: m.group().translate(_DIGIT), t)


def lexical(t: str) -> Iterator[str]:
    """The words of a folded text and their stems: first letters of longer words, marked by a star."""
    for w in set(_WORD.findall(t)):
        yield w
        for n in STEMS:
            if len(w) > n:
                yield w[:n] + "*"


class Matcher:
    """Finds lexicon words between boundaries and stems at the beginning of words, but not inside an exception phrase.

    Where several entries begin at one place, the heaviest counts.
    """

    def __init__(self, lexicon: dict[str, float], exceptions: frozenset[str] | set[str] = frozenset()) -> None:
        self.lexicon, self.exceptions = lexicon, frozenset(exceptions)
        self.automaton = ahocorasick.Automaton()
        for w in {x.rstrip("*") for x in lexicon}:
            self.automaton.add_word(w, (w, lexicon.get(w), lexicon.get(w + "*"), False))
        for p in self.exceptions:
            if p not in lexicon:
                self.automaton.add_word(p, (p, None, None, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):  # noqa: ANN204
        return Matcher, (self.lexicon, self.exceptions)

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) in the folded text."""
        if not len(self.automaton):
            return []
        found, excepted = {}, []
        for last, (w, x, stem, phrase) in self.automaton.iter(text):
            begin, end = last - len(w) + 1, last + 1
            if begin and text[begin - 1].isalpha():
                continue
            inside = end < len(text) and text[end].isalpha()
            if phrase:
                if not inside:
                    excepted.append((begin, end))
            elif (y := stem if inside else x) is not None and y > found.get(begin, (0, 0.0))[1]:
                found[begin] = (end, y)
        excepted.sort()
        begins, furthest = [c for c, _ in excepted], list(accumulate((d for _, d in excepted), max))
        inside_one = lambda a, b: (k := bisect_right(begins, a)) > 0 and furthest[k - 1] >= b
        return [(a, b, x) for a, (b, x) in found.items() if not inside_one(a, b)]

    def features(self, text: str | None) -> np.ndarray:
        """Summed weight by the root of the number of words, its logarithm, and whether there is a hit."""
        t = folded(text)
        h = self.hits(t)
        total = sum(x for *_, x in h)
        return np.array([total / np.sqrt(10 + t.count(" ")), np.log1p(total), float(bool(h))]) if h else np.zeros(3)


def _counted(rows: DataFrame, terms) -> DataFrame:  # noqa: ANN001
    """(term, pos, neg): in how many texts of rows (text, toxic) each term occurs; tasks pass on sums of many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = sorted(set(sums[0]) | set(sums[1]))
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[1][k] for k in keys], pa.int64()), pa.array([sums[0][k] for k in keys], pa.int64())], names=["term", "pos", "neg"])
            sums[0].clear(), sums[1].clear()
            return b

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                sums[y].update(set(terms(folded(t.as_py()))))
                if len(sums[0]) + len(sums[1]) > COUNTED:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Matcher, np.ndarray]:
    """Lexicon and exceptions counted over LABELLED labelled rows of either label (equal texts once), and the score's weights from `sample` of them.

    A word enters by its log odds between toxic and other texts. An exception is two neighbouring words, one of them of
    the lexicon, seen in five clean texts or more and in toxic ones hardly ever. The driver gets LEXICON + EXCEPTIONS
    terms and three numbers for each of 2 * sample rows.
    """
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    label = stored(label.join(docs.where("text is not null").select(F.col("doc_id").cast("long")), "doc_id", "left_semi"), "labels")
    sizes = {r["toxic"]: r["n"] for r in label.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    turn = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    some = label.where("toxic = 1").orderBy(*turn).limit(LABELLED).union(label.where("toxic = 0").orderBy(*turn).limit(LABELLED))
    some = stored(some, "labels")  # 2 * LABELLED rows of two numbers, so it may be broadcast
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id")
    rows = stored(rows.withColumn("key", F.xxhash64("text")).dropDuplicates(["key", "toxic"]), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    terms = _counted(rows, lexical).where(F.col("pos") >= max(3, SUPPORT * n_pos)).withColumn("odds", odds).where(F.col("odds") > F.when(F.col("term").endswith("*"), 4.0).otherwise(3.0))
    lexicon = {r["term"]: r["odds"] for r in terms.orderBy(F.desc("odds"), "term").limit(LEXICON).collect()}
    known = frozenset(lexicon)

    def phrases(t: str) -> list[str]:
        w = re.findall(r"[^\W\d_]+", t)
        return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a in known or b in known]

    found = _counted(rows, phrases).where("neg >= 5 and pos * 20 <= neg").orderBy(F.desc("neg"), "term").limit(EXCEPTIONS).collect()
    matcher = Matcher(lexicon, {r["term"] for r in found})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([matcher.features(t.as_py()) for t in b.column(0)]) if b.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, i]) for i in range(3))], names=["toxic", "a", "b", "c"])

    order = [F.xxhash64("key", F.lit(3)), F.col("key")]
    picked = rows.where("toxic = 1").orderBy(*order).limit(sample).union(rows.where("toxic = 0").orderBy(*order).limit(sample))
    got = picked.select("text", "toxic").mapInArrow(measure, "toxic int, a double, b double, c double").collect()
    return matcher, calibrated(np.array([[r["a"], r["b"], r["c"], 1.0] for r in got]).reshape(-1, 4), np.array([r["toxic"] for r in got], float), share)


def calibrated(x: np.ndarray, y: np.ndarray, toxic: float) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge; toxic rows weigh `toxic` in all, as among all labelled rows."""
    w = np.array([0.0, 0.0, 0.0, -2.0])
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y > 0, toxic / y.sum(), (1 - toxic) / (1 - y).sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (share * p * (1 - p))[:, None]) + 1e-3 * np.eye(4)
        step = np.linalg.solve(hessian, x.T @ (share * (y - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, matcher: Matcher, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) for each row of docs, from its whole text alone.

    Null and empty texts have no hits and the score of a text without hits. Repeated rows and null ids are scored like
    any other; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([matcher.features(t.as_py()) for t in b.column(2)]) if b.num_rows else np.zeros((0, 3))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:3] + weights[3], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= TOXIC).astype(np.int32)), pa.array(x[:, 2] > 0)], names=["doc_id", "held_out", "score", "predicted", "has_hit"])

    return docs.select(F.col("doc_id").cast("long"), (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, has_hit boolean")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, *trained(docs.where(fold_of(F.col("doc_id"), 4) != 2), table(spark, sf_dir, "labels")))
