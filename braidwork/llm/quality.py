"""Quality by weak labels: EM weighs heuristic labellers, and its posteriors train a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import bytes_of, stored, table

BAD, NONE, GOOD = 0, 1, 2
#: Rows of each side (posterior above or below one half) that the scorer is fitted on; the bound of the sample.
SAMPLE = 3000
#: Slots of the scorer.
SLOTS = 1 << 16
#: A document is kept from this score on: a rejection needs odds of three to one.
KEEP = 0.25

_SYMBOLS = b"#$%&*@^~=+<>{}[]\\_|`"
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))


def votes(text: bytes) -> list[int]:
    """What each labeller says of the text: BAD, NONE (abstains) or GOOD. Texts under 5 words get abstentions only."""
    w = text.split()
    n = len(w)
    if n < 5:
        return [NONE] * LABELLERS
    chars = sum(map(len, w))
    symbols = sum(text.count(c) for c in _SYMBOLS) / chars
    lone = sum(1 for x in w if not x.strip(_SYMBOLS)) / n
    glued = sum(1 for x in w if len(x) > 1 and x[-1] in _SYMBOLS) / n
    upper = sum(1 for x in w if x.isupper()) / n
    shout = text.count(b"!") / n
    again = sum(1 for a, b in zip(w, w[1:], strict=False) if a == b) / n
    kinds = len(set(w)) / min(n, 400)
    short = sum(1 for x in w if len(x) <= 3) / n
    digits = sum(text.count(c) for c in b"0123456789") / chars
    return [
        BAD if symbols > 0.08 else GOOD if symbols < 0.005 else NONE,
        BAD if lone > 0.15 else NONE,
        BAD if glued > 0.2 else NONE,
        BAD if upper > 0.4 else GOOD if upper < 0.1 else NONE,
        BAD if shout > 0.3 else NONE,
        BAD if again > 0.2 else GOOD if again < 0.05 and n >= 20 else NONE,
        BAD if kinds < 0.1 else NONE,
        BAD if short < 0.08 and n >= 20 else GOOD if short > 0.2 else NONE,
        BAD if digits > 0.3 else NONE,
    ]


LABELLERS = 9
#: The pattern in which all abstain.
SILENT = sum(NONE * 3**i for i in range(LABELLERS))


def patterns(docs: DataFrame) -> DataFrame:
    """(row, pattern): a hash of each row's id and text, and the votes on the whole text as digits in base 3. Extra columns stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [sum(v * 3**i for i, v in enumerate(votes(t))) for t in bytes_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int32())], names=["row", "pattern"])

    return docs.select(_row().alias("row"), "text").mapInArrow(run, "row long, pattern int")


def _row() -> Column:
    """What tells rows apart when the sample is drawn: rows alike in id and text count as one there."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(11))


def weigh(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The posterior probability of good quality of each vote pattern, by expectation-maximisation over pattern counts.

    Each labeller has, for either hidden class, a distribution over its three answers; labellers are independent given
    the class. Starts from the majority of votes, so the classes keep their names. The pattern of abstentions only
    says nothing: it takes no part and gets the share of good texts among the others.
    """
    codes = np.array(sorted(c for c in counts if c != SILENT), np.int64)
    if not len(codes):
        return dict.fromkeys(counts, 0.5)
    n = np.array([counts[c] for c in codes.tolist()], float)
    v = np.stack([codes // 3**i % 3 for i in range(LABELLERS)], axis=1)
    one = np.eye(3)[v]
    lead = (v == GOOD).sum(1) - 3.0 * (v == BAD).sum(1)
    good = 1 / (1 + np.exp(-lead - 0.5))
    for _ in range(rounds):
        weight = np.stack((n * (1 - good), n * good))
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        answers = (np.einsum("cp,plv->clv", weight, one) + 0.1) / (weight.sum(1)[:, None, None] + 0.3)
        log = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(answers), one)
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    share = float((n * good).sum() / n.sum())
    return dict(zip(codes.tolist(), good.tolist(), strict=True)) | ({SILENT: share} if SILENT in counts else {})


class Features:
    """Slots of a text: its words and their shapes (runs of one kind of character), hashed, by share of the words."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def slots(self, word: bytes) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            shape = bytes(k for k, _ in groupby(word.translate(_SHAPE)))
            found = self.known[word] = (zlib.crc32(b"w" + word.lower()) % SLOTS, zlib.crc32(b"s" + shape) % SLOTS)
        return found

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        out: Counter[int] = Counter()
        for w, n in Counter(words).items():
            a, b = self.slots(w)
            out[a] += 0.5 * n
            out[b] += 2.0 * n
        again = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
        if again:
            out[zlib.crc32(b"again") % SLOTS] += 4.0 * again
        x = np.fromiter(out.values(), float, len(out))
        return np.fromiter(out.keys(), np.int64, len(out)), x / max(1.0, np.sqrt((x * x).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer on soft labels, both sides weighing the same."""
    w, square = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-8)
    if not rows:
        return w
    size = np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    slot, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    side = np.where(y >= 0.5, 1 / max(1, (y >= 0.5).sum()), 1 / max(1, (y < 0.5).sum()))
    for _ in range(rounds):
        z = np.bincount(row, x * w[slot], len(rows)) + w[-1]
        off = (1 / (1 + np.exp(-z)) - y) * side
        g = np.append(np.bincount(slot, x * off[row], SLOTS) + decay * w[:-1], off.sum())
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def trained(docs: DataFrame, patterned: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """The patterns' posteriors, from counts over all rows, and the scorer's weights, fitted on `sample` rows of each side.

    The driver gets one count for each vote pattern, 3^9 at most, and the slots of 2 * sample rows.
    """
    counts = {r["pattern"]: r["n"] for r in patterned.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = weigh(counts)
    good = [c for c, p in posterior.items() if p >= 0.5]
    heard = patterned.where(F.col("pattern") != SILENT).distinct()
    side = F.col("pattern").isin([-1, *good])
    picked = stored(heard.where(side).orderBy("row", "pattern").limit(sample).union(heard.where(~side).orderBy("row", "pattern").limit(sample)).dropDuplicates(["row"]), "sample")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            both = [f.of(t) for t in bytes_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0].astype("<i4").tobytes() for x in both], pa.binary()), pa.array([x[1].astype("<f4").tobytes() for x in both], pa.binary())], names=["pattern", "slot", "x"])

    one = docs.select(_row().alias("row"), "text").join(picked, "row").groupBy("row", "pattern").agg(F.max("text").alias("text"))  # rows alike have one text
    rows = one.select("text", "pattern").mapInArrow(slots, "pattern int, slot binary, x binary")
    got = sorted((bytes(r["slot"]), bytes(r["x"]), r["pattern"]) for r in rows.collect())  # 2 * sample rows at most
    return posterior, fit([(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), posterior[p]) for s, x, p in got])


def scored(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(doc_id, posterior, score, kept) for each row: the weak label, the scorer's value in 0 to 1, and score >= keep.

    All vote counts cover all rows and whole texts; the scorer is fitted on the documented sample. Null, empty and very
    short texts get abstentions and a score from the intercept alone or their few words; null ids are handled like any
    other, and rows that repeat are sampled once. An empty table gives no rows. Extra columns are ignored.
    """
    patterned = stored(patterns(docs), "votes")
    posterior, weights = trained(docs, patterned, sample)
    codes = pa.array(sorted(posterior), pa.int32())
    prob = np.array([posterior[c] for c in codes.to_pylist()])
    w = docs.sparkSession.sparkContext.broadcast((codes.to_numpy(zero_copy_only=False), prob, weights))  # 0.5 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        code, p, weight = w.value
        for b in batches:
            score, post = np.empty(b.num_rows), np.empty(b.num_rows)
            for i, t in enumerate(bytes_of(b.column(1))):
                slot, x = f.of(t)
                score[i] = 1 / (1 + np.exp(-np.clip((x * weight[slot]).sum() + weight[-1], -50, 50)))
                post[i] = p[np.searchsorted(code, sum(v * 3**k for k, v in enumerate(votes(t))))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(post), pa.array(score), pa.array(score >= keep)], names=["doc_id", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of docs, with all their columns, that the scorer keeps: score >= keep, as in scored(), which says what
    nulls, short texts and repeated rows get. An empty table gives no rows."""
    posterior, weights = trained(docs, stored(patterns(docs), "votes"), sample)
    w = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def good(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        f = Features()
        out = []
        for t in texts:
            slot, x = f.of(t.encode() if t is not None else b"")
            z = (x * w.value[slot]).sum() + w.value[-1]
            out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))) >= keep)
        return pd.Series(out)

    return docs.where(good("text"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
