"""Language identification with a blended-spectrum string kernel, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import fold_of, stored, table

#: Lengths of the n-grams whose presence the kernel compares.
SPECTRUM = (1, 2, 3)
#: Hashed slots of n-grams.
SLOTS = 1 << 13
#: Training texts of each language, the bound of the sample; landmarks in all.
PER_LANGUAGE, LANDMARKS = 300, 128
#: Parts of a language that are ranked apart before the least of all are taken, so that a language of many rows isn't one task's.
PARTS = 64
RIDGE = 1e-2
#: Characters and texts that are worked on at once.
CHARS, TEXTS = 1 << 19, 256

_LETTER = re.compile(r"[^\W\d_]")


def presence(texts: list[str | None]) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams of its lower-cased letters it has. Other ASCII is a space."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    flat = out.ravel()
    parts: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        t = f" {(t or '').lower()} "
        parts += [(i, t[a : a + CHARS + max(SPECTRUM) - 1]) for a in range(0, len(t), CHARS)]
    begin = 0
    while begin < len(parts):
        end, n = begin, 0
        while end < len(parts) and (n == 0 or n + len(parts[end][1]) <= CHARS):
            n += len(parts[end][1])
            end += 1
        now = parts[begin:end]
        begin = end
        c = np.frombuffer("".join(t for _, t in now).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        c[(c < 128) & ((c < 97) | (c > 122))] = 32
        row = np.repeat(np.array([i for i, _ in now]), [len(t) for _, t in now]) * SLOTS
        part = np.repeat(np.arange(len(now)), [len(t) for _, t in now])
        h = np.zeros(len(c), np.uint32)
        for k in range(1, max(SPECTRUM) + 1):
            h = h[: len(c) - k + 1] * np.uint32(0x9E3779B1) + c[k - 1 :] + np.uint32(k)
            if k in SPECTRUM:
                inside = part[: len(h)] == part[k - 1 :]
                slot = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(19)
                flat[row[: len(h)][inside] + slot[inside]] = 1
    return out


class Model:
    """Kernel ridge regression over landmarks, one column of weights for each language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, base: np.ndarray) -> None:
        self.languages, self.landmarks, self.weights, self.base = languages, landmarks, weights, base

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str]) -> Model:
        """x: presence rows. Landmarks are dealt to the languages in turn, in the order of rows."""
        languages = sorted(set(y))
        code = np.array([languages.index(v) for v in y], np.int64) if y else np.zeros(0, np.int64)
        if len(languages) < 2:
            return cls(languages, np.zeros((0, SLOTS), np.float32), np.zeros((0, len(languages))), np.zeros(len(languages)))
        turn = np.zeros(len(y), np.int64)
        for k in range(len(languages)):
            turn[code == k] = np.arange((code == k).sum())
        picked = np.lexsort((code, turn))[:LANDMARKS]
        land = cls.unit(x[picked])
        values, vectors = np.linalg.eigh((land @ land.T).astype(float))
        good = values > 1e-8 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        phi = (cls.unit(x) @ land.T).astype(float) @ root
        target = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
        share = 1 / np.bincount(code, minlength=len(languages))[code]  # languages weigh the same
        share *= len(y) / share.sum()
        base = (share[:, None] * target).sum(0) / share.sum()
        gram = phi.T @ (phi * share[:, None]) + RIDGE * len(y) * np.eye(phi.shape[1]) / 100
        weights = root @ np.linalg.solve(gram, phi.T @ (share[:, None] * (target - base)))
        return cls(languages, land, weights.astype(np.float32), base.astype(np.float32))

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return x / np.maximum(1.0, np.sqrt(x.sum(axis=1, keepdims=True)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score of 0 to 1 for each text; `und` and 0 without a letter or without a learned language."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for a in range(0, len(at), TEXTS):
            part = at[a : a + TEXTS]
            z = self.unit(presence([texts[i] for i in part])) @ self.landmarks.T @ self.weights + self.base
            e = np.exp(3 * (z - z.max(axis=1, keepdims=True)))
            best = z.argmax(axis=1)  # ties: the first in code-point order
            scores[part] = (1 / e.sum(axis=1)).clip(0, 1)
            for i, k in zip(part, best.tolist(), strict=True):
                names[i] = self.languages[k]
        return names, scores


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on `per_language` rows of each lang (the least by a hash of the id); the driver gets 1 KB of n-gram bits a row.

    Rows alike in id, lang and text count as one there, so an id that many rows share fills the sample with its different
    texts, and never brings more rows than that to the driver."""
    row = ["doc_id", "lang", "_hash"]
    order = [F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("doc_id"), F.col("_hash")]
    part, least = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(PARTS))).orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    rows = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long"), "lang", "text", F.xxhash64("text").alias("_hash"))
    few = rows.select(*row).distinct().withColumn("r", F.row_number().over(part)).where(F.col("r") <= per_language)
    keys = stored(few.withColumn("r", F.row_number().over(least)).where(F.col("r") <= per_language).drop("r"), "sample")
    sample = rows.join(keys, row, "left_semi").dropDuplicates(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            bits = [np.packbits(presence([texts[i]])).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(bits, pa.binary())], names=["lang", "bits"])

    got = sorted((r["lang"], bytes(r["bits"])) for r in sample.select("lang", "text").mapInArrow(run, "lang string, bits binary").collect())
    order = np.random.default_rng(0).permutation(len(got))
    got = [got[i] for i in order]
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1), axis=1) if got else np.zeros((0, SLOTS), np.uint8)
    return Model.fit(x, [k for k, _ in got])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0. Ties go to the first language in code-point order.
    Repeated rows and null ids are predicted like any other; an empty table gives no rows; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS * SLOTS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = held.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, trained(docs.where(fold_of(F.col("doc_id"), 4) != 2)))
