"""Scoring texts with a Katz back-off model of up to three words, kept in tables that are bucketed by n-gram.

The model is never in one place. Texts become chunks of word numbers, once; the numbers follow the words' frequencies,
so that a short list of the different counts gives any word's count. A chunk sends its different pairs and triples to
the buckets of the model, first to count them and later to ask for their counts and back-off weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import bucketed, bytes_of, discard, fold_of, partitions_for, stored, table

#: Bytes of a chunk: what a task holds at once, besides one text.
CHUNK = 10 << 20
#: Counts up to GOOD_TURING are discounted by Good and Turing's estimate; larger ones lose LOSS, so that every context leaves something.
GOOD_TURING, LOSS = 5, 0.5
#: Numbers of the begin and the end of a text, of words that no training text has, and of the most frequent word.
BEGIN, END, UNKNOWN, FIRST = 0, 1, 2, 3

_TEXTS = "bucket int, chunk long, flag boolean, ids array<long>, a binary, b binary, c binary"
_PIECE = "bucket int, chunk long, flag boolean, v binary, w binary, n binary, t binary, u binary, m binary, k binary"


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31)


def _pack(x: np.ndarray, dtype: type = np.int64) -> bytes:
    """Numbers as compressed bytes: all first bytes, all second ones, and so on."""
    x = np.ascontiguousarray(x, dtype)
    return _zip(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unpack(b: bytes, dtype: type = np.int64) -> np.ndarray:
    x = np.frombuffer(_unzip(b), np.uint8)
    if not len(x):
        return np.zeros(0, dtype)
    return np.ascontiguousarray(x.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _risen(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b))


def _row(schema: str, **cols: object) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([cols.get(name)], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _table(schema: str, rows: list[dict]) -> pa.Table:
    batches = [_row(schema, **r) for r in rows]
    return pa.Table.from_batches(batches or [_row(schema).slice(0, 0)])


def _dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _cut(part: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by bucket, in their order within each, and where each bucket begins."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(buckets + 1))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, which of them each element is, and how often each occurs: np.unique in less than half its memory."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    first = np.flatnonzero(new)
    return x[first], at, np.diff(first, append=len(x))


def _numbers() -> Iterator[int]:
    first = TaskContext.get().partitionId() << 32
    yield from range(first, first + (1 << 31))


def tokenised(rows: DataFrame, buckets: int) -> DataFrame:
    """Chunks of texts of one flag: a row of bucket -1 with the texts (ids, a: local word numbers, b: each word's bucket,
    c: tokens of each text), and for each bucket the words it is asked for (a: the words, b: how often they occur)."""

    def chunk(k: int, flag: bool, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        at, parts = known.setdefault, []
        for t in texts:
            row = [at(w, len(known)) for w in t.lower().split()]
            row.append(-1)  # the end
            parts.append(np.array(row, np.int32))
        cur = np.concatenate(parts)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        part = (h % np.uint64(buckets)).astype(np.int64)
        yield _row(_TEXTS, bucket=-1, chunk=k, flag=flag, ids=ids, a=_pack(cur + 1, np.int32), b=_pack(part, np.int32), c=_pack(np.array([len(x) for x in parts])))
        words, n = list(known), np.bincount(cur + 1, minlength=len(known) + 1)[1:]
        order, cut = _cut(part, buckets)
        for b in np.nonzero(np.diff(cut))[0].tolist():
            own = order[cut[b] : cut[b + 1]]
            yield _row(_TEXTS, bucket=b, chunk=k, flag=flag, a=_zip(b" ".join([words[i] for i in own.tolist()])), b=_pack(n[own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        held: dict[bool, list] = {True: [[], [], 0], False: [[], [], 0]}
        for b in batches:
            for d, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_of(b.column(2)), strict=True):
                own = held[f]
                own[0].append(d), own[1].append(t)
                own[2] += len(t) + 8
                if own[2] >= CHUNK:
                    yield from chunk(next(number), f, own[0], own[1])
                    held[f] = [[], [], 0]
        for f, (ids, texts, _) in held.items():
            if ids:
                yield from chunk(next(number), f, ids, texts)

    return rows.mapInArrow(run, _TEXTS)


def _words(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all blobs, and how many each has."""
    lists = [_unzip(x).split(b" ") for x in blobs]
    return pa.array([w for x in lists for w in x], pa.large_binary()), np.array([len(x) for x in lists], np.int64)


def vocabulary(asked: DataFrame) -> DataFrame:
    """(bucket, n, m, words, ahead): the m words of a bucket that training texts have n times; ahead: how many lower buckets have."""

    def merge(t: pa.Table) -> pa.Table:
        words, _ = _words(t.column("a").to_pylist())
        n = np.concatenate([_unpack(x) for x in t.column("b").to_pylist()])
        sums = pa.table({"w": words, "n": pa.array(n)}).group_by("w").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("w", "ascending")])
        n, w = sums.column("n_sum").to_numpy(), sums.column("w").to_pylist()
        first = np.nonzero(np.diff(n, prepend=-1))[0].tolist()
        rows = [(int(n[i]), j - i, _zip(b" ".join(w[i:j]))) for i, j in zip(first, [*first[1:], len(n)], strict=True)]
        a, b, c = zip(*rows, strict=True)
        return pa.table([pa.array([t.column("bucket")[0].as_py()] * len(rows), pa.int32()), pa.array(a), pa.array(b), pa.array(c, pa.binary())], names=["bucket", "n", "m", "words"])

    merged = stored(asked.where("flag").groupBy("bucket").applyInArrow(merge, "bucket int, n long, m long, words binary"), "words")
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0)))


class Counts:
    """The training counts of word numbers. Words are numbered by falling count, so that one line for each different
    count is enough: of N tokens there are at most sqrt(2 N) different counts, 2 MB for 30 GB of text and 100 MB for 100 TB."""

    def __init__(self, classes: dict[int, int], texts: int) -> None:
        self.n = np.array(sorted(classes, reverse=True), np.int64)
        many = np.array([classes[x] for x in self.n.tolist()], np.int64)
        self.first = FIRST + np.cumsum(many) - many
        self.texts, self.total, self.kinds = texts, int((self.n * many).sum()) + texts, int(many.sum()) + (texts > 0)
        self.base = FIRST + int(many.sum())  # the number after the last word's
        if self.base >= 3_000_000_000:
            raise ValueError("pairs of words are one 64-bit number, which holds for three billion different words")

    def of(self, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        real = word >= FIRST
        out[real] = self.n[np.searchsorted(self.first, word[real], side="right") - 1]
        out[(word == END) | (word == BEGIN)] = self.texts
        return out

    def chance(self, word: np.ndarray) -> np.ndarray:
        """What words alone have: their smoothed frequency."""
        return (self.of(word) + 0.5) / (self.total + 0.5 * (self.kinds + 1))


def encoded(asked: DataFrame, texts: DataFrame, words: DataFrame, counts: Counts, buckets: int) -> DataFrame:
    """(chunk, flag, ids, sizes, words): each chunk's texts with the numbers that hold everywhere."""
    first = dict(zip(counts.n.tolist(), counts.first.tolist(), strict=True))

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        want, sizes = _words(asked.column("a").to_pylist())
        known, many = _words(own.column("words").to_pylist()) if own.num_rows else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        begin = np.array([first[n] + a for n, a in zip(own.column("n").to_pylist(), own.column("ahead").to_pylist(), strict=True)], np.int64)
        number = np.append(np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum()), UNKNOWN)
        at = pc.fill_null(pc.index_in(want, value_set=known), len(known)).to_numpy()
        found = np.split(number[at], np.cumsum(sizes)[:-1])
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array([_pack(x) for x in found], pa.binary())], names=["chunk", "bucket", "a"])

    def encode(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table("chunk long, flag boolean, ids array<long>, sizes binary, words binary", [])
        row = texts.to_pylist()[0]
        part = _unpack(row["b"], np.int32)
        number = np.full(len(part) + 1, END, np.int64)
        order, cut = _cut(part, buckets)
        for b, a in zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist(), strict=True):
            number[order[cut[b] : cut[b + 1]] + 1] = _unpack(a)
        return _table("chunk long, flag boolean, ids array<long>, sizes binary, words binary", [{"chunk": row["chunk"], "flag": row["flag"], "ids": row["ids"], "sizes": row["c"], "words": _pack(number[_unpack(row["a"], np.int32)])}])

    answers = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, a binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(encode, "chunk long, flag boolean, ids array<long>, sizes binary, words binary")


class Grams:
    """The different pairs and triples of a chunk. A pair (v, w) is the number v * base + w; a triple (u, v, w) belongs
    to its pair (v, w). Those with unknown words are left out, as no training text has them."""

    def __init__(self, sizes: np.ndarray, w: np.ndarray, base: int) -> None:
        self.base, self.start = base, np.cumsum(sizes) - sizes
        begins = np.zeros(len(w), bool)
        begins[self.start] = True
        code = np.empty(len(w), np.int64)  # arrays as long as the chunk are few at once, and places in it are 32-bit
        code[1:] = w[:-1]
        code[self.start] = BEGIN
        code *= base
        code += w
        code, self.pair_of, self.n = _distinct(code)
        self.v, self.w = np.divmod(code, base)
        self.later = np.flatnonzero(~begins).astype(np.int32)  # tokens with two words before
        code = self.pair_of[self.later].astype(np.int64)
        code *= base
        code += np.where(begins[self.later - 1], BEGIN, w[self.later - 2])
        code, self.triple_of, self.m = _distinct(code)
        self.owner, self.u = np.divmod(code, base)
        self.owner = self.owner.astype(np.int32)
        self.asked = (self.v != UNKNOWN) & (self.w != UNKNOWN)
        self.asked3 = self.asked[self.owner] & (self.u != UNKNOWN)

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, its pairs, its triples, its words that stand before others)."""
        part = np.where(self.asked, _dealt(self.v * self.base + self.w, buckets), buckets)
        pairs, cut2 = _cut(part, buckets)
        triples, cut3 = _cut(np.where(self.asked3, part[self.owner], buckets), buckets)
        before = np.unique(self.v[self.v != UNKNOWN])
        alone, cut1 = _cut(_dealt(before, buckets), buckets)
        for b in range(buckets):
            own = tuple(x[c[b] : c[b + 1]] for x, c in ((pairs, cut2), (triples, cut3), (alone, cut1)))
            if len(own[0]) or len(own[2]):
                yield b, own[0], own[1], before[own[2]]

    def piece(self, b: int, chunk: int, pairs: np.ndarray, triples: np.ndarray, words: np.ndarray, counts: bool) -> pa.RecordBatch:
        t = np.bincount(self.owner[triples], minlength=len(self.v))[pairs]
        more = {"n": _pack(self.n[pairs]), "m": _pack(self.m[triples])} if counts else {"k": _rising(words)}
        return _row(_PIECE, bucket=b, chunk=chunk, flag=counts, v=_rising(self.v[pairs]), w=_pack(self.w[pairs]), t=_pack(t), u=_pack(self.u[triples]), **more)


def _chunks(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[tuple[dict, Grams]]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, Grams(_unpack(row["sizes"]), _unpack(row["words"]), base)


_COUNTED = "bucket int, v binary, w binary, n binary, t binary, u binary, m binary, rare array<long>"


def counted(chunks: DataFrame, base: int, buckets: int) -> DataFrame:
    """A row for each bucket: its pairs (v, w) in order with their counts n and numbers of triples t, the triples' first
    words u and counts m, and how many pairs and then triples have each of the counts that the discounts need."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, g in _chunks(batches, base):
            for b, pairs, triples, words in g.dealt(buckets):
                if len(pairs):
                    yield g.piece(b, row["chunk"], pairs, triples, words, True)

    def merge(t: pa.Table) -> pa.Table:
        flat = lambda c: np.concatenate([_unpack(x).astype(np.int32 if c == "t" else np.int64) for x in t.column(c).to_pylist()])

        def keys(high: np.ndarray, c: str) -> np.ndarray:
            """high * base + column c, added piece by piece."""
            high *= base
            k = 0
            for x in map(_unpack, t.column(c).to_pylist()):
                high[k : k + len(x)] += x
                k += len(x)
            return high

        code, at, _ = _distinct(keys(np.concatenate([_risen(x) for x in t.column("v").to_pylist()]), "w"))
        n = np.bincount(at, flat("n")).astype(np.int64)
        code3, at, _ = _distinct(keys(np.repeat(at, flat("t")).astype(np.int64), "u"))
        m = np.bincount(at, flat("m")).astype(np.int64)
        del at
        rare = np.concatenate([np.bincount(x[x <= GOOD_TURING + 1], minlength=GOOD_TURING + 2) for x in (n, m)])
        return _table(_COUNTED, [{"bucket": t.column("bucket")[0].as_py(), "v": _rising(code // base), "w": _pack(code % base), "n": _pack(n), "t": _pack(np.bincount(code3 // base, minlength=len(code))), "u": _pack(code3 % base), "m": _pack(m), "rare": rare.tolist()}])

    return chunks.where("flag").mapInArrow(ask, _PIECE).groupBy("bucket").applyInArrow(merge, _COUNTED)


class Stars:
    """Discounted counts: Katz's for 1 to GOOD_TURING, from the numbers of n-grams by count, and LOSS less above.

    Good and Turing's estimate, rescaled so that it takes nothing off at GOOD_TURING + 1. Where the numbers are too few
    or uneven for a factor between 0 and 1, LOSS is taken off.
    """

    def __init__(self, rare: list[int]) -> None:
        n = np.array(rare, float)
        self.low = np.arange(GOOD_TURING + 1) - LOSS
        rest = (GOOD_TURING + 1) * n[GOOD_TURING + 1] / n[1] if n[1] else 1.0
        for r in range(1, GOOD_TURING + 1):
            star = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            d = (star - rest) / (1 - rest) if rest < 1 else 0.0
            if 0 < d < 1:
                self.low[r] = r * d

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.where(n <= GOOD_TURING, self.low[np.minimum(n, GOOD_TURING)], n - LOSS)


_PART = "bucket int, a binary, b binary, x binary, y binary"
_WEIGHTS = "bucket int, pairs binary, words binary, alone binary"


def weights(grams: DataFrame, counts: Counts, two: Stars, three: Stars, buckets: int) -> DataFrame:
    """A row for each bucket: the logarithm of the back-off weight of each of its pairs, and of words (dealt out by themselves).

    A context's weight shares exactly what its discounted continuations leave by the lower probabilities of all other
    words, the unknown one included. A continuation's lower probability is local: the triple's pair is in its bucket.
    """
    base = counts.base

    def sums(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, at, _ = _distinct(key)
        return one, np.bincount(at, x, len(one)), np.bincount(at, y, len(one))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                v, star = _risen(row["v"]), two.of(_unpack(row["n"]))
                word, x1, y1 = sums(v, star, counts.chance(_unpack(row["w"])))
                t, x2 = _unpack(row["t"]).astype(np.int32), three.of(_unpack(row["m"]))
                v, y2 = np.repeat(v, t), np.repeat(star, t)
                pair, x2, y2 = sums(_unpack(row["u"]) * base + v, x2, y2)
                del v, star, t
                for pairs, key, x, y in ((False, word, x1, y1), (True, pair, x2, y2)):
                    order, cut = _cut(_dealt(key, buckets), buckets)
                    for k in np.nonzero(np.diff(cut))[0].tolist():
                        own = order[cut[k] : cut[k + 1]]
                        a, rest = (key[own] // base, _pack(key[own] % base)) if pairs else (key[own], None)
                        yield _row(_PART, bucket=k, a=_rising(a), b=rest, x=_pack(x[own], np.float64), y=_pack(y[own], np.float64))

    def merge(own: pa.Table, parts: pa.Table) -> pa.Table:
        got: dict[bool, list] = {False: [], True: []}
        for r in parts.to_pylist():
            a = _risen(r["a"])
            got[r["b"] is not None].append((a if r["b"] is None else a * base + _unpack(r["b"]), _unpack(r["x"], np.float64), _unpack(r["y"], np.float64)))
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        word, x, y = sums(*(np.concatenate(c) for c in zip(none, *got[False], strict=True)))
        times = counts.of(word)
        alone = np.log10((1 - x / times) / (1 - y))
        row = own.to_pylist()[0] if own.num_rows else None
        code = _risen(row["v"]) * base + _unpack(row["w"]) if row else np.zeros(0, np.int64)
        n = _unpack(row["n"]) if row else code
        pair, x, y = sums(*(np.concatenate(c) for c in zip(none, *got[True], strict=True)))
        weight, at, times = np.zeros(len(code)), np.searchsorted(code, pair), counts.of(pair % base)
        weight[at] = np.log10((1 - x / n[at]) / (1 - y / times))
        bucket = (own if own.num_rows else parts).column("bucket")[0].as_py()
        return _table(_WEIGHTS, [{"bucket": bucket, "pairs": _pack(weight, np.float32), "words": _rising(word), "alone": _pack(alone, np.float32)}])

    return grams.groupBy("bucket").cogroup(grams.drop("rare").mapInArrow(part, _PART).groupBy("bucket")).applyInArrow(merge, _WEIGHTS)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(chunks: DataFrame, model: DataFrame, counts: Counts, two: Stars, three: Stars, buckets: int) -> DataFrame:
    """A row for each text. Chunks ask the buckets for what they hold; texts that the model learned from need counts only."""
    base = counts.base

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, g in _chunks(batches, base):
            for b, pairs, triples, words in g.dealt(buckets):
                piece = g.piece(b, row["chunk"], pairs, triples, words[:0] if row["flag"] else words, False)
                yield piece.set_column(piece.schema.get_field_index("flag"), "flag", pa.array([row["flag"]]))

    def found(held: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(held, want), max(0, len(held) - 1))
        return at, (held[at] == want) if len(held) else np.zeros(len(want), bool)

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        row, none = own.to_pylist()[0] if own.num_rows else None, np.zeros(0, np.int64)
        words, alone = (_risen(row["words"]), _unpack(row["alone"], np.float32)) if row else (none, none)
        code = n = code3 = m = weight = none
        if row and row["v"] is not None:
            code, n, weight = _risen(row["v"]) * base + _unpack(row["w"]), _unpack(row["n"]), _unpack(row["pairs"], np.float32)
            code3, m = np.repeat(np.arange(len(code)), _unpack(row["t"])) * base + _unpack(row["u"]), _unpack(row["m"])
        take = lambda values, at, hit: np.where(hit, values[at], 0) if len(values) else np.zeros(len(at), values.dtype)
        out = []
        for r in asked.to_pylist():
            at, hit = found(code, _risen(r["v"]) * base + _unpack(r["w"]))
            t = _unpack(r["t"])
            at3, hit3 = found(code3, np.repeat(at, t) * base + _unpack(r["u"]))
            a = {"chunk": r["chunk"], "bucket": r["bucket"], "n": _pack(take(n, at, hit)), "m": _pack(take(m, at3, hit3 & np.repeat(hit, t)))}
            if not r["flag"]:
                a |= {"x": _pack(take(weight, at, hit), np.float32), "y": _pack(take(alone, *found(words, _risen(r["k"]))), np.float32)}
            out.append(a)
        return _table(_ANSWER, out)

    def settle(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _table(_SCORED, [])
        row = chunk.to_pylist()[0]
        sizes, w = _unpack(row["sizes"]), _unpack(row["words"])
        g = Grams(sizes, w, base)
        n, m = np.zeros(len(g.v), np.int64), np.zeros(len(g.u), np.int64)
        weight, before = np.zeros(len(g.v)), np.unique(g.v)
        alone = np.zeros(len(before))
        got = {r["bucket"]: r for r in answers.to_pylist()}
        for b, pairs, triples, words in g.dealt(buckets):
            r = got[b]
            n[pairs], m[triples] = _unpack(r["n"]), _unpack(r["m"])
            if not row["flag"]:
                weight[pairs], alone[np.searchsorted(before, words)] = _unpack(r["x"], np.float32), _unpack(r["y"], np.float32)
        low, real = np.log10(counts.chance(g.w)), counts.of(g.w) > 0
        with np.errstate(divide="ignore", invalid="ignore"):  # what was never seen is not taken
            seen = np.log10(two.of(n) / np.maximum(1, counts.of(g.v)))
            token = np.where(n > 0, seen, alone[np.searchsorted(before, g.v)] + low)[g.pair_of]
            del seen, before, alone
            last = g.pair_of[g.later - 1]  # the pair of the two words before
            seen3 = three.of(m)[g.triple_of]
            seen3 /= np.maximum(1, n)[last]
            np.log10(seen3, out=seen3)
        token[g.later] = np.where((m > 0)[g.triple_of], seen3, weight[last] + token[g.later])
        del seen3, last
        base_score, score, known = (np.add.reduceat(x, g.start) for x in (low[g.pair_of], token, real[g.pair_of].astype(np.int64)))
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array([not row["flag"]] * len(sizes)), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), counts.total)), pa.array(base_score), pa.array(score)], names=[c.split()[0] for c in _SCORED.split(", ")])

    answers = chunks.mapInArrow(ask, _PIECE).groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, _ANSWER)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(settle, _SCORED)


_ANSWER = "chunk long, bucket int, n binary, m binary, x binary, y binary"


def katz(rows: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for rows (doc_id, flag, text), learning from those with flag.

    Tokens are the ASCII-lower-cased words and one end. base_score adds the logarithms of smoothed word frequencies.
    score is the model's log10 probability of the text: a token's is that of its triple if training texts have it, else
    the weight of the two words before times that of its pair, which backs off to the word alone in the same way. All
    pairs and triples count, those seen once as well. Null and empty texts are the end alone. Repeated rows count and
    are scored each; null ids are scored. Without any row to learn from, every token has the unknown word's
    probability. An empty table gives no rows.
    """
    buckets = partitions_for(rows.sparkSession)
    tokens = stored(tokenised(rows, buckets), "tokens")
    asked, texts = tokens.where("bucket >= 0").drop("ids", "c"), tokens.where("bucket < 0")
    words = vocabulary(asked)
    classes = {r["n"]: r["m"] for r in words.groupBy("n").agg(F.sum("m").alias("m")).collect()}  # sqrt(2 N) rows at most
    counts = Counts(classes, texts.where("flag").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])
    chunks = stored(encoded(asked, texts, words, counts, buckets), "chunks")
    discard(tokens)
    grams = bucketed(counted(chunks, counts.base, buckets), "bucket", buckets, "grams")
    rare = [r["n"] for r in grams.select(F.posexplode("rare").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()] or [0] * (2 * GOOD_TURING + 4)
    two, three = Stars(rare[: GOOD_TURING + 2]), Stars(rare[GOOD_TURING + 2 :])
    weight = bucketed(weights(grams, counts, two, three, buckets), "bucket", buckets, "weights")
    model = weight.hint("merge").join(grams.drop("rare"), "bucket", "left")  # both are dealt out by bucket already
    out = stored(scored(chunks, model, counts, two, three, buckets), "scores")
    for done in (chunks, grams, weight):
        discard(done)
    return out


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz(docs.select(F.col("doc_id").cast("long"), (fold_of(F.col("doc_id"), 5) != 1).alias("flag"), "text"))
