"""BPE encoding and decoding with a tokenizer file: a segment tree over the ranks of adjacent pairs picks each merge."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from braidwork.llm.common import bytes_of, mapped, table

#: A text is cut at white space into pieces of about so many bytes, so that its words are never all in memory; short texts are taken together up to that.
PIECE = 1 << 19
#: A worker remembers the ids of so many different words, or of one piece's; then it starts anew. What isn't remembered is worked out again.
WORDS = 1 << 18
#: Up to so many symbols, pieces are merged many at a time.
TOGETHER = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NONE = 1 << 62


def merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges; pairs gives (rank, new symbol) of each pair that merges.

    The leaves of a segment tree hold each adjacent pair's rank and place as one number, inner nodes the least below. So
    the root is the leftmost pair of the lowest rank. A merge changes three leaves, each a path to the root: n symbols take
    n log n steps, however long the word.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    bits = (n - 1).bit_length()
    width, sym = 1 << bits, list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        found = pairs.get((sym[i], sym[i + 1]))
        if found:
            tree[width + i] = found[0] << bits | i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low

    def pair(i: int) -> int:
        j = after[i]
        found = pairs.get((sym[i], sym[j])) if j < n else None
        return found[0] << bits | i if found else _NONE

    while tree[1] != _NONE:
        i = tree[1] & (width - 1)
        j = after[i]
        sym[i] = pairs[sym[i], sym[j]][1]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return out


def merged_together(symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """merged() of the rows of a matrix (width a power of two, `lengths` of each row in use), a segment tree a row, all rows in step.

    keys are left * base + right of the pairs, sorted, with their ranks; made is the new symbol of each rank. Returns all
    rows' symbols one after another, and how many each has.
    """
    rows, width = symbols.shape
    bits = width.bit_length() - 1
    sym, after, before = symbols.astype(np.int64), np.tile(np.arange(1, width + 1), (rows, 1)), np.tile(np.arange(-1, width - 1), (rows, 1))
    alive = np.arange(width) < lengths[:, None]

    def leaf(left: np.ndarray, right: np.ndarray, ok: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = left * base + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(ok & (keys[at] == key), ranks[at] << bits | place, _NONE)

    tree = np.full((rows, 2 * width), _NONE, np.int64)
    place = np.arange(width - 1)
    tree[:, width:-1] = leaf(sym[:, :-1], sym[:, 1:], place + 1 < lengths[:, None], place)
    for k in range(bits - 1, -1, -1):
        low = tree[:, 2 << k : 4 << k]
        tree[:, 1 << k : 2 << k] = np.minimum(low[:, ::2], low[:, 1::2])
    r = np.flatnonzero(tree[:, 1] < _NONE)
    while len(r):
        root = tree[r, 1]
        i = root & (width - 1)
        j = after[r, i]
        k, p = after[r, j], before[r, i]
        new = made[root >> bits]
        sym[r, i], after[r, i], alive[r, j] = new, k, False
        inside, left = k < lengths[r], p >= 0
        before[r[inside], k[inside]] = i[inside]
        tree[r, width + j] = _NONE
        tree[r, width + i] = leaf(new, sym[r, np.where(inside, k, 0)], inside, i)
        tree[r[left], width + p[left]] = leaf(sym[r[left], p[left]], new[left], True, p[left])
        for q, at in ((r, j), (r, i), (r[left], p[left])):
            at = at + width
            for _ in range(bits):
                at = at >> 1
                tree[q, at] = np.minimum(tree[q, 2 * at], tree[q, 2 * at + 1])
        r = r[tree[r, 1] < _NONE]
    return sym[alive], alive.sum(1)


class Model:
    """A tokenizer file of the kind BPE whose pre-tokenizer drops white space, so that words between white space are encoded alone.

    The library does what the file says before and after the merges: normalising, cutting into pieces. The merges are this module's.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, added = spec["model"], spec.get("added_tokens", [])
        around = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
        self.tokenizer = Tokenizer.from_str(json.dumps(around))  # for normalising and cutting alone
        seen = self.tokenizer.pre_tokenizer.pre_tokenize_str("a b") if self.tokenizer.pre_tokenizer else []
        odd = [k for k in ("unk_token", "dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix") if model.get(k)] + [a["content"] for a in added if a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]]
        if model["type"] != "BPE" or [p for p, _ in seen] != ["a", "b"] or spec.get("decoder") or odd:
            raise ValueError(f"not a BPE file whose pieces are words without white space: {odd}")
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        cut = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(cut)}
        self.special = {a["content"]: a["id"] for a in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = self.vocab | self.special
        size = max(names.values()) + 1
        held = [None] * size
        for name, i in names.items():
            held[i] = name
        self.names = pa.array(held, pa.large_string())
        self.known = np.array([h is not None for h in held])
        self.words: dict[bytes, bytes] = {}
        coded = sorted((a * len(self.names) + b, rank) for (a, b), (rank, _) in self.pairs.items())
        self.keys, self.ranks = (np.array(x, np.int64) for x in zip(*coded, strict=True)) if coded else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        self.made = np.array([new for _, (_, new) in sorted(self.pairs.items(), key=lambda x: x[1][0])] or [0], np.int64)
        self.first, self.last = (np.array([self.vocab.get(chr(c) + end, -1) for c in range(0x200)], np.int64) for end in ("", self.end))

    def ids(self, word: str) -> list[int]:
        """The ids of a text without white space, added tokens in it included."""
        out = []
        for part in self.split.split(word) if self.split else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.piece(piece)
        return out

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece; symbols that the file doesn't have are left out."""
        symbols = (self.vocab.get(c) for c in (*piece[:-1], piece[-1] + self.end))
        return merged([s for s in symbols if s is not None], self.pairs)

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece; those of few symbols together, by widths."""
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        known = np.minimum(points, 0x1FF)
        symbols = self.first[known]
        symbols[ends - 1] = self.last[known[ends - 1]]
        odd = np.add.reduceat((symbols < 0) | (points > 0x1FF), ends - lengths) > 0 if len(pieces) else np.zeros(0, bool)
        out: list[bytes] = [b""] * len(pieces)
        width = 1
        while width <= TOGETHER:
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2) & ~odd)
            if len(rows):
                at = (ends - lengths)[rows, None] + np.minimum(np.arange(width), lengths[rows, None] - 1)
                flat, count = merged_together(symbols[at], lengths[rows], self.keys, self.ranks, self.made, len(self.names)) if width > 1 else (symbols[at].ravel(), np.ones(len(rows), np.int64))
                raw, stop = flat.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                for i, a, b in zip(rows.tolist(), [0, *stop], stop, strict=False):
                    out[i] = raw[a:b]
            width *= 2
        for i in np.flatnonzero(odd | (lengths > TOGETHER)).tolist():
            out[i] = np.array(self.piece(pieces[i]), "<u4").tobytes()
        return out

    def learn(self, words: list[bytes]) -> None:
        """The ids of new words (bytes without ASCII white space), for self.words. Words are normalised and cut together, a
        space between them, but for those that hold other white space or an added token."""
        texts = b" ".join(words).decode().split(" ")
        joined = " ".join(texts)
        if joined.split() != texts or (self.split and self.split.search(joined)):
            plain = [t.split() == [t] and not (self.split and self.split.search(t)) for t in texts]
            for w, t, ok in zip(words, texts, plain, strict=True):
                if not ok:
                    self.words[w] = np.array(self.ids(t), "<u4").tobytes()
            words, texts = ([x for x, ok in zip(xs, plain, strict=True) if ok] for xs in (words, texts))
            joined = " ".join(texts)
        normal = self.tokenizer.normalizer.normalize_str(joined) if self.tokenizer.normalizer else joined
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        lengths = np.fromiter(map(len, normal.split(" ")), np.int64) + 1
        of = np.searchsorted(np.cumsum(lengths), np.fromiter((x[0] for _, x in found), np.int64, len(found)), "right")
        number: dict[str, int] = {}
        where = [number.setdefault(piece, len(number)) for piece, _ in found]
        ids = self.pieces_ids(list(number))
        parts, at = [ids[k] for k in where], 0
        for w, n in zip(words, np.bincount(of, minlength=len(words)).tolist(), strict=True):
            self.words[w] = parts[at] if n == 1 else b"".join(parts[at : at + n])
            at += n

    def packed(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each whole text, four bytes each, the least first."""
        held: list[tuple[int, list[bytes]]] = []  # (number of a text in the run, words of a piece of it)
        run: list[list[bytes]] = []

        def flush() -> Iterator[bytes]:
            every = {w for _, ws in held for w in ws}
            new = [w for w in every if w not in self.words]
            if len(self.words) + len(new) > WORDS:
                self.words.clear()
                new = list(every)
            if new:
                self.learn(new)
            for k, ws in held:
                run[k].append(b"".join(map(self.words.__getitem__, ws)))
            held.clear()
            yield from map(b"".join, run[:-1])  # the last text may go on
            del run[:-1]

        size = 0
        for text in texts:
            run.append([])
            for piece in pieces(text):
                held.append((len(run) - 1, piece.split()))
                size += len(piece)
                if size >= PIECE:
                    yield from flush()
                    size = 0
        yield from flush()
        yield from map(b"".join, run)

    def text(self, packed: pa.Array) -> pa.Array:
        """The texts of packed ids: names joined by a space, as the library does without a decoder; ids without a name are left out."""
        raw = packed.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 4
        ids = np.frombuffer(raw.buffers()[2] or b"", "<u4")[ends[0] : ends[-1]]
        ok = ids < len(self.known)
        ok[ok] = self.known[ids[ok]]
        at = np.concatenate(([0], np.cumsum(ok)))[ends - ends[0]]
        names = self.names.take(pa.array(ids[ok]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), names), pa.scalar(" ", pa.large_string()))
        return pc.if_else(raw.is_null(), pa.scalar(None, pa.large_string()), joined)


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces that end before white space, of `size` bytes or as many more as the next white space needs."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@functools.lru_cache(maxsize=2)
def _model(text: str) -> Model:
    return Model(text)


def _shared(spark: SparkSession, path: str) -> Callable[[], Model]:
    """The file's model on any executor. The file goes there as a broadcast: it is a vocabulary (2 MB here), which no data makes grow."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    _model(text)  # a file of another kind is refused here
    sent = spark.sparkContext.broadcast(text)
    return lambda: _model(sent.value)


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """The columns `keep` of docs, n_tokens and ids: the text's token ids, packed as unsigned 32-bit integers, the least byte first.
    With `decode`, decoded as well: what decoded() makes of the ids, in the same pass.

    As the library encodes with add_special_tokens=False: added tokens in a text get their ids. A map: no shuffle.

    * null text is empty and has no ids; rows that repeat are encoded alike; an empty table gives no rows;
    * only text and `keep` are read, so other columns may have any name; a kept column named as a made one is an error;
    * a very long text is cut at white space into pieces of half a MB, words never meet over white space, so the ids are those of
      the whole; a long run without white space is one piece (n log n steps). Memory: the text, its ids and a piece's words.
    """
    model = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in batches:
            ids = list(m.packed(bytes_of(b.column(0))))
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            packed = pa.array(ids, pa.binary())
            out = [n, packed, m.text(packed).cast(pa.string())] if decode else [n, packed]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *out], names=[*b.schema.names[1:], *(f.name for f in made)])

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decode else [])]
    return mapped(docs, [F.col(f"`{text}`")], keep, made, run)


def decoded(tokens: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of tokens and decoded, the text of packed ids as the library's decode(ids, skip_special_tokens=False).

    Null ids give null, no ids the empty text, ids that the file doesn't have are left out. Arrow works on whole batches.
    """
    model = _shared(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], m.text(b.column(0)).cast(pa.string())], names=[*b.schema.names[1:], "decoded"])

    return mapped(tokens, [F.col(f"`{ids}`")], keep, [T.StructField("decoded", T.StringType())], run)


def unpacked(tokens: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of tokens and token_ids, the packed ids as an array of bigint; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 4
            flat = np.frombuffer(raw.buffers()[2] or b"", "<u4")[ends[0] : ends[-1]].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pc.if_else(raw.is_null(), pa.scalar(None, lists.type), lists)], names=[*b.schema.names[1:], "token_ids"])

    return mapped(tokens, [F.col(f"`{ids}`")], keep, [T.StructField("token_ids", T.ArrayType(T.LongType()))], run)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, with digests of ids and text. SQL has no merges; tested against the library."""
    path = os.environ.get("BRAIDWORK_BPE", public_tokenizers.path("word_bpe_49k.json"))
    out = encoded(table(spark, sf_dir, "documents"), path, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
