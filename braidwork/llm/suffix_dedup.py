"""Removing repeated 50-byte strings: anchors find repeated places, a grouping suffix sort settles which windows repeat.

Texts are packed into chunks. Every window of 50 bytes holds an anchor, the least of its 32-byte strings by a hash, so
equal windows of two documents have equal anchors. Anchors that more than one document has are sent with what stands
beside them (a variant) to their bucket, where suffixes of all variants are sorted and windows that agree get the least
doc_id of their documents. Chunks get back which windows a smaller document than theirs has, and cut their texts. All
variants of a chunk or bucket are rows of arrays, so Python does nothing for each one but the suffix sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import bytes_of, partitions_for, stored, table

WINDOW, ANCHOR = 50, 32
#: Anchors that a window can have, and bytes of it that aren't the anchor's.
REACH = WINDOW - ANCHOR + 1
SIDE = WINDOW - ANCHOR
#: Bytes of a chunk, and of what is hashed at once; positions within the latter take SHIFT bits.
CHUNK, PIECE, SHIFT = 4 << 20, 1 << 19, 20
#: Symbols that are suffix-sorted together, unless one anchor's variants are more.
SORTED = 200_000
#: Documents without an id come after all others.
LAST = (1 << 63) - 1


def suffix_groups(s: list[int] | np.ndarray) -> list[int]:
    """The suffix array of s, whose last symbol must be the least and occur once. Linear grouping construction.

    Phase 1 sorts suffixes into groups of equal Lyndon prefixes: groups are taken from the highest down; prev(i), the
    nearest suffix before i that is in a lower group, is found over pointers of suffixes already done; the suffixes
    that are pointed to leave their groups for new ones right above, those hit more often higher. Members of a group
    stay in ascending order, so pointers of a group never cross. Phase 2 takes the suffixes in their final order and
    puts each chain i - 1, prev(i - 1), ... to the front of its groups until one is placed.
    """
    n = len(s)
    a = np.asarray(s)
    order = np.argsort(a, kind="stable")
    cut = np.nonzero(np.concatenate(([True], np.diff(a[order]) != 0)))[0].tolist() + [n]
    members = [order[x:y].tolist() for x, y in zip(cut, cut[1:], strict=False)]
    count = [len(m) for m in members]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    prev, done = [-1] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:
        rows = members[g]
        if count[g] != len(rows):
            members[g] = rows = [i for i in rows if group[i] == g]
        if len(rows) == 1:
            i = rows[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0 and count[old := group[p]] > 1:
                new = len(members)
                members.append([p])
                count.append(1)
                count[old] -= 1
                group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        else:
            hit: dict[int, list[int]] = {}
            last, times = -1, 0
            for i in rows:
                done[i] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = prev[p]
                prev[i] = p
                if p != last:
                    if last >= 0:
                        hit.setdefault(times, []).append(last)
                    last, times = p, 0
                times += 1
            if last >= 0:
                hit.setdefault(times, []).append(last)
            for times in sorted(hit, reverse=True):
                parts: dict[int, list[int]] = {}
                for p in hit[times]:
                    parts.setdefault(group[p], []).append(p)
                for old, moved in parts.items():
                    if len(moved) == count[old]:
                        continue
                    new = len(members)
                    members.append(moved)
                    count.append(len(moved))
                    count[old] -= len(moved)
                    for p in moved:
                        group[p] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
        g = below[g]
    free, at, g = [0] * len(members), 0, group[n - 1]
    while g >= 0:
        free[g] = at
        at += count[g]
        g = above[g]
    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = prev[i]
    return out


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _open(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x, max_output_size=1 << 31)


def _hashes(c: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of every k bytes, built from hashes of powers of two."""
    out, have, part, size, mult = None, 0, c, 1, 0x9E3779B97F4A7C15
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                n = len(c) - have - size + 1
                out = out[:n] * np.uint64(mult) + part[have : have + n]
                have += size
        if size * 2 > k:
            break
        n = len(c) - 2 * size + 1
        part = part[:n] * np.uint64(mult) + part[size : size + n]
        mult, size = mult * mult % (1 << 64), size * 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's key) of runs of windows with one anchor, in texts that end at `ends` of flat.

    The key is the anchor's hash, times an odd number so that its high bits, which choose the bucket, aren't those by
    which the least hash was chosen.
    """
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    end = np.zeros(len(flat) + 1, bool)
    end[ends] = True
    for s in range(0, len(flat) - WINDOW + 1, PIECE):
        h = _hashes(flat[s : s + PIECE + WINDOW - 1].astype(np.uint64) + np.uint64(1), ANCHOR)
        m = ((h >> np.uint64(SHIFT)) << np.uint64(SHIFT)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= REACH:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        n = len(h) - REACH + 1
        if step < REACH:
            m = np.minimum(m[:n], m[REACH - step : REACH - step + n])
        ended = np.cumsum(end[s : s + n + WINDOW - 1], dtype=np.int32)
        good = ended[WINDOW - 1 :] == ended[:n]
        turn = ~good
        turn[0] = True
        turn[1:] |= (m[1:] != m[:-1]) | turn[:-1]
        turn = np.nonzero(turn)[0]
        last = np.append(turn[1:], n) - 1
        keep = good[turn]
        first, last = turn[keep], last[keep]
        spot = (m[first] & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
        out.append((first + s, last + s, spot + s, h[spot] * np.uint64(0x9FB21C651E98DF25)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cuts(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending keys, and where the last one ends: a bucket is a range of keys."""
    begin = np.array([-(-(i << 64) // buckets) for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(key, begin), len(key))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, size numbers of it."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _beside(sizes: np.ndarray) -> np.ndarray:
    """Which of the two times SIDE bytes beside an anchor are a variant's: left ones end at the anchor, right ones begin there."""
    at = np.arange(SIDE, dtype=np.uint8)
    return np.concatenate((at >= SIDE - sizes[:, :1], at < sizes[:, 1:]), axis=1)


def _distinct(key: np.ndarray, sides: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of variants by key in which equal ones are beside each other, and where in it a new variant begins.

    Two equal ones can be apart if a third has their 64-bit hash; they then count as two, with the same results.
    """
    rows = np.zeros((len(key), 40), np.uint8)
    rows[:, : 2 * SIDE], rows[:, 2 * SIDE : 2 * SIDE + 2] = sides, sizes
    words = rows.view(np.uint64)
    order = np.lexsort((_mixed(words), key))
    key, words = key[order], words[order]
    return order, np.nonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (words[1:] != words[:-1]).any(axis=1))))[0]


def _mixed(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _may_agree(key: np.ndarray, near: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a variant can share half of a window's other bytes or more on this side with another one of its anchor.

    near: the side's bytes from the anchor outwards. A hash decides, which can only let more of them pass.
    """
    half = SIDE // 2
    words = np.zeros((len(key), 16), np.uint8)
    words[:, :half] = near[:, :half]
    h = _mixed(np.column_stack((key, words.view(np.uint64))))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out & (sizes >= half)


def _most_shared(key: np.ndarray, near: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes from the anchor outwards each variant shares with another one of its anchor at most: in order, the
    nearest are beside each other."""
    rows = np.zeros((len(key), 24), np.uint8)
    rows[:, :SIDE] = near
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 2], words[:, 1], words[:, 0], key))
    near = near[order]
    apart = near[1:] != near[:-1]
    k = np.where(apart.any(axis=1), apart.argmax(axis=1), SIDE) * (key[order[1:]] == key[order[:-1]])
    out = np.zeros(len(key), np.int64)
    out[order[1:]] = k
    out[order[:-1]] = np.maximum(out[order[:-1]], k)
    return np.minimum(out, sizes)


def _may_share(key: np.ndarray, sides: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, bytes left, bytes right) of those variants that can share a window with another, and the bytes beside the
    anchor that such a window can cover.

    A window reaches half of its other bytes or more to the left or to the right, so one of these halves must occur twice.
    Those that drop out take away what others seemed to share with them, so the rest is looked at once more.
    """
    lone = np.concatenate(([True], key[1:] != key[:-1], [True]))
    some = np.nonzero(~(lone[1:] & lone[:-1]))[0]
    left, right, size = sides[some, :SIDE][:, ::-1], sides[some, SIDE:], sizes[some].astype(np.int64)
    keep = _may_agree(key[some], left, size[:, 0]) | _may_agree(key[some], right, size[:, 1])
    for _ in range(2):
        some, left, right, size = some[keep], left[keep], right[keep], size[keep]
        a, b = _most_shared(key[some], left, size[:, 0]), _most_shared(key[some], right, size[:, 1])
        keep = a + b >= SIDE
    return some[keep], a[keep], b[keep]


def _settle(key: np.ndarray, sides: np.ndarray, a: np.ndarray, b: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The least document of each window of variants of which a bytes left and b bytes right count, by a suffix sort of all.

    In the sorted string an anchor is one symbol, so its inner bytes, which all its variants share, aren't sorted again.
    """
    rows = np.empty((len(key), 2 * SIDE + 2), np.int32)
    rows[:, :SIDE], rows[:, SIDE + 1 : -1] = sides[:, :SIDE], sides[:, SIDE:]
    rows += 2
    rows[:, SIDE] = 258 + np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    rows[:, -1] = 1
    mask = np.ones(rows.shape, bool)
    beside = _beside(np.column_stack((a, b)))
    mask[:, :SIDE], mask[:, SIDE + 1 : -1] = beside[:, :SIDE], beside[:, SIDE:]
    flat = np.append(rows[mask], np.int32(0))
    n, size = a + b - SIDE + 1, a + b + 2
    starts = _runs(np.cumsum(size) - size, n)
    of = np.full(len(flat), -1)
    of[starts] = np.arange(len(starts))
    k = of[np.array(suffix_groups(flat))]
    k = k[k >= 0]
    p = starts[k]
    same = np.ones(len(p) - 1, bool)
    for j in range(REACH):
        x = flat[p + j]
        same &= x[1:] == x[:-1]
    first = np.nonzero(np.concatenate(([True], ~same)))[0]
    d = np.repeat(docs, n)[k]
    out = np.empty(len(starts), np.int64)
    out[k] = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
    return out


def least_of_windows(key: np.ndarray, sides: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each variant, and each of its windows, the least document that has the window, one after another. Variants are ordered by key."""
    n = sizes.sum(axis=1, dtype=np.int64) - SIDE + 1
    out = np.repeat(docs, n)
    some, a, b = _may_share(key, sides, sizes)
    begin = np.cumsum(n)[some] - n[some] + sizes[some, 0] - a
    group = np.nonzero(np.concatenate((np.ones(min(1, len(some)), bool), key[some[1:]] != key[some[:-1]])))[0]
    upto = np.append(np.cumsum(a + b + 2)[group[1:] - 1], (a + b + 2).sum()) if len(some) else np.zeros(0, np.int64)
    group, g = np.append(group, len(some)), 0
    while g < len(upto):
        z = max(g + 1, int(np.searchsorted(upto, SORTED + (upto[g - 1] if g else 0), side="right")))
        x = slice(group[g], group[z])
        v = some[x]
        out[_runs(begin[x], a[x] + b[x] - SIDE + 1)] = _settle(key[v], sides[v], a[x], b[x], docs[v])
        g = z
    return out


def least_documents(variants: list[tuple[int, bytes, bytes]], docs: list[int]) -> list[np.ndarray]:
    """least_of_windows() of variants (anchor, bytes left, bytes right) that are ordered by anchor, a list of their windows each."""
    sides = np.frombuffer(b"".join(left.rjust(SIDE, b"\0") + right.ljust(SIDE, b"\0") for _, left, right in variants), np.uint8).reshape(-1, 2 * SIDE)
    sizes = np.array([(len(left), len(right)) for _, left, right in variants], np.uint8).reshape(-1, 2)
    out = least_of_windows(np.array([k for k, *_ in variants], np.uint64), sides, sizes, np.array(docs, np.int64))
    return np.split(out, np.cumsum(sizes.sum(axis=1, dtype=np.int64) - SIDE + 1)[:-1])


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's texts as one array, and where each of them ends."""
    return np.frombuffer(_open(row["texts"]), np.uint8), np.cumsum(np.frombuffer(_open(row["sizes"]), "<i8"))


def _ids(row: dict) -> np.ndarray:
    return np.array([LAST if d is None else d for d in row["ids"]], np.int64)


class _Chunk:
    """A chunk's places of shared anchors and its different variants, both in the order of the variants.

    first, size, of: first window, number of windows and variant of each place; key, sides, sizes, least: of each variant;
    cuts: where each bucket's variants begin.
    """

    def __init__(self, row: dict, answers: pa.Table, buckets: int) -> None:
        flat, ends = _texts(row)
        first, last, spot, key = anchors(flat, ends)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        counts = np.diff(_cuts(key[new], buckets)).tolist()
        bits = [np.unpackbits(np.frombuffer(r["a"], np.uint8), count=counts[r["key"]]) for r in sorted(answers.to_pylist(), key=lambda r: r["key"])]
        keep = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[np.cumsum(new) - 1]
        order, key = order[keep], key[keep]
        first, last, spot = first[order], last[order], spot[order]
        sizes = np.column_stack((spot - first, last + WINDOW - ANCHOR - spot)).astype(np.uint8)
        around = np.concatenate((np.zeros(SIDE, np.uint8), flat, np.zeros(SIDE, np.uint8)))
        span = np.lib.stride_tricks.sliding_window_view(around, ANCHOR + 2 * SIDE)[spot] if len(spot) else np.zeros((0, ANCHOR + 2 * SIDE), np.uint8)
        sides = np.concatenate((span[:, :SIDE], span[:, SIDE + ANCHOR :]), axis=1)
        sides *= _beside(sizes)
        order, start = _distinct(key, sides, sizes)
        self.first, self.size = first[order], (last - first + 1)[order]
        self.of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        self.owner = _ids(row)[np.searchsorted(ends, self.first, side="right")]
        self.least = np.minimum.reduceat(self.owner, start) if len(start) else self.owner
        start = order[start]
        self.key, self.sides, self.sizes = key[start], sides[start], sizes[start]
        self.cuts = _cuts(self.key, buckets).tolist()


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): texts without bytes that a 50-byte string covers which also starts in a document of smaller id.

    Strings are judged on the input. Null texts are empty. A null id counts as larger than any other, and rows with
    equal ids never remove from each other. Texts under 50 bytes lose nothing. An empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    buckets = partitions_for(spark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in texts], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([_pack(sizes)], pa.binary()), pa.array([_pack(b"".join(texts))], pa.binary())], names=["chunk", "ids", "sizes", "texts"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield close()
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield close()

    packed = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(keep, "chunk long, ids array<long>, sizes binary, texts binary"), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                flat, ends = _texts(row)
                first, _, _, key = anchors(flat, ends)
                if not len(key):
                    continue
                order = np.argsort(key)
                key, text = key[order], np.searchsorted(ends, first, side="right")[order]
                start = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
                many = np.maximum.reduceat(text, start) > np.minimum.reduceat(text, start)
                key = key[start]
                cuts = _cuts(key, buckets).tolist()
                for part, (x, y) in enumerate(pairwise(cuts)):
                    if x < y:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([_pack(np.diff(key[x:y], prepend=np.uint64(0)))], pa.binary()), pa.array([_pack(np.packbits(many[x:y]))], pa.binary())], names=["key", "chunk", "a", "b"]
                        )

    def meet(asked: pa.Table) -> pa.Table:
        """Of each chunk's anchors, in their order, whether another chunk has it too, or several documents of this one."""
        rows = asked.to_pylist()
        keys = [np.cumsum(np.frombuffer(_open(r["a"]), "<u8")) for r in rows]
        many = [np.unpackbits(np.frombuffer(_open(r["b"]), np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, keys, strict=True)]
        flat = np.sort(np.concatenate([*keys, *(k[m] for k, m in zip(keys, many, strict=True))]))
        twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
        out = [np.packbits(np.isin(k, twice, assume_unique=True)).tobytes() for k in keys]
        return pa.table([asked.column("chunk"), asked.column("key"), pa.array(out, pa.binary())], names=["chunk", "key", "a"])

    asked = packed.mapInArrow(ask, "key int, chunk long, a binary, b binary")
    shared = stored(asked.groupBy("key").applyInArrow(meet, "chunk long, key int, a binary"), "anchors")

    def tell(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        c = _Chunk(row, answers, buckets)
        out = []
        for part, (x, y) in enumerate(pairwise(c.cuts)):
            if x < y:
                out.append((part, row["chunk"], _pack(np.diff(c.key[x:y], prepend=np.uint64(0))), _pack(c.sizes[x:y]), _pack(c.sides[x:y][_beside(c.sizes[x:y])]), _pack(c.least[x:y])))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["key", "chunk", "a", "b", "c", "d"])

    told = packed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(tell, "key int, chunk long, a binary, b binary, c binary, d binary")

    def sort(told: pa.Table) -> pa.Table:
        """Of each window of each chunk's variants, in their order, whether a smaller document has it than the chunk's least with the variant."""
        rows = told.to_pylist()
        keys = [np.cumsum(np.frombuffer(_open(r["a"]), "<u8")) for r in rows]
        sizes = np.concatenate([np.frombuffer(_open(r["b"]), np.uint8) for r in rows]).reshape(-1, 2)
        sides = np.zeros((len(sizes), 2 * SIDE), np.uint8)
        sides[_beside(sizes)] = np.concatenate([np.frombuffer(_open(r["c"]), np.uint8) for r in rows])
        key, own = np.concatenate(keys), np.concatenate([np.frombuffer(_open(r["d"]), "<i8") for r in rows])
        order, start = _distinct(key, sides, sizes)
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        least, start = np.minimum.reduceat(own[order], start), order[start]
        windows = least_of_windows(key[start], sides[start], sizes[start], least)
        n = sizes[start].sum(axis=1, dtype=np.int64) - SIDE + 1
        begin, out, cuts = np.cumsum(n) - n, [], np.cumsum([0, *map(len, keys)]).tolist()
        for x, y in pairwise(cuts):
            v = of[x:y]
            out.append(np.packbits(windows[_runs(begin[v], n[v])] < np.repeat(own[x:y], n[v])).tobytes())
        return pa.table([told.column("chunk"), told.column("key"), pa.array(out, pa.binary())], names=["chunk", "key", "a"])

    settled = stored(told.groupBy("key").applyInArrow(sort, "chunk long, key int, a binary"), "windows")

    def cut(key: tuple, chunk: pa.Table, both: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        flat, ends = _texts(row)
        windows, answers = both.filter(both.column("settled")).to_pylist(), both.filter(pa.compute.invert(both.column("settled")))
        c = _Chunk(row, answers, buckets)
        hit = np.zeros(len(flat) + WINDOW, bool)
        if len(c.of):
            n = c.sizes.sum(axis=1, dtype=np.int64) - SIDE + 1
            upto = np.append(0, np.cumsum(n))
            less = np.concatenate([np.unpackbits(np.frombuffer(r["a"], np.uint8), count=upto[c.cuts[r["key"] + 1]] - upto[c.cuts[r["key"]]]) for r in sorted(windows, key=lambda r: r["key"])])
            hit[WINDOW + _runs(c.first, c.size)] = less[_runs(upto[c.of], c.size)] | np.repeat(c.owner > c.least[c.of], c.size)
        hit = np.cumsum(hit, dtype=np.int32)
        gone = hit[WINDOW:] > hit[:-WINDOW]
        begin = np.append(0, ends[:-1])
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        some = begin[begin < ends]
        fresh[some] = gone[some]
        removed, spans = np.zeros((2, len(flat) + 1), np.int32)
        np.cumsum(gone, out=removed[1:])
        np.cumsum(fresh, out=spans[1:])
        kept = memoryview(flat[~gone])
        upto = ends - removed[ends]
        hashes = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip((begin - removed[begin]).tolist(), upto.tolist(), strict=True)]
        return pa.table([pa.array(row["ids"], pa.int64()), *(pa.array(x, pa.int64()) for x in (ends - begin, removed[ends] - removed[begin], spans[ends] - spans[begin])), pa.array(hashes, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = shared.select("chunk", "key", "a", F.lit(False).alias("settled")).union(settled.select("chunk", "key", "a", F.lit(True).alias("settled")))
    return packed.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
