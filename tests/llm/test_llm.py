"""Each operator on a table of edge cases against a brute-force version, and on an empty table."""

import functools
import hashlib
import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.llm import decontamination, exact_dedup, language, language_model, mixing, quality, sharding, simhash, suffix_dedup, toxicity
from braidwork.llm.common import components, fold_of


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_quality(docs, none, rows):
    out = quality.scored(docs, sample=30).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= quality.KEEP) for r in out)
    assert quality.scored(none).count() == 0
    kept = quality.keep_good(docs, sample=30)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["kept"])


def test_quality_labellers_weigh():
    """EM finds the good side and trusts the labeller that agrees with the others."""
    good = sum(v * 3**i for i, v in enumerate([2, 1, 1, 2, 1, 2, 1, 2, 1]))
    bad = sum(v * 3**i for i, v in enumerate([0, 1, 0, 1, 1, 1, 1, 0, 1]))
    p = quality.weigh({good: 900, bad: 100, quality.SILENT: 50})
    assert p[good] > 0.9 and p[bad] < 0.1 and 0.5 < p[quality.SILENT] < 1
    assert quality.weigh({}) == {} and quality.weigh({quality.SILENT: 3}) == {quality.SILENT: 0.5}


def test_quality_em_and_scorer_by_hand():
    """EM over rows one by one, and the scorer's gradient steps in plain loops, against those over patterns and arrays."""
    rng = random.Random(7)
    rows_ = []
    for _ in range(300):
        good = rng.random() < 0.7
        rows_.append(tuple(rng.choices((0, 1, 2), (0.05, 0.45, 0.5) if good else (0.5, 0.4, 0.1))[0] for _ in range(quality.LABELLERS)))
    rows_ += [(1,) * quality.LABELLERS] * 5
    code = lambda v: sum(x * 3**i for i, x in enumerate(v))
    got = quality.weigh(Counter(map(code, rows_)))
    heard = [v for v in rows_ if any(x != 1 for x in v)]
    p = [1 / (1 + math.exp(-(v.count(2) - 3 * v.count(0)) - 0.5)) for v in heard]
    for _ in range(200):
        prior = [(sum(1 - x for x in p) + 1) / (len(p) + 2), (sum(p) + 1) / (len(p) + 2)]
        share = [[[(sum((x if k else 1 - x) for x, v in zip(p, heard, strict=True) if v[j] == a) + 0.1) / (sum((x if k else 1 - x) for x in p) + 0.3) for a in range(3)] for j in range(quality.LABELLERS)] for k in range(2)]
        now = [1 / (1 + math.exp(sum(math.log(share[0][j][a]) - math.log(share[1][j][a]) for j, a in enumerate(v)) + math.log(prior[0]) - math.log(prior[1]))) for v in heard]
        done, p = max(abs(a - b) for a, b in zip(p, now, strict=True)) < 1e-9, now
        if done:
            break
    assert all(got[code(v)] == pytest.approx(x, abs=1e-5) for v, x in zip(heard, p, strict=True))
    assert got[quality.SILENT] == pytest.approx(sum(p) / len(p), abs=1e-5)
    sample = [(np.array(sorted(rng.sample(range(40), 4))), np.array([rng.random() for _ in range(4)]), rng.random()) for _ in range(30)]
    w = quality.fit(sample, rounds=12)
    hand, square, bias = [0.0] * 40, [1e-8] * 41, 0.0
    n = [sum(y < 0.5 for *_, y in sample), sum(y >= 0.5 for *_, y in sample)]
    for _ in range(12):
        g = [1e-4 * x for x in hand] + [0.0]
        for slots, x, y in sample:
            off = (1 / (1 + math.exp(-sum(hand[s] * v for s, v in zip(slots, x, strict=True)) - bias)) - y) / max(1, n[y >= 0.5])
            for s, v in zip(slots, x, strict=True):
                g[s] += v * off
            g[40] += off
        square = [a + b * b for a, b in zip(square, g, strict=True)]
        hand = [h - 0.5 * g[i] / math.sqrt(square[i]) for i, h in enumerate(hand)]
        bias -= 0.5 * g[40] / math.sqrt(square[40])
    assert w[:40] == pytest.approx(hand, abs=1e-9) and w[-1] == pytest.approx(bias, abs=1e-9)


def test_language(docs, none, rows):
    model = language.trained(docs.where("lang is not null"))
    out = language.identified(docs, model).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[2] and r[0] is not None}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth]) > 0.95
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (103, 104, 105, 112))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    assert language.identified(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, language.trained(none)).collect()} == {"und"}


def test_language_sample_is_bounded(spark, monkeypatch):
    """Thousands of rows with one id, alike or not, bring no more than the sample to the driver."""
    same = spark.range(5000).selectExpr("7L as doc_id", "'the same text' as text", "'en' as lang")
    other = spark.range(5000).selectExpr("7L as doc_id", "concat('text ', id) as text", "'fr' as lang")
    rest = spark.range(50).selectExpr("100 + id as doc_id", "concat('text number ', id) as text", "'en' as lang")
    seen = []
    fit = language.Model.fit
    monkeypatch.setattr(language.Model, "fit", lambda x, langs: seen.extend(langs) or fit(x, langs))
    language.trained(same.union(other).union(rest), per_language=30)
    assert Counter(seen) == {"en": 30, "fr": 30}


def test_language_is_kernel_ridge():
    """Presence rows against n-grams in plain loops; with all rows as landmarks, scores are those of exact kernel ridge."""
    rng = random.Random(6)
    syllables = {"a": "the ing tion er an".split(), "b": "eau oui que ment la".split(), "c": "sch ung der ich zu".split()}
    lang = [rng.choice("abc") for _ in range(60)]
    texts_ = [" ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 20))) + rng.choice(("", "!", " É 7")) for k in lang]
    x = language.presence(texts_)
    for t, row in zip(texts_, x, strict=True):
        c = [ord(ch) if ord(ch) >= 128 or "a" <= ch <= "z" else 32 for ch in f" {t.lower()} "]
        slots = set()
        for i in range(len(c)):
            h = 0
            for k in range(1, min(3, len(c) - i) + 1):
                h = (h * 0x9E3779B1 + c[i + k - 1] + k) % 2**32
                slots.add((((h ^ (h >> 15)) * 0x85EBCA77) % 2**32) >> 19)
        assert set(np.nonzero(row)[0].tolist()) == slots
    model = language.Model.fit(x, lang)
    assert len(model.landmarks) == 60 <= language.LANDMARKS
    u = x / np.sqrt(x.sum(axis=1, keepdims=True))
    target = np.array([[1.0 if k == m else -1.0 for m in "abc"] for k in lang])
    share = np.array([1 / lang.count(k) for k in lang])
    share *= len(lang) / share.sum()
    base = (share[:, None] * target).sum(0) / share.sum()
    kernel = u @ u.T
    exact = kernel @ np.linalg.solve(kernel + np.diag(language.RIDGE * len(lang) / 100 / share), target - base) + base
    got = model.unit(x) @ model.landmarks.T @ model.weights + model.base
    assert np.abs(got - exact).max() < 5e-3
    assert model.predict(texts_)[0] == ["abc"[k] for k in exact.argmax(axis=1)]


def test_language_presence_is_whole():
    long = "a" * (language.CHARS - 1) + "bc" + "d" * 10
    ab, whole = language.presence(["a" * 9 + "bc" + "d" * 9]), language.presence([long])
    assert (whole == ab).all()


def katz_by_hand(tok):
    """score(words) and its context sums, for (flag, words with the end) texts: counts and recursion in plain loops."""
    uni, bi, tri, n = Counter(), Counter(), Counter(), 0
    for flag, x in tok:
        if flag:
            y = [0, *x]
            n, _, _, _ = n + 1, uni.update(x), bi.update(zip(y, x, strict=False)), tri.update(zip(y, x, x[1:], strict=False))
    total, kinds, top = sum(uni.values()), len(uni), language_model.GOOD_TURING
    star2, star3 = (language_model.Stars([sum(c == r for c in g.values()) for r in range(top + 2)]) for g in (bi, tri))
    low = lambda w: (uni[w] + 0.5) / (total + 0.5 * (kinds + 1))
    after = defaultdict(set)
    for u, w in bi:
        after[u,].add(w)
    for u, v, w in tri:
        after[u, v].add(w)
    times = lambda h: (n if h[0] == 0 else uni[h[0]]) if len(h) == 1 else bi[h]

    @functools.cache
    def p(h, w):
        if not h:
            return low(w)
        c = tri[*h, w] if len(h) == 2 else bi[*h, w]
        if c:
            return float((star3 if len(h) == 2 else star2).of(np.array([c]))[0]) / times(h)
        return weight(h) * p(h[1:], w)

    @functools.cache
    def weight(h):
        if h not in after:
            return 1.0
        return (1 - sum(p(h, w) for w in after[h])) / (1 - sum(p(h[1:], w) for w in after[h]))

    score = lambda x: sum(math.log10(p(h, w)) for h, w in zip([(0,), *zip([0, *x], x, strict=False)], x, strict=False))
    return score, p, uni, after, low, total


@pytest.mark.parametrize("chunk", [10 << 20, 2000])
def test_language_model(docs, none, rows, chunk, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK", chunk)
    flagged = docs.select("doc_id", (fold_of(docs.doc_id, 5) != 1).alias("flag"), "text")
    tok = [(i, zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1, t.encode().lower().split() + [None]) for i, t in texts(rows)]
    score, p, uni, after, low, total = katz_by_hand([x[1:] for x in tok])
    for h in [*after][:: max(1, len(after) // 300)]:  # all words and the unknown one share the whole of 1
        assert sum(p(h, w) for w in uni) + p(h, b"never seen") == pytest.approx(1)
    want = {(i, bytes(str(x), "utf8")): (len(x), sum(uni[w] > 0 for w in x), total, sum(math.log10(low(w)) for w in x), score(x)) for i, _, x in tok}
    got = language_model.katz(flagged).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in tok)
    by_id = defaultdict(list)
    for (i, _), v in want.items():
        by_id[i].append(v)
    for r in got:
        mine = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert any(mine == pytest.approx(v, rel=1e-5, abs=1e-4) for v in by_id[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32((str(r["doc_id"]) if r["doc_id"] is not None else "").encode()) % 5 == 1)
    assert language_model.katz(none.select("doc_id", (fold_of(none.doc_id, 5) != 1).alias("flag"), "text")).count() == 0


def test_language_model_is_lean():
    """What a task holds at once of a chunk's n-grams: 95 bytes a token before places were 32-bit, and 41 in the end."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 1500)
    w = np.minimum((rng.pareto(0.6, sizes.sum()) * 3).astype(np.int64), 299_996) + language_model.UNKNOWN
    w[np.cumsum(sizes) - 1] = language_model.END
    tracemalloc.start()
    g = language_model.Grams(sizes, w, 300_000)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 32 * len(w) and most < 60 * len(w)
    v = np.concatenate(([0], w[:-1]))
    v[g.start] = language_model.BEGIN
    assert (g.v[g.pair_of] == v).all() and (g.w[g.pair_of] == w).all() and g.n.sum() == len(w)
    assert (g.u[g.triple_of] == v[g.later - 1]).all() and (g.owner[g.triple_of] == g.pair_of[g.later]).all()


def test_language_model_without_training(docs):
    got = language_model.katz(docs.select("doc_id", F.lit(False).alias("flag"), "text")).collect()
    assert {(r["n_known"], r["train_tokens"], round(r["score"], 9), round(r["base_score"], 9)) for r in got} == {(0, 0, 0.0, 0.0)}


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in texts(rows):
        groups[t].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    return out


def test_exact_dedup(docs, none, rows):
    old, new = docs.where(fold_of(docs.doc_id, 2) == 0), docs.where(fold_of(docs.doc_id, 2) == 1)
    assert Counter(map(tuple, exact_dedup.exact_groups(old, new).collect())) == exact_groups(rows)
    assert Counter(map(tuple, exact_dedup.exact_groups(none, docs).collect())) == exact_groups(rows)
    assert exact_dedup.exact_groups(none, none).count() == 0


def test_exact_dedup_tells_clashes_apart(docs, rows):
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 1)
    out = exact_dedup.exact_groups(docs.where(fold_of(docs.doc_id, 2) == 0), docs.where(fold_of(docs.doc_id, 2) == 1), weak).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out) == Counter(x[:4] for x in exact_groups(rows).elements())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = exact_dedup.BinaryFuse.build(keys)
    assert f.has(keys).all()
    assert f.has(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01


def test_toxicity(spark, docs, none, rows):
    extra = [(200 + i, f"some words {'m0ron' if i % 2 else 'plain'} and more words {i}") for i in range(60)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    labels = spark.createDataFrame([(200 + i, 0, i % 2) for i in range(60)] + [(103, 0, 1), (104, 1, 0), (None, None, None), (201, 0, None)], "doc_id long, quality int, toxic int")
    matcher, w = toxicity.trained(more, labels)
    assert "moron" in matcher.lexicon
    out = {r["doc_id"]: r for r in toxicity.scored(more, matcher, w).collect()}
    assert all(out[200 + i]["predicted"] == i % 2 for i in range(60))
    assert out[103]["predicted"] == out[104]["predicted"] == 0
    assert toxicity.scored(none, matcher, w).count() == 0
    assert toxicity.scored(docs, *toxicity.trained(none, labels)).count() == len(rows)


def test_toxicity_folds_and_excepts():
    m = toxicity.Matcher({"idiot": 2.0, "scumb*": 1.0}, {"no idiot"})
    assert toxicity.folded("1D10T сlown ｉｄｉｏｔ 2024") == "idiot clown idiot 2024"
    assert [h[2] for h in m.hits(toxicity.folded("an 1d10t, a scumbag and no idiot; idiots"))] == [2.0, 1.0]


def test_suffix_groups():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_groups(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_variants_share_or_stay_out(monkeypatch):
    """Variants that share half a window but no whole one aren't sorted; all windows still get their least document."""
    rng = random.Random(3)
    pool = [bytes(rng.choice((0, 97, 98)) for _ in range(8)) + end for end in (b"\0" * 10, b"ab" * 5, b"\0a" * 5)]
    side = lambda: rng.choice(pool)[-rng.randint(9, 18) :]
    variants = sorted({(k, side(), side()[::-1]) for k in range(30) for _ in range(20)}, key=lambda v: v[0])
    docs = [rng.randrange(1000) for _ in variants]
    least = defaultdict(lambda: 1000)
    windows = [[(k, left[i:], right[: suffix_dedup.REACH - 1 - len(left[i:])]) for i in range(len(left) + len(right) - suffix_dedup.REACH + 2)] for k, left, right in variants]
    for own, d in zip(windows, docs, strict=True):
        for w in own:
            least[w] = min(least[w], d)
    got = suffix_dedup.least_documents(variants, docs)
    assert [x.tolist() for x in got] == [[least[w] for w in own] for own in windows]
    assert any(x.tolist() != [d] * len(x) for x, d in zip(got, docs, strict=True))
    monkeypatch.setattr(suffix_dedup, "suffix_groups", None)
    apart = [(1, b"abcdefgh" + b"x" * 10, b"q" * 7 + b"1" * 11), (1, b"ABCDEFGH" + b"x" * 10, b"q" * 7 + b"2" * 11)]
    assert [set(x.tolist()) for x in suffix_dedup.least_documents(apart, [4, 5])] == [{4}, {5}]


def calls_of(run):
    """How many functions, Python's own and C's, a call runs."""
    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = run()
    finally:
        sys.setprofile(None)
    return n, out


def test_suffix_chunk_is_arrays(monkeypatch):
    """A chunk's places and a bucket's variants cost no calls each: of these, a chunk made 2.6 a place, a bucket 19 a variant."""
    rng = random.Random(4)
    docs = [(None if i % 40 == 7 else i % 350, bytes(rng.choice(b"abcdefgh \0") for _ in range(rng.choice((0, 30, 50, 51, 400))))) for i in range(400)]
    docs += [(1000 + i, x[rng.randrange(40) :] + b"end") for i, (_, x) in enumerate(docs) if len(x) > 300]

    def chunk(some):
        sizes = np.array([len(x) for _, x in some], np.int64)
        row = {"ids": [d for d, _ in some], "sizes": suffix_dedup._pack(sizes), "texts": suffix_dedup._pack(b"".join(x for _, x in some))}
        flat, ends = suffix_dedup._texts(row)
        key = np.unique(suffix_dedup.anchors(flat, ends)[3])
        cuts = suffix_dedup._cuts(key, 3)
        answers = pa.table({"key": [2, 0, 1], "a": [np.packbits(np.ones(cuts[k + 1] - cuts[k], bool)).tobytes() for k in (2, 0, 1)]})
        return flat, ends, *calls_of(lambda: suffix_dedup._Chunk(row, answers, 3))

    chunk(docs[:40])  # imports what to_pylist() needs
    few, many = chunk(docs[:40])[2], chunk(docs)[2]
    assert many < few + 100 < 1000
    monkeypatch.setattr(suffix_dedup, "PIECE", 97)
    flat, ends, _, c = chunk(docs)
    begin = np.append(0, ends[:-1])
    want = {p for x, y in zip(begin.tolist(), ends.tolist(), strict=True) for p in range(x, y - 49)}
    assert sorted(p for f, n in zip(c.first.tolist(), c.size.tolist(), strict=True) for p in range(f, f + n)) == sorted(want)
    variant, least = {}, defaultdict(lambda: suffix_dedup.LAST)
    for f, n, v, owner in zip(c.first.tolist(), c.size.tolist(), c.of.tolist(), c.owner.tolist(), strict=True):
        t = int(np.searchsorted(ends, f, side="right"))
        assert owner == (suffix_dedup.LAST if docs[t][0] is None else docs[t][0])
        left, right = c.sizes[v].tolist()
        x = flat[f : f + n + 49].tobytes()
        assert (left + 32 + right, c.sides[v].tobytes()) == (len(x), x[:left].rjust(18, b"\0") + x[left + 32 :].ljust(18, b"\0"))
        anchor = (x[left : left + 32], int(c.key[v]), left, right, x)
        assert variant.setdefault(v, anchor) == anchor
        least[v] = min(least[v], owner)
    assert len(set(variant.values())) == len(variant) == len(c.key) and len({(a, k) for a, k, *_ in variant.values()}) == len({k for _, k, *_ in variant.values()})
    assert c.least.tolist() == [least[v] for v in range(len(c.key))]
    assert len(c.of) > len(c.key) and (np.diff(c.key.astype(object)) >= 0).all()

    key = np.repeat(np.arange(3000, dtype=np.uint64), 2)
    sides, sizes = np.random.default_rng(1).integers(0, 256, (6000, 36), np.uint8), np.full((6000, 2), 18, np.uint8)
    n, got = calls_of(lambda: suffix_dedup.least_of_windows(key, sides, sizes, np.arange(6000)))
    assert n < 1000 and (got == np.repeat(np.arange(6000), 19)).all()


def test_suffix_dedup(docs, none, rows):
    first = {}
    data = [(i, t.encode()) for i, t in texts(rows)]
    rank = lambda i: suffix_dedup.LAST if i is None else i
    for i, x in data:
        for p in range(len(x) - 49):
            first[x[p : p + 50]] = min(first.get(x[p : p + 50], suffix_dedup.LAST), rank(i))
    want = Counter()
    for i, x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < rank(i):
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.without_repeats(docs).collect())) == want
    assert suffix_dedup.without_repeats(none).count() == 0


def test_sharding(docs, none, rows):
    out = sharding.balanced_shards(docs, shards=5).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts(rows))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    together = defaultdict(set)
    for r in out:
        together[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    assert sharding.balanced_shards(none).count() == 0
    rows_out = sharding.sharded(docs, shards=5)
    assert rows_out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in rows_out.collect()) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in out)
    assert rows_out.where("_id <> 777 or _row <> 777 or `a.b` <> 777").count() == 0 and sharding.sharded(none).count() == 0


def test_sharding_cuts_fewer_edges(spark):
    """Label propagation against its start: links of equal texts that cross shards, under exact quotas."""
    rng = random.Random(8)
    texts = [f"t{k}" for k in range(60) for _ in range(rng.randint(1, 12))]
    out = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=6).collect()
    where = defaultdict(list)
    for r in out:
        where[texts[r["doc_id"]]].append(r["shard"])
    cut = lambda of: sum(a != b for s in of for i, a in enumerate(s) for b in s[:i])
    k = iter(range(len(texts)))
    start = [[next(k) % 6 for _ in s] for s in where.values()]
    assert cut(where.values()) < 0.2 * cut(start)


def test_sharding_flows():
    assert sharding.flows([[0, 5], [3, 0]], [0, 0]) == [[0, 3], [3, 0]]
    assert sharding.flows([[0, 5], [0, 0]], [0, 2]) == [[0, 2], [0, 0]]
    assert sharding.flows([[0, 5], [0, 0], [4, 5]], [2, 5]) == [[0, 2], [0, 0], [4, 2]]


def test_decontamination(spark, docs, none, rows):
    rng = random.Random(9)
    item = [f"w{rng.randint(0, 400)}x" for _ in range(40)]
    edited = list(item)
    for k in (7, 15, 22, 31):
        edited[k] = "other"
    del edited[18]
    planted = [(300, "intro words " + " ".join(item) + " outro"), (301, "So: " + " ".join(edited) + "!"), (302, " ".join(f"{w}%%%" for w in item)), (303, " ".join(item[:6]) + " nothing else of it")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (None, "zz1 zz2 zz3 zz4 zz5")], "item_id long, text string")
    out = decontamination.leaks(more, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(300, 1), (301, 1), (302, 1)]
    assert {r["doc_id"]: r["score"] for r in out}[300] == 1
    clean = decontamination.without_leaks(more, bench)
    assert clean.count() == len(rows) + 1
    assert decontamination.leaks(none, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_all():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(30)]
    items = [(k, [rng.choice(names) for _ in range(rng.randint(3, 30))]) for k in range(40)]
    texts_ = []
    for _, w in items:
        for share in (0.1, 0.3, 0.5):
            copy = []
            for x in w:
                kind = rng.random()
                copy += [x] if kind > share else rng.choice(([], ["other"], [x, "more"], [rng.choice(names)]))
            texts_.append(" ".join(["before"] * rng.randint(0, 90) + [rng.choice(names) for _ in range(20)] + copy + [rng.choice(names) for _ in range(20)]))
        texts_.append(" ".join(y for x in w for y in (x, "between")))
        texts_.append(" ".join("other" if i % 3 == 2 else x for i, x in enumerate(w)))
    counts = Counter(x for t in texts_ for x in decontamination.words(t))
    s = decontamination.Searcher(items, counts, sum(counts.values()))
    got = [{k: max(y[1] for y in found if y[0] == k) for k in {y[0] for y in found if y[1] >= 0.5}} for found in s.search(texts_)]
    leaks = 0
    for t, text in enumerate(texts_):
        ids = [s.number.get(x, -2) for x in decontamination.words(text)]
        a = np.full((len(items), 30), -1)
        for k, x in enumerate(s.ids):
            a[k, : len(x)] = x
        best = decontamination.smith_waterman(a, np.tile(ids, (len(items), 1))) / np.array([2 * len(x) for x in s.ids])
        assert got[t] == {k: x for k, x in enumerate(best.tolist()) if x >= 0.5}
        leaks += len(got[t])
    assert leaks > 200


def test_decontamination_of_short_and_long_items(spark):
    long = [f"q{i}" for i in range(3000)]
    items = spark.createDataFrame([(1, "Zanzibar"), (2, "blue whale"), (3, " ".join(long)), (2, "blue whale"), (4, ""), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "to zanzibar!"), (2, "a blue whale"), (3, "blue big whale"), (4, "a whale blue"), (5, " ".join(long[:1000] + ["x"] + long[1000:2500])), (6, " ".join(long[:1400]))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 3)} and got[2, 2] == 1 and got[5, 3] == pytest.approx(4999 / 6000)
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, items).collect()) == [3, 4, 6]


def test_smith_waterman():
    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (20, 9)), rng.integers(0, 4, (20, 14))
    assert decontamination.smith_waterman(a, b).tolist() == [slow(x, y) for x, y in zip(a, b, strict=True)]


def test_mixing(docs, none, rows):
    out = mixing.mixed(docs, shards=3).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left, free = left - sum(3.0 * size[s] for s in over), free - over
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["parts"]) == math.ceil(r["taken"] / r["size"] if r["size"] else 0) and sum(x["words"] for x in r["parts"]) == r["taken"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    assert mixing.mixed(none).count() == 0
    again = mixing.mixed(docs, shards=3).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))


def test_mixing_follows_the_tree(spark):
    """The tree's quotas add up, shards draw disjoint units in order, and many blocks are summed like few."""
    rng = random.Random(9)
    blocks = [(s, b, rng.randint(0, 50), p, r) for s, p, r, n in (("a", 2, 700, 90), ("b", 0, 333, 40), (None, 1, 0, 12)) for b in range(n)]
    df = spark.createDataFrame(blocks, "source string, block long, block_size long, passes long, rest long")
    for cell in (4096, 7):
        mixing.CELL_BLOCKS, before = cell, mixing.CELL_BLOCKS
        try:
            got = mixing.drawn(df, 5, 3).collect()
        finally:
            mixing.CELL_BLOCKS = before
        units = {(r["source"], u["unit"]): (u["shard"], u["words"], r["block"]) for r in got for u in r["to"]}
        assert len(units) == sum(len(r["to"]) for r in got)
        for s, passes, rest in (("a", 2, 700), ("b", 0, 333), (None, 1, 0)):
            mine = [units[s, k] for k in range(sum(x == s for x, _ in units))]  # numbers without gaps
            assert [x[0] for x in mine] == sorted(x[0] for x in mine)
            size = sum(b[2] for b in blocks if b[0] == s)
            assert sum(x[1] for x in mine) == passes * size + rest
        tree = mixing.splitting_tree(spark.createDataFrame([(s, sum(x == s for x, _ in units)) for s in ("a", "b", None)], "source string, units long"), 5, 3).collect()
        quota = {(r["source"], r["shard"]): r["units"] for r in tree}
        assert quota == Counter((s, x[0]) for (s, _), x in units.items())
        per = Counter(x[0] for x in units.values())
        assert len(per) == 5 and max(per.values()) - min(per.values()) <= 3


def test_repeated(spark, docs, none):
    """Rows pass with all their columns as often as whole copies are drawn; nothing else changes."""
    got = Counter(r["doc_id"] for r in mixing.repeated(docs, shards=3).collect())
    want, rows = Counter(), Counter()
    for r in mixing.mixed(docs, shards=3).collect():
        rows[r["doc_id"]] += 1
        want[r["doc_id"]] += sum(2 * x["words"] >= r["size"] for x in r["parts"]) if r["size"] else 1
    assert {i: n for i, n in got.items() if rows[i] == 1} == {i: n for i, n in want.items() if n and rows[i] == 1}
    out = mixing.repeated(docs, shards=3)
    assert out.columns == docs.columns and out.where("_id <> 777 or _KEY <> 777 or copies <> 777").count() == 0
    assert mixing.repeated(none).count() == 0


def test_hypergeometric(spark):
    from pyspark.sql import functions as F

    got = spark.range(20_000).select(mixing.hypergeometric((F.col("id") + 0.5) / 20_000, F.lit(30), F.lit(100), F.lit(20)).alias("k")).groupBy("k").count().collect()
    for r in got:
        assert r["count"] / 20_000 == pytest.approx(math.comb(30, r["k"]) * math.comb(70, 20 - r["k"]) / math.comb(100, 20), abs=2e-4)


def brute_components(fp, budget):
    keys = sorted(fp)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for k in keys:
        ids = [i for i in fp[k] if i is not None]
        if ids:
            least[find(k)] = min(least.get(find(k), ids[0]), *ids)
    return {k: least.get(find(k)) for k in keys}


def test_simhash(docs, none, rows):
    fp = defaultdict(list)
    for i, t in texts(rows):
        fp[simhash.majority(simhash.hashed(simhash.shingles(t.encode(), 3)))].append(i)
    comp = brute_components(fp, 2)
    want = Counter((i, f"{k:016x}", comp[k]) for k, ids in fp.items() for i in ids)
    assert Counter(map(tuple, simhash.near_components(docs).collect())) == want
    assert simhash.near_components(none).count() == 0


@pytest.mark.parametrize("hot", [10**6, 40])
def test_trie_join(spark, hot):
    rng = random.Random(2)
    values = set()
    for base in (rng.getrandbits(64), 0, 2**64 - 1):
        for _ in range(150):
            values.add(base ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 4)))))
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    want = {tuple(sorted((signed[a], signed[b]))) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    got = [tuple(r) for r in simhash.linked(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), 2, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_dedup_stage(spark, docs, rows):
    rng = random.Random(4)
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    near = list(text)
    near[50] = near[150] = near[250] = "edited"
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(400, " ".join(text)), (401, " ".join(near)), (402, " ".join(text[:100] + [f"q{i}" for i in range(200)]))], "doc_id long, text string"))
    kept = simhash.one_of_each(more).collect()
    assert Counter(r["doc_id"] for r in kept if r["doc_id"] in (400, 401, 402)) == {400: 1, 402: 1}
    assert len({r["text"] or "" for r in kept}) == len(kept)
    whole = simhash.one_of_each(docs)
    assert whole.columns == docs.columns and whole.where("_id <> 777 or _KEY <> 777 or root <> 777").count() == 0
    assert {t for _, t in texts(rows)} - {r["text"] or "" for r in kept} <= {texts(rows)[k][1] for k, r in enumerate(rows) if r[0] in (6, 102, 107, 113)} | {" \t\n", ""}


@pytest.mark.parametrize("all_pairs", [simhash.ALL_PAIRS, 0])
def test_near_links_are_whole(spark, all_pairs):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = [base]
    for i in range(60):  # each is near the base alone
        texts.append(list(base))
        for k in rng.sample(range(300), 5):
            texts[-1][k] = f"e{i}"
    texts += [[f"v{rng.randint(0, 10**6)}" for _ in range(40)] + base[:30] for _ in range(5)]
    sets = [set(simhash.shingles(" ".join(t).encode(), 5)) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert min(alike(0, k) for k in range(1, 61)) >= 0.8
    assert sum(alike(a, b) < 0.8 for a in range(1, 61) for b in range(1, a)) > 1700
    df = spark.createDataFrame([(i * 7919 % 1009, " ".join(t)) for i, t in enumerate(texts)], "key long, text string")
    groups = defaultdict(set)
    for r in simhash.near_links(df, 5, 0.8, 2, all_pairs).collect():
        groups[r["root"]].add(r["node"])
    assert [len(g) for g in groups.values()] == [61]
    docs = df.withColumnRenamed("key", "doc_id")
    assert simhash.one_of_each(docs).count() == 6
    assert simhash.one_of_each(docs, hashed_by=lambda sha: F.pmod(F.xxhash64(sha), F.lit(9))).count() == 6  # texts with one hash are told apart


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 3), (8, 7), (4, 1)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 7), (8, 7), (7, 7)}
