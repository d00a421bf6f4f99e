"""Fill-in-middle, BPE and the filter audit against plain loops and the tokenizers library, on edge cases and empty tables."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidwork.llm import bpe, fill_in_middle, filter_audit

PATH = public_tokenizers.path("word_bpe_49k.json")
UNIT = re.compile(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = ["", None, " \n", "a\0b c", "<P> x", "x <M>", "a < P> <", "<S", "é漢 😀  y", "no end  ", "<" * 30 + " P> S> M>", "x\x1cy\x85z"]


def plain_fim(key, text, rate=50, spm=80):
    text, units = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim(spark, docs, rows, none):
    out = fill_in_middle.transformed(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(((r[0], *plain_fim(r[0], r[1])) for r in rows), key=repr)
    back = out.select(fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(r[1] or "" for r in rows)
    assert fill_in_middle.transformed(none).count() == 0
    kept = fill_in_middle.transformed(docs, keep=("doc_id", "_KEY", "a.b", "rows"))
    assert kept.columns[:4] == ["doc_id", "_KEY", "a.b", "rows"] and kept.count() == len(rows)
    with pytest.raises(ValueError):
        fill_in_middle.transformed(docs, keep=("doc_id", "n"))


@pytest.mark.parametrize(("rate", "spm"), [(100, 100), (100, 0), (0, 50)])
def test_fim_forms(spark, rate, spm):
    """All of one form: odd texts are cut and put together again exactly, those with a marker stay plain."""
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("<>PSM \n\tax") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = fill_in_middle.transformed(df, rate=rate, spm=spm).withColumn("t", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], texts[r["doc_id"]], rate, spm)
        assert r["t"] == (texts[r["doc_id"]] or "")
    assert {r["form"] for r in out if r["t"].strip()} >= {{(100, 100): "spm", (100, 0): "psm", (0, 50): "plain"}[rate, spm]}


def test_fim_long_text(spark):
    """A text of 20 MB is cut whole; other rows of its batch keep their places."""
    df = spark.createDataFrame([(i,) for i in range(40)], "doc_id long").coalesce(1).withColumn("text", F.when(F.col("doc_id") == 17, F.repeat(F.lit("wörd "), 3_400_000)).otherwise(F.concat(F.lit("short "), "doc_id")))
    out = fill_in_middle.transformed(df, rate=100).select("doc_id", "n", "form", F.xxhash64(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("h")).collect()
    want = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("text")).collect()}
    assert {r["doc_id"]: r["h"] for r in out} == want and {r["n"] for r in out} == {2, 3_400_001}


def test_fim_slices():
    batch = pa.record_batch({"k": ["a"] * 9, "t": ["x" * n for n in (3, 0, 5, 30, 1, 1, 12, 0, 2)]})
    runs = list(fill_in_middle.slices(batch, 1, 10))
    assert pa.Table.from_batches(runs).to_pydict() == batch.to_pydict()
    assert all(sum(map(len, r.column(1).to_pylist()[1:])) < 10 for r in runs) and len(runs) == 4


def plain_merges(symbols, pairs):
    symbols = list(symbols)
    while True:
        ranks = [(pairs[p][0], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in pairs]
        if not ranks:
            return symbols
        _, i = min(ranks)
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


def test_bpe_tree():
    """The segment tree's merges are those of a loop that looks for the leftmost lowest rank each time."""
    rng = random.Random(11)
    for _ in range(300):
        kinds = rng.randint(1, 5)
        found = rng.sample([(a, b) for a in range(12) for b in range(12)], 30)
        pairs = {p: (rank, rng.randint(0, 11)) for rank, p in enumerate(found)}
        symbols = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        assert bpe.merged(symbols, pairs) == plain_merges(symbols, pairs)
        many = [[rng.randrange(kinds) for _ in range(rng.randint(1, 16))] for _ in range(20)]
        coded = sorted((a * 12 + b, rank) for (a, b), (rank, _) in pairs.items())
        keys, ranks = (np.array(x, np.int64) for x in zip(*coded, strict=True))
        flat, count = bpe.merged_together(np.array([m + [0] * (16 - len(m)) for m in many]), np.array(list(map(len, many))), keys, ranks, np.array([new for _, new in sorted(pairs.values())]), 12)
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [plain_merges(m, pairs) for m in many]
    assert bpe.merged([], {}) == [] and bpe.merged([4], {}) == [4]
    assert bpe.merged([0] * 9, {(0, 0): (0, 1), (1, 1): (1, 2)}) == [2, 2, 0]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def same(library, out, texts):
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe(spark, docs, rows, none, library):
    out = bpe.decoded(bpe.encoded(docs, PATH), PATH, keep=("doc_id", "n_tokens", "ids")).collect()
    want = sorted((repr(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == want
    assert all(r["decoded"] == library.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) for r in out)
    assert bpe.decoded(bpe.encoded(none, PATH), PATH).count() == 0
    both = bpe.encoded(docs, PATH, decode=True)
    assert both.columns == ["doc_id", "n_tokens", "ids", "decoded"] and sorted(map(repr, both.collect())) == sorted(map(repr, out))
    assert bpe.encoded(docs, PATH, keep=("doc_id", "a.b", "_KEY")).columns == ["doc_id", "a.b", "_KEY", "n_tokens", "ids"]
    with pytest.raises(ValueError):
        bpe.encoded(docs, PATH, keep=("IDS",))


def test_bpe_odd_texts(spark, library, monkeypatch):
    """Added tokens, all kinds of white space, case, marks, rare letters, long runs; pieces of a few bytes; a small memory for words."""
    rng = random.Random(2)
    odd = [*ODD, "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|", "<|ENDOFTEXT|>", "don't WE'LL 'S", "ΣΑΣ ΣΣ", "İI ıi ß ẞ", "é ́e ạ̀", "Ᲊ Ɤ \U00010d50", "x　y z w​v", "12345 ½ Ⅷ ٣", "ab" * 3000, "!?" * 500 + "a", "日本語 " * 50]
    alphabet = ["a", "Z", " ", "\n", "'", "s", "1", "é", "é", "̣", "漢", "😀", " ", "<|endoftext|>", "!", "σ", "Σ", "\x1c"]
    texts = odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    same(library, bpe.decoded(bpe.encoded(df, PATH), PATH, keep=("doc_id", "n_tokens", "ids")).collect(), texts)
    with open(PATH, encoding="utf-8") as f:
        model = bpe.Model(f.read())
    monkeypatch.setattr(bpe, "WORDS", 40)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (7,))
    for size in (1, 7, 300, 1 << 20):
        monkeypatch.setattr(bpe, "PIECE", size)
        got = [np.frombuffer(p, "<u4").tolist() for p in model.packed((t or "").encode() for t in texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "PIECE", 20)
    assert len(list(model.packed([b"a b c " * 30] * 50))) == 50 and len(model.words) <= 40
    assert list(model.packed([])) == []


def test_bpe_documents(spark, small, library):
    """All documents of the smallest tables, digests as the library's."""
    from braidwork.llm.catalog import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = QUERIES["op12_bpe"](spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_long_text_and_ids(spark, library):
    """A text of 20 MB has the ids of its parts; unknown and null ids; packed ids as an array."""
    part = "Some words, again and AGAIN. "
    df = spark.createDataFrame([(1,)], "doc_id long").withColumn("text", F.repeat(F.lit(part), 700_000))
    ids = library.encode(part, add_special_tokens=False).ids
    r = bpe.encoded(df, PATH).select("n_tokens", F.sha2("ids", 256).alias("h")).first()
    assert r["n_tokens"] == 700_000 * len(ids) and r["h"] == hashlib.sha256(np.array(ids * 700_000, "<u4").tobytes()).hexdigest()
    packed = [np.array(x, "<u4").tobytes() for x in ([320, 4_000_000_000, 49407], [])] + [None]
    few = spark.createDataFrame(list(enumerate(packed)), "doc_id long, ids binary").coalesce(1)
    assert [r["decoded"] for r in bpe.decoded(few, PATH).orderBy("doc_id").collect()] == [library.decode([320, 49407], skip_special_tokens=False), "", None]
    assert [r["token_ids"] for r in bpe.unpacked(few).orderBy("doc_id").collect()] == [[320, 4_000_000_000, 49407], [], None]


def test_bpe_refuses_other_files(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.Model(f.read())
    with pytest.raises(ValueError):
        bpe.Model(json.dumps(spec | {"model": spec["model"] | {"byte_fallback": True}}))


def plain_audit(rows, labels):
    """(part, order, step) -> (kept, removed, redundant, unique_fails, good_lost, toxic_lost) and the Shapley sums, document by document."""
    docs = [(k, lang or "", t or "") for k, t, lang in rows]
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    fails = []
    for k, _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        copy = k is not None and any(j is not None and j < k and u == t for j, _, u in docs)
        fails.append({f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), copy), strict=True) if bad})
    out, share = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in docs}:
            alive = [i for i, d in enumerate(docs) if d[1] == part]
            mine = list(alive)
            for step, f in enumerate(order, 1):
                lost = [i for i in alive if f in fails[i]]
                alive = [i for i in alive if f not in fails[i]]
                out[part, order, step] = (len(alive), len(lost), sum(f in fails[i] for i in mine) - len(lost), sum(fails[i] == {f} for i in mine), sum(docs[i][0] in good for i in lost), sum(docs[i][0] in toxic for i in lost))
                share[part, f] = share.get((part, f), 0) + len(lost)
    return {(*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, docs, rows, none):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Aa", "BB", "c", "d#", "e", str(i)]) for i in range(rng.choice([3, 120, 130]))) for _ in range(30)] + ["É" * 5 + "A", "AA " * 150, None, ""]
    more = [(rng.randrange(200, 260), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)] + [(None, texts[0], "en"), (None, texts[0], "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in (*range(20), *range(200, 250), 205, 205, None, 9999)]
    small = [(r[0], r[1], r[2]) for r in rows] + more + more[:5]
    df = docs.select("doc_id", "text", "lang", "key", "`a.b`", "n").unionByName(spark.createDataFrame(more + more[:5], "doc_id long, text string, lang string"), allowMissingColumns=True)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(df, said)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(small, labels)
    assert filter_audit.audit(none, said).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(df, said.limit(0)).collect()} == {0}


def test_lattice(spark):
    """80 edges a part, 600 steps; each order's steps are a path from no filter to all; a hot group of copies is spread by key."""
    o = filter_audit.orders(spark, "ABCDE").collect()
    assert len(o) == 600 and {r["filter_order"] for r in o} == set(map("".join, itertools.permutations("ABCDE")))
    assert all(r["applied"] == sum(1 << "ABCDE".index(c) for c in r["filter_order"][: r["step"] - 1]) and "ABCDE"[r["next"]] == r["filter_order"][r["step"] - 1] for r in o)
    assert len({(r["applied"], r["next"]) for r in o}) == 80
    patterns = spark.createDataFrame([("", 0, 5), ("", 3, 2), ("x", 1, 1)], "part string, mask int, n long")
    e = filter_audit.lattice_edges(patterns, "ABCDE", {}).collect()
    assert len(e) == 160 and next(r for r in e if r["part"] == "" and r["applied"] == 1 and r["next"] == 1)[3:] == (5, 0, 2, 0)
    late = filter_audit.repeated(spark.range(5000).selectExpr("id as key", "cast('d' as binary) as digest", "0 as mask", "1L as n"), 16)
    assert [r["count"] for r in late.groupBy("mask").count().orderBy("mask").collect()] == [1, 4999]
