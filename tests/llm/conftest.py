import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("shard", T.IntegerType()), ("size", T.StringType()), ("row", T.LongType()))]
    + [T.StructField(n, T.LongType()) for n in ("_id", "_KEY", "_turn", "_source", "_n", "rows", "copies", "to", "place", "n", "root", "grp", "a.b", "_row", "all")]
)


def words(rng, n, lang="en"):
    syllables = {"en": "the ing tion er an st re on".split(), "fr": "eau oui é que ment la ç de".split()}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edge_rows():
    """Nulls in all columns, empty, blank and long texts, ties, repeated rows, near copies, and columns with clashing names."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 60), "fr" if i % 3 == 0 else "en") for i in range(40)]
    rows = [(i, t, "fr" if i % 3 == 0 else "en", f"s{i % 4}", len(t), "k", i % 5, "big", 0) for i, t in enumerate(base)]
    long = words(rng, 4000)
    more = [(100, base[3]), (101, base[3]), (102, base[7] + " extra word"), (103, ""), (104, None), (105, " \t\n"), (106, long), (107, long[:9000] + " changed " + long[9000:]), (108, "x"), (109, "É" * 60), (110, "aaaa" * 50), (111, "aaaa" * 60), (112, "12 34 !!"), (113, base[5][:30] + base[6])]
    rows += [(i, t, None, None if i % 2 else "s1", None, None, None, None, None) for i, t in more]
    rows += [rows[2], rows[2], (None, base[1], "en", "s0", 1, "k", 1, "x", 1), (None, None, None, None, None, None, None, None, None)]
    return [(*r, *[777] * 15) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
