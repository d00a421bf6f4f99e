"""Shared helpers: table reading, tables that cut lineage, connected components, word splitting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of the contracts are runs of anything else than these; bytes.split() separates at the same six.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of this machine if it is unset and Spark is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_braidwork_dir", None) or tempfile.mkdtemp(prefix="braidwork-")
        spark.sparkContext._braidwork_dir = found
    return found.rstrip("/")


#: Lets Spark remove a query's shuffle files as soon as the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


#: open: what stored() and bucketed() have written inside this thread's innermost scratch().
_WRITTEN = threading.local()


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are written inside are discarded at its end, but those that its list has lost meanwhile, since later steps read them."""
    outer, _WRITTEN.open = getattr(_WRITTEN, "open", ()), (written := [])
    try:
        yield written
    finally:
        _WRITTEN.open = outer
        for df in written:
            discard(df)


def _written(df: DataFrame) -> DataFrame:
    if isinstance(open_ := getattr(_WRITTEN, "open", None), list):
        open_.append(df)
    return df


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there and a lost executor costs no recomputation.

    The shuffle files of the write are removed when it is over, since nothing reads them later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braidwork/{what}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._braidwork_path = path
    return _written(out)


def bucketed(df: DataFrame, column: str, buckets: int, what: str) -> DataFrame:
    """Like stored(), but bucketed by a column: what is grouped or joined by it later needs no shuffle of this table."""
    spark, name = df.sparkSession, f"braidwork_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/braidwork/{what}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._braidwork_path, out._braidwork_table = path, name
    return _written(out)


def discard(df: DataFrame) -> None:
    """Removes a table that stored() or bucketed() wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    if hasattr(df, "_braidwork_table"):
        spark.sql(f"DROP TABLE IF EXISTS {df._braidwork_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._braidwork_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of df by name, dots and spaces included."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none. Counts ends of words, so that no array is built."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty, without decoding."""
    raw = column.cast(pa.large_binary())
    for x in raw:
        yield x.as_py() or b""


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches. Nodes are bigint.

    Alternates the large-star and small-star steps, each an aggregate and a join on the links, so that no neighbourhood
    is ever gathered; links become stars in a number of rounds logarithmic in the diameter. Every round ends in a
    written table. Self-links and repeated links are allowed; null ends are ignored.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(small_min, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stored(small.union(small_min.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """An equi-join on keys in which null equals null; the keys of the right side are dropped."""
    names = [f"{n}_r" for n in free_names(left, *keys)]
    other = right.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = extra if extra is not None else F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = F.col(k).eqNullSafe(F.col(n)) & on
    return left.join(other, on, how).drop(*names)


def mapped(df: DataFrame, given: list[Column], keep: tuple[str, ...], made: list[T.StructField], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The columns `keep` of df and the columns `made`, from an Arrow map over batches of `given`, then `keep`; it yields keep, then made.

    Columns have plain names on the way, so those of df may hold dots or differ in case alone. A kept column named as a made
    one is an error.
    """
    clash = [c for c in keep if c.lower() in {f.name for f in made}]
    if clash:
        raise ValueError(f"kept columns are named as made ones: {clash}")
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in keep]
    rows = df.select(*(c.alias(f"given{i}") for i, c in enumerate(given)), *(c.alias(f"keep{i}") for i, c in enumerate(kept)))
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[len(given) :]] + made
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*keep, *(f.name for f in made))
