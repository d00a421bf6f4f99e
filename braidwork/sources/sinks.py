"""Idempotent sinks (K1-K7) over versioned tables: each returns the table's new content, written once by commit()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.operators.tables import stored


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """K1: rows whose key isn't there yet; of rows with one key the first by `order`. Running it twice changes nothing."""
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return table.unionByName(one.join(table.select(*key), key, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], merge: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """K2: new values win where they are known; merge gives other rules (old, new) by column, such as counters."""
    merge = merge or {}
    old, new = (df.select(*key, F.struct(*[c for c in table.columns if c not in key]).alias(side)) for df, side in ((table, "_old"), (rows, "_new")))
    j = old.join(new, key, "full_outer")
    rest = [(merge[c](F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in merge else F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}"))).alias(c) for c in table.columns if c not in key]
    return j.select(*key, *rest).select(*table.columns)


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def numbered(rows: DataFrame, key: list[str], after: int, bucket: Column | None = None) -> DataFrame:
    """rows with `number`: after + 1, after + 2, ... without gaps, by bucket and then key; keys are distinct and not null.

    Rows are put in order within buckets alone, as many as there are shuffle partitions; a bucket's first number comes from
    the counts of those before it. Which bucket a key is in changes its number, never whether it has one of its own.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(n)) if bucket is None else bucket), "numbered")
    counts = cut.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    starts = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key))
    return cut.withColumn("_place", place).join(F.broadcast(starts), "_bucket").withColumn("number", F.lit(after) + F.col("_before") + F.col("_place")).drop("_bucket", "_before", "_place")


def ensure_nodes(nodes: DataFrame, wanted: DataFrame, bucket: Column | None = None) -> DataFrame:
    """K3: nodes (node_id, kind, ref_id, label) with those of wanted (kind, ref_id, label) that are missing; labels of known nodes stay.

    nodes is the key table: its ids stay, new ones go on from the largest without gaps, so two keys never share one and a
    rerun adds nothing. A null kind or ref_id is no key and gets no node.
    """
    new = wanted.where("kind is not null and ref_id is not null").groupBy("kind", "ref_id").agg(F.min("label").alias("label")).join(nodes.select("kind", "ref_id"), ["kind", "ref_id"], "left_anti")
    last = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0))).first()[0]
    return nodes.unionByName(numbered(new, ["kind", "ref_id"], last, bucket).withColumnRenamed("number", "node_id").select(*nodes.columns))


def changed(table: DataFrame, rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """K4: rows whose value differs from the table's."""
    return rows.join(table.select(*key, F.col(value).alias("_old")), key).where(~F.col("_old").eqNullSafe(F.col(value))).drop("_old")


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """K5: the table without the keys; null keys delete nothing."""
    return table.join(keys.select(*on), on, "left_anti").select(*table.columns)


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """K5, K6: rows of the child whose parent is still there."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(*child.columns)


def commit(df: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    """K7: writes one version of a table in its own folder; it counts once its _SUCCESS marker is there, so readers see all of it or none."""
    out = f"{path}/v={version:012d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
    return out


def current(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The newest committed version."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if not found:
        raise FileNotFoundError(f"no committed version in {path}")
    return spark.read.parquet(found[-1])
