"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where it is unset and Spark is local (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_braidwork_dir", None) or tempfile.mkdtemp(prefix="braidwork-")
        spark.sparkContext._braidwork_dir = found
    return found.rstrip("/")


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """df, written and read again: later plans start here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/braidwork/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **conditions: str) -> tuple[DataFrame, Observation]:
    """Df, and an Observation that has its rows and those of each condition (SQL) once an action has run: a stage's counters
    without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *(F.count_if(F.expr(c)).alias(k) for k, c in conditions.items())), seen
