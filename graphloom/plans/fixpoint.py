"""Loops of DataFrames: lineage is cut by tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder, in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a table in the shared folder; a lost executor costs nothing, and plans stay short."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grow(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Semi-naive closure: rows of ``seed`` and of ``step`` over the rows that are new, by ``key``, until nothing is new.

    The result has the columns of ``seed`` and ``level``: the round in which a key was first found.
    """
    new = cut(seed.dropDuplicates(key).withColumn("level", F.lit(0)))
    found, level = new, 0
    while not new.isEmpty():
        level += 1
        more = step(new).select(*seed.columns).dropDuplicates(key)
        new = cut(more.join(found.select(*key), key, "left_anti").withColumn("level", F.lit(level)))
        found = found.unionByName(new)
        if level % 8 == 0:
            found = cut(found)
    return found


def settle(rows: DataFrame, step: Callable[[DataFrame], DataFrame], mark: list[str]) -> DataFrame:
    """Apply ``step`` until count and exclusive-or of the hashes over ``mark`` stay the same."""
    sign = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64(*mark)), F.bit_xor(F.hash(*mark))).first()
    now = cut(rows)
    before, after = None, sign(now)
    while before != after:
        before, now = after, cut(step(now))
        after = sign(now)
    return now
