"""Name resolution and baseline matching as equi-joins with priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.ordered import numbered


def last_segment(name):
    return F.element_at(F.split(name, "::"), -1)


def assign_ids(protos: DataFrame) -> DataFrame:
    """``protos`` (file_id, local, ...) with dense ``id`` in file order, then in-file order.

    Numbers within ranges of files, each range's start carried from the ranges before.
    """
    return numbered(protos, "file_id", "local", name="id").withColumn("id", F.col("id") - 1)


def _by_qual(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.col("qual").alias("q")).agg(F.max("id").alias("by_qual"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (src, dst) of calls (caller, callee): the last symbol with that qualified name, else the only symbol of the last segment's name."""
    unique = symbols.groupBy(F.col("name").alias("nm")).agg(F.count("*").alias("n"), F.max("id").alias("by_name")).filter("n = 1").drop("n")
    found = calls.join(_by_qual(symbols), F.col("callee") == F.col("q"), "left").join(unique, last_segment(F.col("callee")) == F.col("nm"), "left")
    return found.select(F.col("caller").alias("src"), F.coalesce("by_qual", "by_name").alias("dst")).filter("dst IS NOT NULL").distinct()


def definition_of(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """``queries`` (sym) with ``id``: the last symbol of that qualified name; else of the last segment the only one, else the first callable; else null."""
    callable_id = F.min(F.when(F.col("kind").isin("Fn", "Variant"), F.col("id")))
    named = symbols.groupBy(F.col("name").alias("nm")).agg(F.count("*").alias("n"), F.max("id").alias("one"), callable_id.alias("first")).select("nm", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("first")).alias("by_name"))
    found = queries.join(_by_qual(symbols), F.col("sym") == F.col("q"), "left").join(named, last_segment(F.col("sym")) == F.col("nm"), "left")
    return found.select("sym", F.coalesce("by_qual", "by_name").alias("id"))


def match_level(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``findings`` (id, class, path, span, symbol) with ``level`` and ``match``, the baseline's smallest ``idx`` of the strongest level.

    Level 1: class, path and span; 2: class and span; 3: class and symbol; else null.  A join for each level on all its
    keys, against a baseline reduced to one row for each key, so no class with many rows is ever paired with itself.
    """
    out = findings
    for level, key in ((1, ["class", "path", "span"]), (2, ["class", "span"]), (3, ["class", "symbol"])):
        first = baseline.groupBy(*key).agg(F.min("idx").alias(f"__m{level}"))
        out = out.join(first, key, "left")
    pick = F.coalesce(*[F.when(F.col(f"__m{k}").isNotNull(), F.struct(F.lit(k).alias("level"), F.col(f"__m{k}").alias("match"))) for k in (1, 2, 3)])
    return out.withColumn("__p", pick).select("id", F.col("__p.level").alias("level"), F.col("__p.match").alias("match"))


def intern(rows: DataFrame, symbol: str, order: str) -> DataFrame:
    """(symbol, id): dense ids from 0 in the order of first occurrence by ``order``."""
    first = rows.groupBy(F.col(symbol).alias("symbol")).agg(F.min(order).alias("first"))
    return numbered(first, "first", "symbol", name="number").select("symbol", (F.col("number") - 1).alias("id"))
