"""Calibration, sequential tests, false-discovery control, conformal sets, paired tests, run metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.hashing import finish
from graphloom.functions.numbers import erfc, sigmoid
from graphloom.plans.ordered import last_and_next, numbered


def platt_fit(scored: DataFrame, steps: int = 200, rate: float = 0.1) -> tuple[float, float]:
    """(a, b) of P(y = 1) = sigmoid(a score + b) after full-batch gradient steps from (0, 0); one aggregation a step."""
    a = b = 0.0
    s = scored.select(F.col("score").cast("double").alias("s"), F.col("label").cast("double").alias("y"))
    for _ in range(steps):
        e = sigmoid(F.col("s") * F.lit(a) + F.lit(b)) - F.col("y")
        ga, gb = s.agg(F.avg(e * F.col("s")), F.avg(e)).first()
        if ga is None:
            break
        a, b = a - rate * ga, b - rate * gb
    return a, b


def platt_predict(score: Column, a: float, b: float) -> Column:
    return sigmoid(score * F.lit(a) + F.lit(b))


def _pool(rows: list[list[float]]) -> list[list[float]]:
    """Pool adjacent violators over [score, sum, weight] in order."""
    out: list[list[float]] = []
    for r in rows:
        out.append(list(r))
        while len(out) > 1 and out[-2][1] / out[-2][2] > out[-1][1] / out[-1][2]:
            _, total, weight = out.pop()
            out[-1][1] += total
            out[-1][2] += weight
    return out


def isotonic_fit(scored: DataFrame, tie: str = "id") -> DataFrame:
    """(score, p): starts of the steps of the isotonic fit by score, then ``tie``; equal neighbours keep the first.

    Ranges of scores are pooled each in their own task, which leaves the fit as it is and only blocks for the last pooling.
    """
    schema = "score double, total double, weight double"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[s, y, 1.0] for batch in batches for s, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        pooled = _pool(rows)
        if pooled:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*pooled, strict=True)], names=["score", "total", "weight"])

    ranged = scored.select(F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label"), F.col(tie).alias("tie")).repartitionByRange("score", "tie").sortWithinPartitions("score", "tie")
    blocks = ranged.select("score", "label").mapInArrow(part, schema).withColumn("at", F.monotonically_increasing_id())

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pooled = _pool(pdf.sort_values("at")[["score", "total", "weight"]].values.tolist())
        steps: list[tuple[float, float]] = []
        for s, total, weight in pooled:
            if not steps or total / weight != steps[-1][1]:
                steps.append((s, total / weight))
        return pd.DataFrame(steps, columns=["score", "p"])

    return blocks.groupBy(F.lit(1).alias("g")).applyInPandas(lambda pdf: whole(pdf), "score double, p double")


def isotonic_predict(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """``scores`` (id, score) with ``p``: linear between step starts, constant outside, 0.5 without steps.

    An as-of join of the sorted union, in range partitions: the last step at or below, the first above.
    """
    s = steps.select(F.lit(None).cast("long").alias("id"), "score", F.struct("score", "p").alias("step"), F.lit(0).alias("at"))
    q = scores.select(F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.lit(None).cast("struct<score:double,p:double>").alias("step"), F.lit(1).alias("at"))
    found = last_and_next(s.unionByName(q), "score", "at", "step").filter("at = 1")
    between = F.col("lo.p") + (F.col("hi.p") - F.col("lo.p")) * (F.col("score") - F.col("lo.score")) / (F.col("hi.score") - F.col("lo.score"))
    return found.select("id", "score", F.when(F.col("lo").isNull() & F.col("hi").isNull(), F.lit(0.5)).when(F.col("lo").isNull(), F.col("hi.p")).when(F.col("hi").isNull() | (F.col("hi.score") == F.col("lo.score")), F.col("lo.p")).otherwise(between).alias("p"))


def ece(scored: DataFrame, bins: int) -> DataFrame:
    """One row (ece): count-weighted gap between mean score and share of positive labels over equal bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)))
    binned = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.when(F.col("label") >= 0.5, 1.0).otherwise(0.0)).alias("y"))
    return binned.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def conformal_threshold(cal: DataFrame, alpha: float) -> DataFrame:
    """One row (threshold): score of rank min(n, ceil((n + 1)(1 - alpha))); infinity without rows."""
    ranked = numbered(cal, "score", name="r", total="n")
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-12))
    return ranked.filter(F.col("r") == rank).agg(F.coalesce(F.max("score"), F.lit(float("inf"))).alias("threshold"))


def in_conformal_set(score: Column, threshold: Column) -> Column:
    return score <= threshold


def benjamini_hochberg(pvals: DataFrame, q: float) -> DataFrame:
    """(i, p, rank) of the rejections, ranked by p, then i."""
    r = numbered(pvals, "p", "i", total="m")
    last = r.agg(F.coalesce(F.max(F.when(F.col("p") <= F.col("rank") * F.lit(q) / F.col("m"), F.col("rank"))), F.lit(0)).alias("k"))
    return r.join(F.broadcast(last), F.col("rank") <= F.col("k")).select("i", "p", "rank")  # one row


def e_bh(evals: DataFrame, q: float) -> DataFrame:
    """(i, e, rank) of the rejections, ranked by falling e, then i; nothing for q <= 0."""
    r = numbered(evals, F.desc("e"), "i", total="m")
    last = r.agg(F.coalesce(F.max(F.when((F.lit(q) > 0) & (F.col("e") >= F.col("m") / F.lit(q if q > 0 else 1.0) / F.col("rank")), F.col("rank"))), F.lit(0)).alias("k"))
    return r.join(F.broadcast(last), F.col("rank") <= F.col("k")).select("i", "e", "rank")


def alpha_investing(stream: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """``stream`` (*by, t, p), t from 1: reject, wealth.  Step t spends alpha / 2**t, which wealth always covers; a rejection earns alpha."""
    spend = F.lit(alpha) * F.pow(F.lit(0.5), F.col("t"))
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = stream.withColumn("reject", F.col("p") <= spend)
    return out.withColumn("wealth", spend + F.lit(alpha) * F.sum(F.col("reject").cast("int")).over(w))


def sequential_test(turns: DataFrame, alpha: float, beta: float, cap: int, by: list[str]) -> DataFrame:
    """(*by, decision, turn, llr, e) at the first turn that decides, of ``turns`` (*by, turn, llr, e); 'continue' at the last if none does.

    In this order: the running product of e reaches 1 / alpha (accept); the running llr reaches ln((1 - beta) / alpha)
    (accept) or falls to ln(beta / (1 - alpha)) (reject); turn ``cap`` decides by the sign of llr.
    """
    w = Window.partitionBy(*by).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.withColumns({"n": F.count("*").over(w), "sum_llr": F.sum("llr").over(w), "log_e": F.sum(F.log("e")).over(w)})
    d = F.when(F.col("log_e") >= -np.log(alpha), "accept").when(F.col("sum_llr") >= float(np.log((1 - beta) / alpha)), "accept").when(
        F.col("sum_llr") <= float(np.log(beta / (1 - alpha))), "reject").when(F.col("n") >= cap, F.when(F.col("sum_llr") > 0, "accept").otherwise("reject"))
    first = F.min_by(F.struct("decision", "n", "sum_llr", "log_e"), F.struct(F.col("decision").isNull(), F.when(F.col("decision").isNull(), -F.col("n")).otherwise(F.col("n")))).alias("x")
    return run.withColumn("decision", d).groupBy(*by).agg(first).select(*by, F.coalesce("x.decision", F.lit("continue")).alias("decision"), F.col("x.n").alias("turn"), F.col("x.sum_llr").alias("llr"), F.exp("x.log_e").alias("e"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row (b, c, stat, p) of ``pairs`` (a, b booleans): continuity-corrected; (0, 1) without discordance."""
    n = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c"))
    d = F.col("b") + F.col("c")
    stat = F.when(d == 0, F.lit(0.0)).otherwise(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), F.lit(2)) / d)
    return n.withColumn("stat", stat).withColumn("p", F.when(d == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(F.col("stat") / 2))))


def paired_bootstrap(pairs: DataFrame, n_boot: int, seed: int) -> tuple[float, float]:
    """2.5 and 97.5 percentile (nearest rank) of the mean difference a - b over resamples of ``pairs`` (i, a, b), i dense from 0.

    Draw j of the generator depends on its number alone, so resamples are counted apart: each row gets its own draws' sums.
    """
    n = pairs.count()
    if not n:
        return 0.0, 0.0
    spark = pairs.sparkSession

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = batch.column(0).to_numpy().astype(np.uint64)
            x = finish(np.uint64(seed) + (j + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array((j // np.uint64(n)).astype(np.int64)), pa.array((x % np.uint64(n)).astype(np.int64))], names=["k", "i"])

    draws = spark.range(n_boot * n).mapInArrow(draw, "k long, i long").groupBy("k", "i").count()
    diff = pairs.select("i", (F.col("a").cast("int") - F.col("b").cast("int")).alias("d")).filter("d <> 0")
    means = draws.join(diff, "i", "left").groupBy("k").agg((F.coalesce(F.sum(F.col("count") * F.col("d")), F.lit(0)) / n).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)
    at = [int(np.floor((n_boot - 1) * q + 0.5)) for q in (0.025, 0.975)]
    got = {r["r"]: r["m"] for r in ranked.filter(F.col("r").isin(at)).collect()}
    return got[at[0]], got[at[1]]


def run_metrics(predictions: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of rates.  predictions: advisory, on_patched, detected, localized, class, file, tokens, discarded, cache_hit; corpus: id, class, vuln_file, patch_file, kloc.

    A patched row is a false positive if the corpus has its class and file as a patched one.
    """
    c = corpus.agg(F.count("*").alias("advisories"), F.greatest(F.coalesce(F.sum("kloc"), F.lit(0.0)), F.lit(1.0)).alias("kloc"))
    fp = predictions.filter("on_patched").join(corpus.select("class", F.col("patch_file").alias("file")).distinct(), ["class", "file"], "left_semi").agg(F.count("*").alias("fp"))
    live = ~F.col("on_patched")
    p = predictions.agg(F.count("*").alias("n"), F.count_if(live & F.col("detected")).alias("detected"), F.count_if(live & F.col("localized")).alias("localized"), F.count_if("on_patched").alias("patched"),
                        F.count_if("discarded").alias("discarded"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.avg("cache_hit").alias("cache"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    one = c.crossJoin(fp).crossJoin(p)  # three rows of one each
    return one.select(ratio("detected", "advisories").alias("detection"), ratio("localized", "advisories").alias("localization"), ratio("fp", "patched").alias("false_positive"),
                      ratio("discarded", "n").alias("discard"), (F.col("tokens") / F.col("kloc")).alias("tokens_per_kloc"), F.coalesce("cache", F.lit(0.0)).alias("cache_hit"))
