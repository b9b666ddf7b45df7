"""Scan planning: prefix tries, partitions, budgeted coverage, eviction hints, inspection order, halving."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut
from graphloom.plans.ordered import numbered

NEVER = (1 << 63) - 1


def prefixes(chains: DataFrame) -> DataFrame:
    """(id, depth, prefix) of each non-empty prefix of ``chains`` (id, tokens)."""
    return chains.filter(F.size("tokens") > 0).select("id", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("depth"), "tokens").select("id", "depth", F.slice("tokens", F.lit(1), F.col("depth")).alias("prefix"))


def trie_summary(chains: DataFrame) -> DataFrame:
    """One row: nodes (with the root), root_children, naive_prefill (sum of cost), sharing (nodes without the root but one, by naive cost)."""
    p = prefixes(chains).agg(F.countDistinct("prefix").alias("n"), F.countDistinct(F.when(F.col("depth") == 1, F.col("prefix"))).alias("root_children"))
    c = chains.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("naive_prefill"))
    return p.crossJoin(c).select((F.col("n") + 1).alias("nodes"), "root_children", "naive_prefill", sharing_coefficient(F.col("n") + 1, F.col("naive_prefill")).alias("sharing"))  # one row by one row


def sharing_coefficient(nodes: Column, total: Column) -> Column:
    return F.when(total > 0, (nodes - 1) / total).otherwise(F.lit(0.0))


def trie_order(chains: DataFrame) -> DataFrame:
    """(id, rank_path): depth-first order of the trie is the order of ``rank_path``; of chains with equal tokens only the largest ``pos`` stays.

    ``chains``: (id, pos, tokens), pos the order of insertion.  A child's rank among its siblings is the first position
    that any chain below it was inserted at.
    """
    whole = chains.groupBy("tokens").agg(F.max_by("id", "pos").alias("id"))
    rank = prefixes(chains.select(F.col("pos").alias("id"), "tokens")).groupBy("prefix").agg(F.min("id").alias("rank"))
    steps = prefixes(whole).join(rank, "prefix")
    return steps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "rank"))), lambda x: x["rank"]).alias("rank_path"))


def _one_group(df: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn`` over all rows in one task; for plans, which are as small as their budget, never for data."""
    return df.groupBy(F.lit(1).alias("__g")).applyInPandas(lambda pdf: fn(pdf), schema)


def lpt(weights: DataFrame, workers: int) -> DataFrame:
    """(worker, id): heaviest first to the least loaded worker, of equal ones the lowest."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = [(0, w) for w in range(workers)]
        out = []
        for i, w in sorted(zip(pdf["id"], pdf["w"], strict=True), key=lambda x: (-x[1], x[0])):
            load, worker = heapq.heappop(heap)
            heapq.heappush(heap, (load + w, worker))
            out.append((worker, i))
        return pd.DataFrame(out, columns=["worker", "id"])

    return _one_group(weights.select("id", "w"), run, "worker long, id long") if workers else weights.sparkSession.createDataFrame([], "worker long, id long")


def tree_partition(chains: DataFrame, workers: int) -> DataFrame:
    """(part, id): subtrees of the trie cut off bottom-up when they reach ceil(total / workers); while there are more parts than workers the two with fewest chains are joined.

    What a cut leaves goes up as its carried cost; a subtree that carries no cost is dropped.  ``chains``: (id, tokens, cost).
    """
    if not workers:
        return chains.sparkSession.createDataFrame([], "part long, id long")
    chains = cut(chains.select("id", "tokens", "cost"))
    total = int(chains.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])
    if not total:
        return chains.sparkSession.createDataFrame([], "part long, id long")
    target = -(-total // workers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[int]] = []
        path: list[int] = []
        nodes: list[tuple[list[int], int]] = [([], 0)]  # what the root and each node of the path hold and carry

        def up(depth: int) -> None:
            while len(path) > depth:
                path.pop()
                ids, cost = nodes.pop()
                if cost > 0:
                    held, carried = nodes[-1]
                    if held:
                        held.extend(ids)
                    else:
                        held = ids
                    carried += cost
                    if carried >= target:
                        parts.append(held)
                        held, carried = [], 0
                    nodes[-1] = (held, carried)

        for batch in batches:
            for i, cost, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = 0
                while same < len(path) and same < len(ranks) and path[same] == ranks[same]:
                    same += 1
                up(same)
                for r in ranks[same:]:
                    path.append(r)
                    nodes.append(([], 0))
                nodes[-1] = ([i], cost)
        up(0)
        if nodes[0][0]:
            parts.append(nodes[0][0])
        while len(parts) > workers:
            parts.sort(key=len)
            parts = [parts[0] + parts[1], *parts[2:]]
        for k, p in enumerate(parts):
            for at in range(0, len(p), 100_000):
                some = p[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int64()), pa.array(some, pa.int64())], names=["part", "id"])

    # the trie is walked as a stream: depth first, a node before its children and these by the first id below them
    ranks = trie_order(chains.select("id", F.col("id").alias("pos"), "tokens"))
    root = chains.filter(F.size("tokens") == 0).agg(F.max("id").alias("id")).dropna().select("id", F.array().cast("array<bigint>").alias("rank_path"))
    rows = ranks.select("id", F.col("rank_path").cast("array<bigint>").alias("rank_path")).unionByName(root).join(chains.select("id", "cost"), "id")
    one = rows.select(F.col("id").cast("long"), F.col("cost").cast("long"), "rank_path").repartition(1).sortWithinPartitions("rank_path")
    return one.mapInArrow(run, "part long, id long")


def budgeted_coverage(items: DataFrame, weights: DataFrame, budget: int) -> DataFrame:
    """(step, id): lazy greedy by gain per cost within the budget.

    items: (id, cost, covers); weights: (element, weight), 1 where absent.  An element that stands twice in ``covers``
    counts twice; a stale bound is renewed when its item comes to the top; of equal densities the larger id goes first;
    the last item is taken if it is affordable, with gain or without.
    """
    first = items.select("id", "cost", "covers", F.posexplode_outer("covers").alias("k", "element")).join(weights, "element", "left")
    weighted = first.groupBy("id").agg(F.first("cost").alias("cost"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "element", F.coalesce("weight", F.lit(1.0)).alias("weight"))))).alias("covers"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(i): (int(c), [(x["element"], x["weight"]) for x in covers]) for i, c, covers in zip(pdf["id"], pdf["cost"], pdf["covers"], strict=True)}
        covered: set = set()
        density = lambda i: sum(w for e, w in rows[i][1] if e not in covered) / max(rows[i][0], 1)
        heap = [(-density(i), -i) for i in rows]
        heapq.heapify(heap)
        left, out = budget, []
        while heap:
            _, neg = heapq.heappop(heap)
            i = -neg
            if rows[i][0] > left:
                continue
            now = density(i)
            if heap and now < -heap[0][0]:
                heapq.heappush(heap, (-now, neg))
                continue
            left -= rows[i][0]
            covered.update(e for e, _ in rows[i][1])
            out.append((len(out), i))
        return pd.DataFrame(out, columns=["step", "id"])

    return _one_group(weighted, run, "step long, id long")


def next_use_hints(schedule: DataFrame, by: str = "block") -> DataFrame:
    """``schedule`` (pos, block) with ``next_use``: the next position of the same block, else ``NEVER``."""
    w = Window.partitionBy(by).orderBy("pos")
    return schedule.select("pos", by, F.coalesce(F.lead("pos").over(w), F.lit(NEVER)).cast("long").alias("next_use"))


def next_use_by_chain(paths: DataFrame) -> DataFrame:
    """(chain, block, next_use): the next later chain that contains the block, null if none."""
    w = Window.partitionBy("block").orderBy("chain")
    return paths.select("chain", "block").distinct().withColumn("next_use", F.lead("chain").over(w))


def evict_candidate(resident: DataFrame) -> DataFrame:
    """One row (block): the furthest next_use, null as never; of ties the last ``pos``."""
    return resident.agg(F.max_by("block", F.struct(F.coalesce("next_use", F.lit(NEVER)).alias("u"), "pos")).alias("block"))


def reservation_value(dist: Column, cost: Column) -> Column:
    """s with sum p max(v - s, 0) = cost over ``dist`` (array of struct v, p); 0 for no cost, no values, or where opening isn't worth it.

    The left side is piecewise linear and falls in s, so the solution stands between two values: with values sorted
    downwards, the first k of them give s_k = (sum p v - cost) / sum p, and the solution is the largest s_k.
    """
    down = F.sort_array(F.transform(dist, lambda x: F.struct(x["v"].cast("double").alias("v"), x["p"].cast("double").alias("p"))), asc=False)
    start = F.struct(F.lit(0.0).alias("pv"), F.lit(0.0).alias("p"), F.lit(0.0).alias("best"))

    def add(a: Column, x: Column) -> Column:
        pv, p = a["pv"] + x["p"] * x["v"], a["p"] + x["p"]
        return F.struct(pv.alias("pv"), p.alias("p"), F.greatest(a["best"], F.when(p > 0, (pv - cost) / p).otherwise(F.lit(0.0))).alias("best"))

    return F.when((cost <= 0) | F.coalesce(F.size(dist) == 0, F.lit(True)), F.lit(0.0)).otherwise(F.aggregate(down, start, add, lambda a: a["best"]))


def inspection_order(boxes: DataFrame) -> DataFrame:
    """``boxes`` (id, dist, cost) with sigma and ``rank`` by falling sigma, then id."""
    s = boxes.select("id", reservation_value(F.col("dist"), F.col("cost").cast("double")).alias("sigma"))
    return numbered(s, F.desc("sigma"), "id")


def should_stop(best: float, unopened: DataFrame) -> DataFrame:
    """One row (stop): whether best is at least every sigma of ``unopened``, and 0."""
    return unopened.agg((F.lit(best) >= F.greatest(F.coalesce(F.max("sigma"), F.lit(0.0)), F.lit(0.0))).alias("stop"))


def successive_halving(scores: DataFrame, eta: int, resource: int = 1) -> DataFrame:
    """One row (arm): rounds keep the best ceil(n / eta) arms by mean of the first r rewards, r grows by eta, then the best full mean; ties to the larger arm.

    scores: (arm, level, reward).  eta must be above 1.
    """
    if eta <= 1:
        raise ValueError("eta must be above 1")
    scores = cut(scores)  # read once a round
    levels, left = (scores.agg(F.max("level") + 1, F.countDistinct("arm")).first())
    arms, r = scores.select("arm").distinct(), resource
    while left > 1 and r <= levels:
        mean = scores.filter(F.col("level") < r).join(arms, "arm", "left_semi").groupBy("arm").agg(F.avg("reward").alias("m"))
        keep = math.ceil(left / eta)
        arms = mean.orderBy(F.desc("m"), F.desc("arm")).limit(keep).select("arm")
        left, r = keep, round(r * eta)
    final = scores.join(arms, "arm", "left_semi").groupBy("arm").agg(F.avg("reward").alias("m"))
    return final.agg(F.max_by("arm", F.struct("m", "arm")).alias("arm"))


