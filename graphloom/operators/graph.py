"""Directed graphs as edge tables (src, dst): reachability, components, condensation, labels, witnesses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut, grow, settle

#: Edges whose components one task finds (about 40 bytes an edge in its Python); while there are more, components leave in rounds.
ONE_TASK = 16_000_000
#: Members of a component that stand in one row when rows of components are expanded to rows of nodes.
BLOCK = 1024


def edges_of(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst); self-loops stay, rows with a null end go."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node with an edge."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(back, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, callees, callers): sorted neighbours in either direction, one row for each node with an edge."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("callees"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("callers"))
    return out.join(back, "node", "full")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, level): what any of ``seeds`` (node) reaches, itself included; level is the least number of edges."""
    edges = cut(edges)
    return grow(seeds.select("node"), lambda new: new.join(edges, new.node == edges.src).select(F.col("dst").alias("node")), ["node"])


def reachable_by_source(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, node, level): what each of ``seeds`` (node) reaches, itself included, one by one; without levels ``reach_sets`` does less."""
    edges = cut(edges)
    start = seeds.select(F.col("node").alias("source"), "node")
    return grow(start, lambda new: new.join(edges, new.node == edges.src).select("source", F.col("dst").alias("node")), ["source", "node"])


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def condense(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, comp), (src, dst)): the strong component of ``nodes`` and of all ends of edges, and the edges between components.

    What one member reaches all reach, so searches go over components and only results are expanded to nodes.
    """
    scc = cut(strong_components(nodes.select("node").unionByName(ends(edges)), edges).select("node", F.col("scc_id").alias("comp")))
    return scc, cut(condensation(scc, edges))


class Members:
    """The members of components (node, comp), in rows of about ``BLOCK``."""

    def __init__(self, scc: DataFrame):
        large = scc.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("comp", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        self.large = cut(large)  # a row for each BLOCK nodes at most, so it is broadcast
        block = F.coalesce(F.pmod(F.xxhash64("node"), "blocks"), F.lit(0))
        self.blocks = cut(scc.join(F.broadcast(self.large), "comp", "left").groupBy("comp", block.alias("block")).agg(F.collect_list("node").alias("members")))

    def expand(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (comp, ...) once for each member of comp, which stands as ``name`` in place of comp.

        The parts are fixed in number: few rows give many, so they must not be put together by the size of what is read.
        """
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0).cast("long"))))
        keyed = rows.join(F.broadcast(self.large), "comp", "left").withColumn("block", each).drop("blocks")
        parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = keyed.repartition(parts, "comp", "block").join(self.blocks, ["comp", "block"])
        return both.select(*[c for c in rows.columns if c != "comp"], F.explode("members").alias(name))


def reach_sets(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, node): what each of ``seeds`` (node) reaches, itself included."""
    seeds = cut(seeds.select("node").distinct())
    scc, dag = condense(seeds, cut(edges))
    start = cut(seeds.join(scc, "node"))
    found = reachable_by_source(dag, start.select(F.col("comp").alias("node")).distinct()).select(F.col("source").alias("comp"), F.col("node").alias("to"))
    by_source = start.join(found, "comp").select(F.col("node").alias("source"), F.col("to").alias("comp"))
    return Members(scc).expand(cut(by_source), "node")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) joined by at least one edge: paths between components are doubled, in about log2(depth) rounds, and then expanded.

    The result has up to the square of the nodes as rows; only its components' pairs are shuffled.
    """
    def double(r: DataFrame) -> DataFrame:
        further = r.alias("a").join(r.alias("b"), F.expr("a.dst = b.src")).select("a.src", "b.dst")
        return r.unionByName(further).distinct()

    edges = cut(edges)
    scc, dag = condense(ends(edges), edges)
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).join(scc, "node").select("comp")
    cyclic = scc.groupBy("comp").agg(F.count("*").alias("n")).filter("n > 1").select("comp").unionByName(loops).distinct()
    pairs = settle(dag, double, ["src", "dst"]).unionByName(cyclic.select(F.col("comp").alias("src"), F.col("comp").alias("dst")))
    members = Members(scc)
    by_node = members.expand(cut(pairs.select(F.col("src").alias("comp"), "dst")), "src")
    return members.expand(by_node.select(F.col("dst").alias("comp"), "src"), "dst")


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``reaches``; every node reaches itself."""
    pairs = cut(pairs.select("src", "dst"))
    scc, dag = condense(ends(pairs), cut(edges))
    at = cut(pairs.join(scc.toDF("src", "a"), "src", "left").join(scc.toDF("dst", "b"), "dst", "left"))
    found = reachable_by_source(dag, at.select(F.col("a").alias("node")).dropna().distinct())
    hit = found.select(F.col("source").alias("a"), F.col("node").alias("b"), F.lit(True).alias("hit"))
    return at.join(hit, ["a", "b"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("reaches"))


def _tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, scc_id) of all nodes in components of two or more, from edges in any order; time and memory are linear in the edges."""
    got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    ids = np.unique(np.concatenate([np.unique(u), np.unique(v)]))
    u, v = np.searchsorted(ids, u).astype(np.int32), np.searchsorted(ids, v).astype(np.int32)
    n = len(ids)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(u, minlength=n), out=first[1:])
    to = v[np.argsort(u, kind="stable")]
    del u, v
    at, stop, to = memoryview(first[:-1].copy()), memoryview(first[1:]), memoryview(to)
    low = np.zeros(n, np.int32)  # 0: not seen; n + 1: its component is known
    root, seen, done = np.arange(n, dtype=np.int32), memoryview(low), n + 1
    out, count = memoryview(root), 0
    for s in range(n):
        if seen[s]:
            continue
        count += 1
        seen[s] = count
        path, held, entered = [s], [s], [count]
        while path:
            x = path[-1]
            k, last = at[x], stop[x]
            low_x = seen[x]
            while k < last:
                y = to[k]
                k += 1
                low_y = seen[y]
                if not low_y:
                    count += 1
                    seen[y] = count
                    path.append(y)
                    held.append(y)
                    entered.append(count)
                    break
                if low_y < low_x:
                    low_x = low_y
            else:
                y = -1
            at[x], seen[x] = k, low_x
            if y >= 0 and path[-1] != x:
                continue
            path.pop()
            if entered.pop() == low_x:
                members = []
                while True:
                    y = held.pop()
                    members.append(y)
                    seen[y] = done
                    if y == x:
                        break
                least = min(members)
                for y in members:
                    out[y] = least
            elif path and low_x < seen[path[-1]]:
                seen[path[-1]] = low_x
    size = np.bincount(root, minlength=n)
    some = np.flatnonzero(size[root] > 1)
    for k in range(0, len(some), 100_000):
        x = some[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[root[x]])], names=["node", "scc_id"])


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc_id) with the smallest member as id: at most ``ONE_TASK`` edges go to one task, more are coloured.

    A node's colour is the smallest node that reaches it.  A colour's own node and what reaches it inside the colour are
    a component; it leaves, and the rest is coloured anew, or goes to one task.
    """
    left = cut(nodes.select("node").distinct())
    live = cut(edges.filter("src <> dst").join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    done = None
    while not left.isEmpty():
        if live.count() <= ONE_TASK:
            cyclic = live.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(_tarjan, "node long, scc_id long")
            part = left.join(cut(cyclic), "node", "left").select("node", F.coalesce("scc_id", "node").alias("scc_id"))
            return part if done is None else done.unionByName(part)

        def spread(c: DataFrame, live: DataFrame = live) -> DataFrame:
            sent = live.join(c, live.src == c.node).select(F.col("dst").alias("node"), "color")
            return c.unionByName(sent).groupBy("node").agg(F.min("color").alias("color"))

        colors = settle(left.withColumn("color", F.col("node")), spread, ["node", "color"])
        inside = live.join(colors.toDF("src", "c1"), "src").join(colors.toDF("dst", "c2"), "dst").filter("c1 = c2").select("src", "dst")
        roots = colors.filter("node = color").select("node", "color")
        back = grow(roots, lambda new, inside=inside: new.join(inside, new.node == inside.dst).select(F.col("src").alias("node"), "color"), ["node"])
        part = cut(back.select("node", F.col("color").alias("scc_id")))
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(part, "node", "left_anti"))
        live = cut(live.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done if done is not None else nodes.select("node", F.col("node").alias("scc_id"))


def condensation(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of component ids between different components."""
    a, b = scc.toDF("src", "a"), scc.toDF("dst", "b")
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> bool:
    """No self-loop and no component of two or more nodes."""
    return edges.filter("src = dst").isEmpty() and strong_components(nodes, edges).groupBy("scc_id").count().filter("count > 1").isEmpty()


def bit_reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, chunk, bits): bit ``pos % 63`` of chunk ``pos div 63`` is set if source ``pos`` reaches the node.

    ``sources``: (node, pos).  One traversal of the components carries 63 sources in a word, as long as any word gains a bit.
    """
    sources = cut(sources.select("node", "pos"))
    scc, dag = condense(sources.select("node"), cut(edges))

    def spread(w: DataFrame) -> DataFrame:
        sent = w.join(dag, w.comp == dag.src).select(F.col("dst").alias("comp"), "chunk", "bits")
        return w.unionByName(sent).groupBy("comp", "chunk").agg(F.bit_or("bits").alias("bits"))

    start = sources.join(scc, "node").select("comp", F.expr("pos DIV 63").alias("chunk"), F.expr("shiftleft(1L, CAST(pos % 63 AS INT))").alias("bits"))
    words = settle(start.groupBy("comp", "chunk").agg(F.bit_or("bits").alias("bits")), spread, ["comp", "chunk", "bits"])
    return Members(scc).expand(words, "node").select("node", "chunk", "bits")


def two_hop_labels(edges: DataFrame, landmarks: DataFrame, form: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(node, l_out, l_in): sorted landmarks that the node reaches, and that reach it.

    With all nodes as ``landmarks`` (node), u reaches v exactly if ``l_out`` of u and ``l_in`` of v overlap; with fewer,
    overlap proves reachability and ``labels_reach`` decides the rest by search.  A component has one pair of labels, to
    which ``form`` is applied once before its nodes get them; nodes with neither label are left out.
    """
    landmarks = cut(landmarks.select("node").distinct())
    scc, dag = condense(landmarks, cut(edges))
    own = cut(landmarks.join(scc, "node").groupBy(F.col("comp").alias("at")).agg(F.collect_list("node").alias("l")))
    start = own.select(F.col("at").alias("node"))

    def label(along: DataFrame, name: str) -> DataFrame:
        met = reachable_by_source(along, start).select(F.col("source").alias("at"), F.col("node").alias("comp"))
        return met.join(own, "at").groupBy("comp").agg(F.sort_array(F.flatten(F.collect_list("l"))).alias(name))

    empty = F.array().cast("array<bigint>")
    both = label(reverse(dag), "l_out").join(label(dag, "l_in"), "comp", "full")
    formed = cut(both.select("comp", form(F.coalesce("l_out", empty)).alias("l_out"), form(F.coalesce("l_in", empty)).alias("l_in")))
    return Members(scc).expand(formed, "node").select("node", "l_out", "l_in")


def reaches_by_labels(edges: DataFrame, landmarks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``reaches``: labels and searches are those of the components, with the landmarks' components as landmarks."""
    pairs = cut(pairs.select("src", "dst"))
    scc, dag = condense(ends(pairs).unionByName(landmarks.select("node")), cut(edges))
    at = cut(pairs.join(scc.toDF("src", "a"), "src").join(scc.toDF("dst", "b"), "dst"))
    labels = cut(two_hop_labels(dag, landmarks.select("node").join(scc, "node").select(F.col("comp").alias("node")).distinct()))
    got = labels_reach(labels, dag, at.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    return at.join(got.toDF("a", "b", "reaches"), ["a", "b"]).select("src", "dst", "reaches")


def labels_reach(labels: DataFrame, edges: DataFrame, pairs: DataFrame, complete: bool = False) -> DataFrame:
    """``pairs`` (src, dst) with ``reaches``: by labels, and where labels don't overlap and aren't ``complete`` by search."""
    out, into = labels.select(F.col("node").alias("src"), "l_out"), labels.select(F.col("node").alias("dst"), "l_in")
    by_label = pairs.join(out, "src", "left").join(into, "dst", "left").select("src", "dst", ((F.col("src") == F.col("dst")) | F.coalesce(F.arrays_overlap("l_out", "l_in"), F.lit(False))).alias("reaches"))
    if complete:
        return by_label
    return by_label.filter("reaches").unionByName(reaches(edges, by_label.filter("NOT reaches").select("src", "dst")))


def witnesses(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, path): a shortest path of existing edges from one of ``sources`` (node), both ends included, for every node reached.

    Of several the one over the smallest node before, which is itself reached so.  Each round carries the paths of its new nodes.
    """
    edges = cut(edges)

    def step(new: DataFrame) -> DataFrame:
        sent = new.join(edges, new.node == edges.src).select(F.col("dst").alias("node"), "src", "path")
        return sent.groupBy("node").agg(F.min_by("path", "src").alias("path")).select("node", F.concat("path", F.array("node")).alias("path"))

    start = sources.select("node").distinct().withColumn("path", F.array("node"))
    return grow(start, step, ["node"]).select("node", "path")


def witness(edges: DataFrame, source: int, target: int) -> list[int] | None:
    """A shortest path of existing edges from source to target, both included; None if there is none."""
    row = witnesses(edges, edges.sparkSession.createDataFrame([(source,)], "node long")).filter(F.col("node") == target).first()
    return row and list(row["path"])


def connected_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected pair table (a, b), isolated nodes included; component is the smallest member.

    Labels travel along pairs and jump to their own label's label, so rounds grow with the logarithm of a path's length.
    """
    pairs = cut(pairs.select("a", "b"))  # what makes the pairs may cost more than all rounds
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())

    def step(c: DataFrame) -> DataFrame:
        sent = both.join(c, both.u == c.node).select(F.col("v").alias("node"), "component")
        near = c.unionByName(sent).groupBy("node").agg(F.min("component").alias("component"))
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("further"))
        return near.join(jump, "component").select("node", F.col("further").alias("component"))

    every = nodes.select("node").unionByName(both.select(F.col("u").alias("node"))).distinct()
    return settle(every.withColumn("component", F.col("node")), step, ["node", "component"])
