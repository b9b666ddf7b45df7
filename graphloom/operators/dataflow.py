"""Monotone dataflow, interprocedural taint and alias classes as relations and fixpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import connected_components
from graphloom.plans.fixpoint import cut, grow


def solve_forward(cfg: DataFrame, gen: DataFrame, kill: DataFrame | None = None) -> DataFrame:
    """OUT as (node, fact) of a gen/kill problem: IN is the union of the predecessors' OUT, OUT = gen with (IN without kill).

    cfg: (u, v); gen and kill: (node, fact).
    """
    cfg, kill = cut(cfg), cut(kill) if kill is not None else None  # each round reads them

    def step(new: DataFrame) -> DataFrame:
        moved = new.join(cfg, new.node == cfg.u).select(F.col("v").alias("node"), "fact")
        return moved.join(kill, ["node", "fact"], "left_anti") if kill is not None else moved

    return grow(gen.select("node", "fact"), step, ["node", "fact"]).select("node", "fact")


def join_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def less_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether every (node, fact) of a is in b."""
    return a.join(b, a.columns, "left_anti").isEmpty()


def return_vars(stmts: DataFrame) -> DataFrame:
    """(func, var) of each function's last return of a variable."""
    return stmts.filter("op = 'return' AND src IS NOT NULL").groupBy("func").agg(F.max_by("src", "idx").alias("var"))


def taint(stmts: DataFrame, args: DataFrame, params: DataFrame, sources: DataFrame) -> DataFrame:
    """(func, idx, var, src_func, src_var): tainted before statement idx, with the smallest source that was found first.

    stmts: (func, idx, op, dst, src, callee), idx dense from 0, op in assign, call, sanitize, sink, return, nop; an index one
    past the last statement is the exit.  args: (func, idx, pos, var); params: (func, pos, var); sources: (func, var).
    Calls pass arguments to parameters of the same position and let variables by, without killing dst; a return variable
    that is tainted at the exit taints dst after every call of the function.
    """
    stmts = cut(stmts.select("func", "idx", "op", "dst", "src", "callee"))  # each round reads what follows
    s = stmts.withColumnRenamed("src", "from_var")
    last = stmts.groupBy("func").agg((F.max("idx") + 1).alias("exit"))
    back = return_vars(stmts).join(last, "func").select(F.col("func").alias("callee"), "exit", F.col("var").alias("ret"))
    sites = s.filter("op = 'call' AND dst IS NOT NULL").join(back, "callee").select("callee", "exit", "ret", F.col("func").alias("to_func"), (F.col("idx") + 1).alias("to_idx"), F.col("dst").alias("to_var"))
    sites = cut(sites)
    calls = s.filter("op = 'call'").select("func", "idx", "callee").join(args.withColumnRenamed("var", "arg"), ["func", "idx"]).join(
        params.select(F.col("func").alias("callee"), "pos", F.col("var").alias("param")), ["callee", "pos"]).select("func", "idx", "arg", "callee", "param")
    calls = cut(calls)
    keep = ["src_func", "src_var"]

    def step(new: DataFrame) -> DataFrame:
        at = new.join(s, ["func", "idx"])
        stay = at.filter("NOT (op = 'assign' AND var = dst) AND NOT (op = 'sanitize' AND var = dst)").select("func", (F.col("idx") + 1).alias("idx"), "var", *keep)
        born = at.filter("op = 'assign' AND var = from_var").select("func", (F.col("idx") + 1).alias("idx"), F.col("dst").alias("var"), *keep)
        into = new.join(calls, ["func", "idx"]).filter("var = arg").select(F.col("callee").alias("func"), F.lit(0).cast("long").alias("idx"), F.col("param").alias("var"), *keep)
        n = new.select(F.col("func").alias("callee"), F.col("idx").alias("exit"), F.col("var").alias("ret"), *keep)
        out = n.join(sites, ["callee", "exit", "ret"]).select(F.col("to_func").alias("func"), F.col("to_idx").alias("idx"), F.col("to_var").alias("var"), *keep)
        every = stay.unionByName(born).unionByName(into).unionByName(out)
        return every.groupBy("func", "idx", "var").agg(F.min(F.struct(*keep)).alias("s")).select("func", "idx", "var", "s.*")

    seed = sources.select("func", F.lit(0).cast("long").alias("idx"), "var", F.col("func").alias("src_func"), F.col("var").alias("src_var"))
    return grow(seed, step, ["func", "idx", "var"])


def flows(facts: DataFrame, stmts: DataFrame) -> DataFrame:
    """At most one flow for each sink statement: (src_func, src_var, sink_func, sink_idx); a sink's operand is its ``src``."""
    sinks = stmts.filter("op = 'sink'").select("func", "idx", F.col("src").alias("var"))
    return facts.join(sinks, ["func", "idx", "var"]).groupBy("func", "idx").agg(F.min(F.struct("src_func", "src_var")).alias("s")).select(
        "s.src_func", "s.src_var", F.col("func").alias("sink_func"), F.col("idx").alias("sink_idx"))


def lower_calls(symbols: DataFrame, edges: DataFrame, sink_names: list[str]) -> dict[str, DataFrame]:
    """One-variable taint program of a call graph: callees in id order are sinks by name or calls, then a return of variable 0.

    symbols: (id, name, kind, entry); edges: (src, dst).  Gives stmts, args, params and sources for ``taint``.
    """
    fns = symbols.filter("kind = 'Fn'")
    callee = symbols.select(F.col("id").alias("dst"), F.lower("name").isin([n.lower() for n in sink_names]).alias("is_sink"))
    order = F.expr("CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT)")
    called = edges.join(fns.select(F.col("id").alias("src")), "src", "left_semi").join(callee, "dst").select(F.col("src").alias("func"), order.alias("idx"), F.when(F.col("is_sink"), "sink").otherwise("call").alias("op"), F.col("dst").alias("callee"))
    zero = F.lit(0).cast("long")
    body = called.select("func", "idx", "op", F.when(F.col("op") == "call", zero).alias("dst"), F.when(F.col("op") == "sink", zero).alias("src"), "callee")
    n = called.groupBy("func").agg(F.count("*").alias("n"))
    ends = fns.select(F.col("id").alias("func")).join(n, "func", "left").select("func", F.coalesce("n", zero).alias("idx"), F.lit("return").alias("op"), F.lit(None).cast("long").alias("dst"), zero.alias("src"), F.lit(None).cast("long").alias("callee"))
    return {
        "stmts": body.unionByName(ends), "args": called.filter("op = 'call'").select("func", "idx", zero.alias("pos"), zero.alias("var")),
        "params": fns.select(F.col("id").alias("func"), zero.alias("pos"), zero.alias("var")), "sources": fns.filter("entry").select(F.col("id").alias("func"), zero.alias("var")),
    }


def tainted_nodes(edges: DataFrame, entries: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """(node, level) that taint reaches along calls from ``entries``; a sanitizer (node) is reached but passes nothing on."""
    passing = cut(edges.join(sanitizers.select(F.col("node").alias("src")), "src", "left_anti"))
    return grow(entries.select("node"), lambda new: new.join(passing, new.node == passing.src).select(F.col("dst").alias("node")), ["node"])


def alias_classes(nodes: DataFrame, unions: DataFrame) -> DataFrame:
    """(node, component): unification-based alias classes from pairs (a, b); two nodes may alias exactly if theirs agree."""
    return connected_components(nodes, unions)


def may_alias(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``alias``; a node without class is only its own alias."""
    x, y = classes.toDF("a", "ca"), classes.toDF("b", "cb")
    return pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", (F.coalesce("ca", "a") == F.coalesce("cb", "b")).alias("alias"))
