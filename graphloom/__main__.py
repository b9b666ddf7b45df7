"""Command line: index, graph, scan, eval.  Exit codes: 0 done, 1 findings at or above --fail-on, 2 wrong use, 3 no such symbol."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import dataflow, report, similarity
from graphloom.plans.ordered import numbered
from graphloom.sources.files import corpus_kloc, read_corpus
from graphloom.sources.index import Index

SINKS = ["unwrap", "expect", "exec", "execute", "query", "spawn", "command", "write", "write_all", "remove_file", "open", "send", "eval", "from_raw_parts", "transmute", "deserialize", "from_str"]


def scan(index: Index) -> DataFrame:
    """Findings of taint flows from entry points to sinks; line and evidence are those of the function that holds the sink."""
    program = dataflow.lower_calls(index.symbols, index.edges, SINKS)
    flows = dataflow.flows(dataflow.taint(program["stmts"], program["args"], program["params"], program["sources"]), program["stmts"])
    at = flows.join(index.symbols, flows.sink_func == index.symbols.id).join(index.files, "file_id")
    body = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    hashes = similarity.chunk_hashes(at.select(F.col("sink_func").alias("id"), body.alias("content")).distinct()).withColumnRenamed("id", "sink_func")
    return numbered(at.join(hashes, "sink_func"), "sink_func", "sink_idx", name="number").select(
        F.col("number").alias("id"), F.lit("taint-flow").alias("class"), F.lit("1").alias("rubric_version"), F.lit("info").alias("severity"), F.col("rel_path").alias("file"), "start", "end",
        (F.size(F.split(F.substring("content", 1, F.col("start").cast("int")).cast("string"), "\n"))).alias("line"), F.concat(F.lit("data of an entry point reaches a sink in "), "qual").alias("message"), body.cast("string").alias("evidence"), F.lit("").alias("rationale"),
        F.lit(0.0).alias("confidence"), F.lit(1.0).alias("e_value"), F.lit(1.0).alias("p_value"), similarity.fingerprint(F.lit("taint-flow"), F.lit("1"), F.col("hashes")).alias("fingerprint"), F.lit(1).alias("sites"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("-p", "--path", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    ix = commands.add_parser("index")
    ix.add_argument("--dump-graph", action="store_true")
    ix.add_argument("--dump-entry-points", action="store_true")
    sc = commands.add_parser("scan")
    sc.add_argument("--format", choices=["sarif", "json", "markdown", "terminal"], default="terminal")
    sc.add_argument("--fail-on", default="none")
    commands.add_parser("graph").add_argument("symbol")
    commands.add_parser("eval").add_argument("--corpus", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if args.command == "eval":
        k = corpus_kloc(read_corpus(spark, args.corpus)).first()
        print(f"{k['n']} advisories, {k['kloc']:.1f} KLOC")
        return 0
    index = Index.build(spark, args.path)
    names = index.symbols.select("id", "qual")
    if args.command == "index":
        print("{} files, {} symbols, {} edges".format(*index.counts()))
        if args.dump_entry_points:
            for r in index.entry_points().orderBy("id").toLocalIterator():
                print(f"{r['qual']}  {r['entry_reason']}")
        if args.dump_graph:
            fns = index.symbols.filter("kind = 'Fn'").select("id", "qual")
            lines = index.edges.join(fns.toDF("src", "caller"), "src").join(names.toDF("dst", "callee"), "dst").orderBy("src", "dst")
            for r in lines.toLocalIterator():
                print(f"{r['caller']} → {r['callee']}")
        return 0
    if args.command == "graph":
        at = index.definition_of(args.symbol)
        if at is None:
            print(f"no symbol {args.symbol}", file=sys.stderr)
            return 3
        for title, rows in (("callers", index.callers_of(at)), ("callees", index.callees_of(at))):
            print(title + ":", *[r["qual"] for r in rows.orderBy("id").toLocalIterator()])
        from graphloom.operators.graph import reachable, reverse

        up = reachable(reverse(index.edges), spark.createDataFrame([(at,)], "node long"))
        print("reached from:", *[r["qual"] for r in index.entry_points().join(up.withColumnRenamed("node", "id"), "id", "left_semi").orderBy("id").toLocalIterator()])
        return 0
    found = scan(index).persist()
    if args.format == "json":
        for r in report.json_rows(found).orderBy("id").toLocalIterator():
            print(r["json"])
    else:
        print(getattr(report, args.format)(found).first()[0])
    return int(report.gate(found, args.fail_on).first()["fail"])


if __name__ == "__main__":
    sys.exit(main())
