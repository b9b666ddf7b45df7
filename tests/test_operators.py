"""Goldens of graph, dataflow, planning, statistics, similarity, review, report and streams."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import hashing
from graphloom.functions.numbers import erfc, nearest_rank, portable_hash, rounded
from graphloom.operators import dataflow, graph, planning, report, resolve, review, similarity, stats
from graphloom.plans import catalogue
from graphloom.plans.ordered import numbered_within
from graphloom.streaming import watch


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "node long")


def test_components_of_two_cycles(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (2, 3), (5, 0)])
    scc = graph.strong_components(ids(spark, range(6)), e)
    assert {r.node: r.scc_id for r in scc.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert sorted(map(tuple, graph.condensation(scc, e).collect())) == [(0, 3), (5, 0)]
    assert not graph.is_acyclic(ids(spark, range(6)), e) and graph.is_acyclic(ids(spark, range(3)), edges(spark, [(0, 1), (1, 2)]))


def test_reach_against_search(spark):
    rng = random.Random(0xC0FFEE)
    pairs = {(a, b) for a in range(40) for b in range(40) if rng.random() < 0.03}
    e = edges(spark, sorted(pairs))
    seen = {}
    for s in range(40):
        todo, found = [s], {s}
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in found:
                    found.add(b)
                    todo.append(b)
        seen[s] = found
    every = spark.createDataFrame([(a, b) for a in range(40) for b in range(40)], "src long, dst long")
    labels = graph.two_hop_labels(e, ids(spark, range(40)))
    assert {(r.src, r.dst): r.reaches for r in graph.labels_reach(labels, e, every, complete=True).collect()} == {(a, b): b in seen[a] for a in range(40) for b in range(40)}
    sources = spark.createDataFrame([(k, k) for k in range(40)], "node long, pos long")
    bits = {r.node: r.bits for r in graph.bit_reach(e, sources).collect()}
    assert all((bits[b] >> a & 1) == (b in seen[a]) for a in range(40) for b in range(40))


def test_forward_solution(spark):
    cfg = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u long, v long")
    gen = spark.createDataFrame([(0, 0), (1, 1), (3, 2)], "node long, fact long")
    assert sorted(map(tuple, dataflow.solve_forward(cfg, gen).collect())) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


STMTS = "func long, idx long, op string, dst long, src long, callee long"


@pytest.mark.parametrize(("stmts", "args", "params", "sources", "flows"), [
    ([(0, 0, "assign", 1, 0, None), (0, 1, "sink", None, 1, None), (0, 2, "return", None, 1, None)], [], [(0, 0, 0)], [(0, 0)], [(0, 1)]),
    ([(0, 0, "sanitize", 0, None, None), (0, 1, "sink", None, 0, None), (0, 2, "return", None, 0, None)], [], [(0, 0, 0)], [(0, 0)], []),
    ([(0, 0, "call", 1, None, 1), (0, 1, "sink", None, 1, None), (0, 2, "return", None, 1, None), (1, 0, "sink", None, 5, None), (1, 1, "return", None, 5, None)], [(0, 0, 0, 0)], [(0, 0, 0), (1, 0, 5)], [(0, 0)], [(0, 1), (1, 0)]),
    ([(0, 0, "assign", 1, None, None), (0, 1, "sink", None, 1, None), (0, 2, "return", None, 0, None)], [], [(0, 0, 0)], [(0, 0)], []),
])
def test_taint(spark, stmts, args, params, sources, flows):
    s = spark.createDataFrame(stmts, STMTS)
    facts = dataflow.taint(s, spark.createDataFrame(args, "func long, idx long, pos long, var long"), spark.createDataFrame(params, "func long, pos long, var long"), spark.createDataFrame(sources, "func long, var long"))
    assert sorted((r.sink_func, r.sink_idx) for r in dataflow.flows(facts, s).collect()) == flows


def test_alias(spark):
    c = dataflow.alias_classes(ids(spark, [1, 2, 3]), spark.createDataFrame([(1, 2)], "a long, b long"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (9, 9)], "a long, b long")
    assert [r.alias for r in dataflow.may_alias(c, pairs).orderBy("b").collect()] == [True, False, True]


CHAIN = "id long, tokens array<int>, cost long, pos long"


def test_trie(spark):
    c = spark.createDataFrame([(0, [1, 2, 3], 3, 0), (1, [1, 2, 4], 3, 1), (2, [1, 5], 2, 2)], CHAIN)
    row = planning.trie_summary(c).first()
    assert (row.nodes, row.root_children, row.naive_prefill) == (6, 1, 8)
    assert [r.id for r in planning.trie_order(c).orderBy("rank_path").collect()] == [0, 1, 2]
    two = spark.createDataFrame([(0, [1, 2], 2, 0), (1, [3, 4], 2, 1)], CHAIN)
    assert planning.trie_summary(two).first().nodes == 5
    assert {r.id for r in planning.tree_partition(c, 2).collect()} == {0, 1, 2}


def test_greedy(spark):
    w = spark.createDataFrame(list(enumerate([5, 4, 3, 3, 2])), "id long, w long")
    got = {}
    for r in planning.lpt(w, 2).collect():
        got.setdefault(r.worker, []).append(r.id)
    assert sorted(map(sorted, got.values())) == [[0, 3], [1, 2, 4]]
    none = spark.createDataFrame([], "element long, weight double")
    item = lambda rows: spark.createDataFrame(rows, "id long, cost long, covers array<long>")
    pick = lambda rows, b: [r.id for r in planning.budgeted_coverage(item(rows), none, b).orderBy("step").collect()]
    assert sorted(pick([(0, 2, [0, 1]), (1, 3, [1, 2]), (2, 1, [3])], 3)) == [0, 2]
    assert sorted(pick([(0, 2, [0, 1, 2]), (1, 2, [2, 3]), (2, 1, [4]), (3, 3, [0, 4])], 4)) == [0, 2]


def test_schedule(spark):
    s = spark.createDataFrame(list(enumerate([1, 2, 1, 3, 2])), "pos long, block long")
    assert [r.next_use for r in planning.next_use_hints(s).orderBy("pos").collect()] == [2, 4, *[planning.NEVER] * 3]
    r = spark.createDataFrame([(0, 5, 0), (1, 2, 1), (2, None, 2)], "block long, next_use long, pos long")
    assert planning.evict_candidate(r).first().block == 2
    p = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 3)], "chain long, block long")
    assert [r.next_use for r in planning.next_use_by_chain(p).filter("chain = 0").orderBy("block").collect()] == [1, 1, None]


def test_inspection(spark):
    box = lambda v: [(float(v), 0.5), (0.0, 0.5)]
    b = spark.createDataFrame([(0, box(10), 1.0), (1, box(100), 1.0), (2, box(2), 1.0), (3, box(9), 0.0), (4, [], 1.0)], "id long, dist array<struct<v:double,p:double>>, cost double")
    rows = planning.inspection_order(b).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 0, 2, 3, 4] and rows[1].sigma == pytest.approx(8)
    assert planning.should_stop(98.0, planning.inspection_order(b)).first().stop
    s = spark.createDataFrame([(a, k, float(a == 2) + k / 100) for a in range(4) for k in range(4)], "arm long, level long, reward double")
    assert planning.successive_halving(s, 3).first().arm == 2


def test_false_discovery(spark):
    p = spark.createDataFrame(list(enumerate([0.001, 0.04, 0.03, 0.6, 0.8])), "i long, p double")
    assert [r.i for r in stats.benjamini_hochberg(p, 0.1).orderBy("rank").collect()] == [0, 2, 1]
    e = spark.createDataFrame(list(enumerate([0.1, 50.0, 5.0, 0.5])), "i long, e double")
    assert [r.i for r in stats.e_bh(e, 0.1).collect()] == [1] and stats.e_bh(e, 0.0).count() == 0
    rng = random.Random(1)
    ps = [rng.random() ** 3 for _ in range(30)]
    got = stats.alpha_investing(spark.createDataFrame([(0, t, x) for t, x in enumerate(ps, 1)], "k int, t int, p double"), 0.2, ["k"]).orderBy("t").collect()
    wealth = 0.2
    for t, (x, r) in enumerate(zip(ps, got, strict=True), 1):
        spend = min(0.2 * 0.5**t, wealth)
        wealth += -spend + 0.2 * (x <= spend)
        assert r.reject == (x <= spend) and r.wealth == pytest.approx(wealth)


def test_calibration(spark):
    rows = [(k, k / 10, y) for k, y in enumerate([0, 0, 1, 0, 1, 1, 0, 1, 1, 1])]
    s = spark.createDataFrame(rows, "id long, score double, label int")
    steps = stats.isotonic_fit(s)
    assert [(r.score, round(r.p, 4)) for r in steps.collect()] == [(0.0, 0.0), (0.2, 0.5), (0.4, 0.6667), (0.7, 1.0)]
    q = spark.createDataFrame([(0, -1.0), (1, 0.05), (2, 0.85), (3, 0.2)], "id long, score double")
    assert [round(r.p, 6) for r in stats.isotonic_predict(q, steps).orderBy("id").collect()] == [0.0, 0.125, 1.0, 0.5]
    half = spark.createDataFrame([(0.5, y) for y in (1, 0, 1, 0)], "score double, label int")
    assert stats.ece(half, 1).first().ece == 0
    a, b = stats.platt_fit(s, 50, 1.0)
    assert a > 0 and b < 0
    cal = spark.createDataFrame([(float(k),) for k in range(1, 101)], "score double")
    assert stats.conformal_threshold(cal, 0.1).first().threshold == 91 and stats.conformal_threshold(cal.limit(0), 0.1).first().threshold == math.inf


@pytest.mark.parametrize(("llr", "e", "alpha", "beta", "cap", "decision", "turn"), [(2.197, 9.0, 0.05, 0.05, 16, "accept", 2), (-2.197, 0.111, 0.05, 0.05, 16, "reject", 2), (0.0, 1.0, 0.05, 0.05, 3, "reject", 3), (0.0, 50.0, 0.1, 0.1, 16, "accept", 1), (0.1, 1.1, 0.05, 0.05, 30, "continue", 20)])
def test_sequential(spark, llr, e, alpha, beta, cap, decision, turn):
    t = spark.createDataFrame([(0, k, llr, e) for k in range(1, 21)], "c int, turn int, llr double, e double")
    r = stats.sequential_test(t, alpha, beta, cap, ["c"]).first()
    assert (r.decision, r.turn) == (decision, turn)


def test_paired(spark):
    p = spark.createDataFrame([(i, True, i >= 15) for i in range(45)], "i long, a boolean, b boolean")
    r = stats.mcnemar(p).first()
    assert r.stat == pytest.approx(196 / 15) and r.p < 0.01 and stats.mcnemar(p.withColumn("b", F.col("a"))).first().p == 1
    low, high = stats.paired_bootstrap(p, 100, 3)
    assert 0 < low <= high <= 1
    x = spark.range(1).select(erfc(F.lit(0.5)).alias("e"), nearest_rank(F.array(*map(F.lit, (1, 2, 3, 4))), 0.5).alias("q")).first()
    assert x.e == pytest.approx(math.erfc(0.5), abs=1e-6) and x.q == 3


def test_metrics(spark):
    c = spark.createDataFrame([("A", "inj", "a.rs", "a.rs", 2.0), ("B", "ssrf", "b.rs", "b.rs", 2.0)], "id string, class string, vuln_file string, patch_file string, kloc double")
    p = spark.createDataFrame([("A", False, True, True, "inj", "a.rs", 100, False, 0.9), ("B", False, False, False, "ssrf", "b.rs", 100, False, 0.8), ("A", True, True, True, "inj", "a.rs", 100, False, 0.7), ("B", True, False, False, "ssrf", "x.rs", 200, True, 0.7)],
                              "advisory string, on_patched boolean, detected boolean, localized boolean, class string, file string, tokens long, discarded boolean, cache_hit double")
    assert tuple(round(x, 6) for x in stats.run_metrics(p, c).first()) == (0.5, 0.5, 0.5, 0.25, 125.0, 0.775)


def test_similarity(spark):
    t = spark.createDataFrame([(0, "fn a ( x ) { return x + 1 }"), (1, "fn a ( x ) { return x + 1 }"), (2, "struct other with nothing in common at all")], "id long, text string")
    got = {r.id: r.cluster for r in similarity.lsh_clusters(similarity.signatures(t, 3, 128), bands=20, rows=6).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert {r.id: r.cluster for r in similarity.clusters(similarity.signatures(t, 3, 128), bands=20, rows=6, threshold=0.9).collect()} == {0: 0, 1: 0, 2: 1}
    pair = spark.createDataFrame([(0, "a b c d e f g h"), (1, "a b c d e f g j")], "id long, text string")
    a, b = (r.sig for r in similarity.signatures(pair, 2, 256).orderBy("id").collect())
    assert 0.4 < np.mean(np.array(a) == np.array(b)) < 0.95
    assert similarity.cut_points(b"") == []
    data = bytes((i * 31) % 251 for i in range(20000))
    for d in (data, random.Random(1).randbytes(50000)):
        cuts = similarity.cut_points(d)
        assert sum(n for _, n in cuts) == len(d) and all(n <= similarity.MOST for _, n in cuts) and all(n >= similarity.LEAST for _, n in cuts[:-1])
    d = random.Random(2).randbytes(30000)
    tail = lambda x: x[sum(similarity.cut_points(x)[-1][:1]) :]
    assert tail(d) == tail(random.Random(3).randbytes(300) + d)


def slow_cuts(data):
    out, start = [], 0
    while start < len(data):
        left, h, size = len(data) - start, 0, None
        for i in range(similarity.LEAST, left):
            h = (h * 2 + int(similarity._GEAR[data[start + i]])) % 2**64
            if i == similarity.MOST or h % 512 == 0:
                size = i + (i != similarity.MOST)
                break
        out.append((start, size or left))
        start += size or left
    return out


def test_cut_points_are_those_of_a_rolling_hash():
    rng = random.Random(5)
    for n in [*range(12), 63, 64, 65, 70, 72, 73, 80, 4095, 4096, 4097, 9000, 30000]:
        for d in (rng.randbytes(n), bytes(n), b"ab" * (n // 2)):
            assert similarity.cut_points(d) == slow_cuts(d)


def test_match_levels(spark):
    base = spark.createDataFrame([(0, "c", "p", "s", "y")], "idx long, class string, path string, span string, symbol string")
    f = spark.createDataFrame([(1, "c", "p", "s", "y"), (2, "c", "q", "s", "z"), (3, "c", "q", "t", "y"), (4, "d", "p", "s", "y")], "id long, class string, path string, span string, symbol string")
    assert [r.level for r in resolve.match_level(f, base).orderBy("id").collect()] == [1, 2, 3, None]


def test_review(spark):
    texts = ['x {"verdict":"vuln","p":0.9,"note":"n"} y', '} trailing {"verdict":"vuln"', '{"verdict":"maybe","p":1}', '{"verdict":"benign"}', "none"]
    j = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", review.parse_judgment(F.col("t")).alias("j")).orderBy("i").collect()
    assert (j[0].j.verdict, j[0].j.p, j[0].j.note) == ("vuln", 0.9, "n") and all(r.j is None for r in j[1:])
    files = spark.createDataFrame([(0, bytearray(b"let key = user_id;\n"))], "file_id int, content binary")
    slices = spark.createDataFrame([(0, 0, 4), (1, 0, 4)], "slice int, file_id int, start long")
    ok = '{"findings":[{"class":"injection","start_byte":0,"end_byte":3,"cited_snippet":"key ","confidence":0.5,"rationale":"r"}]}'
    answers = spark.createDataFrame([(0, ok), (1, ok.replace("key ", "invented"))], "slice int, content string")
    assert [(r.slice, r.start) for r in review.pass1(files, slices, answers).collect()] == [(0, 4)]
    turn = lambda p: [(k, t, f'{{"verdict":"vuln","p":{q}}}') for k, q in enumerate(p) for t in range(4)]
    got = {r.candidate: (r.decision, r.turn) for r in review.pass2(spark.createDataFrame(turn([0.95, 0.05]), "candidate int, turn int, content string")).collect()}
    assert got == {0: ("accept", 1), 1: ("reject", 1)} or all(g[1] <= 2 for g in got.values())
    script = review.ScriptedModel(spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "candidate int, turn int, content string"))
    asked = spark.createDataFrame([(0, 0, "p"), (0, 5, "p")], "candidate int, turn int, prompt string")
    assert sorted((r.turn, r.content) for r in script.complete(asked).collect()) == [(0, "a"), (5, "b")]
    assert review.chat_answer('{"choices":[{"message":{"content":null,"tool_calls":[{"function":{"name":"grep","arguments":"{bad"}}]}}]}') == ("", [("grep", {})])


def test_report(spark):
    row = (1, "inj", "1", "high", "src/cache.rs", 10, 4, 42, "a|b", "  first \nsecond", "why", 0.875, 2.0, 0.01, bytearray(range(16)), 3)
    f = spark.createDataFrame([row], "id long, class string, rubric_version string, severity string, file string, start long, end long, line long, message string, evidence string, rationale string, confidence double, e_value double, p_value double, fingerprint binary, sites int")
    log = json.loads(report.sarif(f).first()[0])
    result = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"] == {"startLine": 42, "byteOffset": 10, "byteLength": 0}
    assert log["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "inj" and result["partialFingerprints"][f"{report.TOOL}/primary"] == bytes(range(16)).hex()
    assert "| high | `inj` | `src/cache.rs:42` | 0.8" in report.markdown(f).first()[0] and "a\\|b" in report.markdown(f).first()[0]
    assert "No findings" in report.markdown(f.limit(0)).first()[0] and report.terminal(f.limit(0)).first()[0] == "no findings\n"
    assert report.terminal(f).first()[0].startswith("high     inj                    src/cache.rs:42  p=0.88 e=2.0\n  a|b\n  > first\n")
    s = report.summary(f).first()
    assert (s.total, s.high, s.low) == (1, 1, 0)
    assert [report.gate(f, x).first().fail for x in ("critical", "high", "medium", "info", "none")] == [False, True, True, False, False]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(src)
    stream = watch.windowed_counts(spark.readStream.schema(events.schema).parquet(src))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").select("start", "event_type", "n").collect()} == {tuple(r) for r in watch.windowed_counts(events).select("start", "event_type", "n").collect()}


def test_catalogue_has_names():
    assert len(catalogue.QUERIES) > 50 and catalogue.SQL.keys() <= catalogue.QUERIES.keys()


def test_rounding_of_halves_is_that_of_sql(spark):
    import duckdb

    got = [tuple(r) for r in spark.range(-20000, 20001).select((F.col("id") / 1000).alias("x")).select("x", rounded("x", 2)).collect()]
    want = dict(duckdb.sql("SELECT x, round(x, 2) FROM (SELECT k / 1000 AS x FROM range(-20000, 20001) t(k))").fetchall())
    assert len(got) == len(want) and all(want[x] == y for x, y in got)


def compared(spark, folder, name):
    """Rows of a query and of its SQL over the parquet files of a folder, sorted."""
    import duckdb

    db = duckdb.connect()
    for p in folder.iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return sorted(map(tuple, catalogue.QUERIES[name](spark, str(folder)).collect())), sorted(db.execute(catalogue.SQL[name]).fetchall())


def test_inspection_order_of_prices_between_two_cents(spark, tmp_path):
    spark.createDataFrame([(k, k, 145.0 + 140 * k, "1-URGENT") for k in range(1, 60)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got, want = compared(spark, tmp_path, "inspection_order")
    assert got == want


def test_reports_of_confidences_between_two_hundredths(spark, tmp_path):
    spark.createDataFrame([(k, "en", "s", k * 200) for k in range(1, 200)], "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(1, 200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("report_markdown", "report_terminal"):
        got, want = compared(spark, tmp_path, name)
        assert got == want


def test_an_empty_text_is_cited_by_no_finding(spark, tmp_path):
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(["", " ", "a", None])], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = compared(spark, tmp_path, "review_pass1")
    assert got == want == [(1, 0), (2, 0)]


def test_prediction_looks_at_a_row_once(spark):
    """400,000 scores in one range, with all steps at its ends: frames that are read anew for every row would take an hour."""
    steps = spark.createDataFrame([(-1.0, 0.0), (2.0, 3.0)], "score double, p double")
    scores = spark.range(400_000).select("id", (F.col("id") / 400_000).alias("score"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.monotonic()
        worst = stats.isotonic_predict(scores, steps).agg(F.max(F.abs(F.col("p") - F.col("score") - 1)).alias("d")).first().d
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert worst < 1e-9 and time.monotonic() - began < 120


def reached(pairs, start):
    """All that each of ``start`` reaches by at least one edge."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, []).append(b)
    out = {}
    for s in start:
        todo, found = list(to.get(s, ())), set()
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += to.get(x, ())
        out[s] = found
    return out


def test_searches_over_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    rng = random.Random(1)
    n = 40
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(54)})
    e, seen = edges(spark, pairs), reached(pairs, range(n))
    scc = {x: min([x, *(y for y in seen[x] if x in seen[y])]) for x in range(n)}
    assert {r.node: r.scc_id for r in graph.strong_components(ids(spark, range(n)), e).collect()} == scc
    assert sorted(map(tuple, graph.closure(e).collect())) == sorted((a, b) for a in range(n) for b in seen[a])
    marks = [3, 4, 5, 6, 7, n + 1]
    assert sorted(map(tuple, graph.reach_sets(e, ids(spark, marks)).collect())) == sorted((a, b) for a in marks for b in seen.get(a, set()) | {a})
    labels = {r.node: (r.l_out, r.l_in) for r in graph.two_hop_labels(e, ids(spark, marks)).collect()}
    out = lambda x: [m for m in marks if m == x or m in seen.get(x, ())]
    into = lambda x: [m for m in marks if m == x or x in seen.get(m, ())]
    assert labels == {x: (out(x), into(x)) for x in [*range(n), n + 1] if out(x) or into(x)}
    asked = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(n + 1, n + 1), (n + 2, 0)]
    want = sorted((a, b, a == b or b in seen.get(a, ())) for a, b in asked)
    p = spark.createDataFrame(asked, "src long, dst long")
    assert sorted(map(tuple, graph.reaches(e, p).collect())) == want == sorted(map(tuple, graph.reaches_by_labels(e, ids(spark, marks), p).collect()))


def test_components_in_rounds_are_those_of_one_task(spark, monkeypatch):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 4), (5, 0), (6, 6)]
    in_one = sorted(map(tuple, graph.strong_components(ids(spark, range(8)), edges(spark, pairs)).collect()))
    assert in_one == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7)]
    monkeypatch.setattr(graph, "ONE_TASK", -1)
    assert sorted(map(tuple, graph.strong_components(ids(spark, range(8)), edges(spark, pairs)).collect())) == in_one


def test_long_cycles_take_no_rounds(spark):
    """One component of 3,000 nodes, which a search crosses in 3,000 rounds."""
    n = 3000
    e, began = edges(spark, [(k, (k + 1) % n) for k in range(n)]), time.monotonic()
    assert graph.strong_components(ids(spark, range(n)), e).filter("scc_id = 0").count() == n
    assert graph.reach_sets(e, ids(spark, [5, 6])).distinct().count() == 2 * n
    assert graph.reaches(e, edges(spark, [(7, 6)])).first().reaches and graph.reaches_by_labels(e, ids(spark, [1]), edges(spark, [(7, 6)])).first().reaches
    assert graph.bit_reach(e, spark.createDataFrame([(4, 0), (5, 64)], "node long, pos long")).filter("chunk = 0 AND bits = 1 OR chunk = 1 AND bits = 2").count() == 2 * n
    assert graph.two_hop_labels(e, ids(spark, [9])).filter("l_out[0] = 9 AND l_in[0] = 9").count() == n
    assert graph.closure(e).count() == n * n
    assert time.monotonic() - began < 240


def counted(spark, df):
    """``df``, and a counter of its rows each time they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_signatures_are_made_once_and_right(spark):
    texts = ["a b c d e f g", "a b", "", None, "x\x1cy z\x85a\u00a0b c", "one  two\nthree four five six one two three four five six"] + ["w " * 9 + str(k // 3) for k in range(30)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    x = similarity.shingle_texts(t, 5).select("id", (portable_hash(F.col("shingle")) % hashing.PRIME).alias("x")).collect()
    want = {i: [min((a * r.x + b) % hashing.PRIME for r in x if r.id == i) for a, b in hashing.universal(16)] for i in {r.id for r in x}}
    sigs = similarity.portable_signatures(t, 5, 16)
    assert {r.id: r.sig for r in sigs.collect()} == want
    h = hashing.shingle_hashes(texts[5], 5)
    assert list(hashing.minhash_values(h, 16)) == [min(hashing.splitmix(h ^ s)) for s in hashing.splitmix(np.arange(16, dtype=np.uint64))]
    for f in (lambda d: similarity.lsh_clusters(d, bands=4, rows=4), lambda d: similarity.clusters(d, bands=4, rows=4, threshold=0.8)):
        once, seen = counted(spark, sigs)
        got = {r.id: r.cluster for r in f(once).collect()}
        assert seen.value == len(want) and all(got[k] == got[k - (k - 6) % 3] for k in range(6, 36))


def test_numbers_within_one_large_group(spark):
    rows = [("a" if k % 10 else "b", k * 7919 % 1000, k) for k in range(1000)]
    got = sorted(map(tuple, numbered_within(spark.createDataFrame(rows, "g string, o long, k long").repartition(5), "g", "o", "k").select("g", "o", "k", "rank").collect()))
    assert got == [(g, o, k, n) for x in "ab" for n, (g, o, k) in enumerate(sorted(r for r in rows if r[0] == x), 1)]


def test_rounds_do_not_make_their_inputs_anew(spark):
    e, seen = counted(spark, edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)]))
    assert graph.reachable(e, ids(spark, [0])).count() == 5 and seen.value == 4
    e, seen = counted(spark, edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)]))
    assert graph.witnesses(e, ids(spark, [0])).count() == 5 and seen.value == 4
    cfg, seen = counted(spark, spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u long, v long"))
    assert dataflow.solve_forward(cfg, spark.createDataFrame([(0, 0)], "node long, fact long")).count() == 4 and seen.value == 3
    stmts, seen = counted(spark, spark.createDataFrame([(0, k, "assign", k + 1, k, None) for k in range(3)] + [(0, 3, "sink", None, 3, None)], STMTS))
    none = "func long, idx long, pos long, var long"
    facts = dataflow.taint(stmts, spark.createDataFrame([], none), spark.createDataFrame([(0, 0, 0)], "func long, pos long, var long"), spark.createDataFrame([(0, 0)], "func long, var long"))
    assert facts.filter("idx = 3 AND var = 3").count() == 1 and seen.value == 4


def parts_by_recursion(chains, workers):
    target = math.ceil(sum(c for _, _, c in chains) / workers)
    root, parts = ({}, []), []
    for i, tokens, cost in chains:
        node = root
        for x in tokens:
            node = node[0].setdefault(x, ({}, []))
        node[1][:] = [(i, cost)]

    def up(node):
        held, carried = ([node[1][0][0]], node[1][0][1]) if node[1] else ([], 0)
        for kid in node[0].values():
            ids, cost = up(kid)
            if cost > 0:
                held, carried = held + ids, carried + cost
                if carried >= target:
                    parts.append(held)
                    held, carried = [], 0
        return held, carried

    if left := up(root)[0]:
        parts.append(left)
    while len(parts) > workers:
        parts.sort(key=len)
        parts[:2] = [parts[0] + parts[1]]
    return sorted((k, i) for k, p in enumerate(parts) for i in p)


def test_tree_partition_of_a_stream(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(3) for _ in range(rng.randrange(6))], rng.randrange(4)) for i in range(200)]
    schema = "id long, tokens array<int>, cost long"
    for workers in (1, 3, 8):
        assert sorted(map(tuple, planning.tree_partition(spark.createDataFrame(rows, schema).repartition(3), workers).collect())) == parts_by_recursion(rows, workers)
    deep = spark.createDataFrame([(0, [1] * 1500, 1), (1, [1] * 1499 + [2], 1)], schema)
    assert {r.id for r in planning.tree_partition(deep, 1).collect()} == {0, 1}
