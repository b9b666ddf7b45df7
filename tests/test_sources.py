"""Rust parser, index, spans, command line."""

from pathlib import Path

from pyspark.sql import functions as F

from graphloom import __main__ as cli
from graphloom.functions import spans
from graphloom.operators.review import execute_tool
from graphloom.sources.files import ignored, parse_ignore, source_files
from graphloom.sources.index import Index
from graphloom.sources.rust import entry_reason, module_of, parse, qualified

FIXTURE = str(Path(__file__).parent / "fixture")


def calls(body):
    return [c for _, c in parse("fn f() {" + body + "}", "src/lib.rs")[1]]


def test_calls():
    assert calls("a(b(), c::d::<T>(1)); x.y(z())?.w().await;") == ["a", "b", "c::d", "y", "z", "w"] or sorted(calls("a(b(), c::d::<T>(1)); x.y(z())?.w().await;")) == sorted(["a", "b", "c::d", "y", "z", "w"])
    assert calls("m!(a()); unsafe { b() } let q = async { c() }; let s = S { x: d() }; let v = e() as u8; for i in f()..g() {} fn n() { h() }") == []
    assert sorted(calls("if a() && b() { c() } else if d() { e() } match f() { X(_) if g() => h(), _ => { i() } } while let Some(x) = j() { k(x)[l()]; }")) == list("abcdefghijkl")
    assert calls("let t = |x: u8| -> u8 { a(x) }; loop { break b(); } return c();") == ["a", "c"]
    assert calls("(make())(1);") == ["_"]


def test_names():
    assert [module_of(p) for p in ("src/lib.rs", "src/a/mod.rs", "src/a/b.rs", "src/main.rs", "x.rs")] == ["", "a", "a::b", "", "x"]
    assert qualified([""], "f") == "f" and qualified(["", "m"], "f") == "::m::f" and qualified(["a::b", "m"], "f") == "a::b::m::f"
    assert entry_reason("main", [], []) == "fn main" and entry_reason("f", ["rocket::get"], []) == "handler attribute #[rocket::get]"
    assert entry_reason("f", [], ["u8", "State<A>"]) == "extractor parameter `State<A>`" and entry_reason("f", [], ["&Request"]) is None
    assert parse("fn broken( {", "x.rs") is None and parse("", "x.rs") == ([], [])


def test_span_text():
    text = "fn handle(req: u64) -> u64 {\n    let x = req;\n    x.unwrap_me()\n}\n"
    s = parse(text, "src/lib.rs")[0][0]
    assert text[s.start : s.end] == text.rstrip() and text[s.name_start : s.name_end] == "handle"
    s = parse("// é\nfn ü() {}", "src/lib.rs")[0][0]
    assert "// é\nfn ü() {}".encode()[s.name_start : s.name_end].decode() == "ü"


def test_index(spark, tmp_path):
    index = Index.build(spark, FIXTURE)
    names = {r.id: (r.name, r.kind, r.entry_reason) for r in index.symbols.collect()}
    assert [names[k][:2] for k in range(9)] == [("AppState", "Struct"), ("tenant", "Field"), ("cache_get", "Fn"), ("service", "Mod"), ("lookup", "Fn"), ("fallback", "Fn"), ("repo", "Mod"), ("fetch", "Fn"), ("main", "Fn")]
    assert names[2][2] == "extractor parameter `axum::extract::State<AppState>` (axum)" and names[8][2] == "fn main"
    assert sorted(map(tuple, index.edges.collect())) == [(2, 4), (4, 5), (4, 7), (5, 4), (8, 2)]
    assert index.reaches(8, 7) and not index.reaches(7, 8) and index.witness(8, 7) == [8, 2, 4, 7] and index.witness(7, 8) is None
    assert index.definition_of("nowhere::lookup") == 4 and index.definition_of("absent") is None
    assert '"text": "use' in execute_tool(index, "read_span", {"path": "cache.rs", "start": 42, "end": 60}) or '"ok": true' in execute_tool(index, "read_span", {"path": "cache.rs", "start": 0, "end": 5})
    assert '"line": 13' in execute_tool(index, "grep", {"pattern": "pub mod service"}) and '"ok": false' in execute_tool(index, "other", {})
    cold, warm = Index.cached(spark, FIXTURE, str(tmp_path)), Index.cached(spark, FIXTURE, str(tmp_path))
    assert (cold[1], warm[1]) == (False, True) and warm[0].counts() == (1, 9, 5)


def test_ignore_rules():
    rules = [*parse_ignore("/r", "# c\ntarget/\n*.gen.rs\n"), *parse_ignore("/r/a", "!keep.gen.rs\n")]
    assert ignored("/r/target/x.rs", rules) and ignored("/r/a/b.gen.rs", rules) and not ignored("/r/a/keep.gen.rs", rules) and not ignored("/r/src/x.rs", rules)


def test_ignore_globs():
    rules = parse_ignore("/r", "/top.rs\na/*/c.rs\n**/deep/x.rs\nb/**\n[ab]1.rs\nq?.rs\n!b/keep/\n")
    for path, expected in [("top.rs", True), ("a/top.rs", False), ("a/b/c.rs", True), ("a/b/b/c.rs", False), ("z/deep/x.rs", True), ("deep/x.rs", True), ("b/y.rs", True), ("z/a1.rs", True), ("c1.rs", False), ("qq.rs", True), ("q/.rs", False)]:
        assert ignored(f"/r/{path}", rules) == expected, path


def test_ignore_files_above_and_exclude(spark, tmp_path):
    (tmp_path / "repo/.git/info").mkdir(parents=True)
    (tmp_path / "repo/in/src").mkdir(parents=True)
    (tmp_path / "repo/.git/info/exclude").write_text("excluded.rs\n")
    (tmp_path / "repo/.gitignore").write_text("in/src/above.rs\n")
    (tmp_path / "repo/in/.gitignore").write_text("own.rs\n")
    for name in ("excluded", "above", "own", "stays", "above2"):
        (tmp_path / f"repo/in/src/{name}.rs").write_text("fn f() {}\n")
    got = source_files(spark, str(tmp_path / "repo/in")).select("file_id", "rel_path").collect()
    assert sorted(map(tuple, got)) == [(0, "src/above2.rs"), (1, "src/stays.rs")]


def test_line_table(spark):
    text = "fn a() {\n    let x = 1; // c\n    b();\n}\n"
    df = spark.createDataFrame([(0, text)], "file_id int, text string").withColumn("t", spans.line_starts(F.col("text")))
    at = [(1, 0), (1, 7), (2, 0), (99, 1)]
    row = df.select("t", *[spans.to_byte(F.col("t"), F.lit(a), F.lit(b)).alias(f"c{k}") for k, (a, b) in enumerate(at)]).first()
    assert list(row.t) == [0, 9, 29, 38, 40, 40] and tuple(row)[1:] == (0, 7, 9, None)
    one = spark.createDataFrame([("é\r\nxy", [0, 4, 6])], "t string, s array<bigint>")
    assert tuple(one.select(spans.byte_offset(F.col("t"), F.col("s"), F.lit(1), F.lit(9)), spans.byte_offset(F.col("t"), F.col("s"), F.lit(9), F.lit(1))).first()) == (2, 5)


def test_read_span(spark):
    df = spark.createDataFrame([(bytearray("aéb".encode()),)], "c binary")
    got = df.select(*[spans.read_span(F.col("c"), F.lit(a), F.lit(b)).alias(f"x{k}") for k, (a, b) in enumerate([(0, 1), (0, 99), (2, 4), (3, 3), (3, 2), (9, 12)])]).first()
    assert tuple(got) == ("a", "aéb", "", "", "", "")


def test_command_line(spark, capsys):
    assert cli.main(["-p", FIXTURE, "index", "--dump-entry-points", "--dump-graph"]) == 0
    out = capsys.readouterr().out
    assert "1 files, 9 symbols, 5 edges" in out and "handlers::cache::main → handlers::cache::cache_get" in out
    assert cli.main(["-p", FIXTURE, "graph", "absent"]) == 3
    assert cli.main(["-p", FIXTURE, "scan", "--format", "sarif", "--fail-on", "high"]) == 0
    assert '"version":"2.1.0"' in capsys.readouterr().out
