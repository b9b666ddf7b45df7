"""Quality ledger and decontamination against brute force, with their edge cases."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, neardup, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n\x0b\x0c\r", "a", "one two three four five six seven eight nine ten", "x y z w v " * 9, "# * $ % & | < > " * 4, "A\nA\n\nA\r\nB\n \nB", "LOUD WORDS ONLY HERE AND NO OTHER ONES AT ALL",
         "p q r s t u p q r s t v p q r s", "é" * 30 + " " + "ß ü " * 8, "a b c d e a b c d e a b c d e", "\x1c\x85\xa0 still one word here " * 3]


def brute(t):
    w = WORD.findall(t or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_ledger(spark):
    rows = [(i if i else None, t, "x", -1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[4], "x", -1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    out = quality.apply_policy(quality.ledger(df)).withColumn("base_failed", F.col("ledger.fail_bits").bitwiseAND(F.lit(quality.mask(("base", 1))).cast("long")) != 0)
    got = sorted((r.text or "", *[r.ledger[m] for m in quality.MEASURES[:5]], r.base_failed) for r in out.collect())
    assert got == sorted((t or "", *brute(t)) for _, t, _, _ in rows)
    assert all(not r.kept for r in out.filter("base_failed").collect())


def test_ledger_driver_table(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in quality.op4_quality_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[r.doc_id])


def test_ablations(spark):
    df = quality.ledger(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    bits = [r.ledger["fail_bits"] for r in df.collect()]
    for policy in quality.POLICIES:
        whole = quality.mask(policy)
        got = {r.rule: (r.n_rows, r.n_kept, r.n_failed, r.n_only) for r in quality.ablations(df, policy).collect()}
        assert got == {rule: (len(bits), sum(b & whole == 0 for b in bits), sum(bool(b & bit) for b in bits), sum(b & whole == bit for b in bits)) for rule, bit in ((r, quality.BITS[r]) for r in quality.POLICIES[policy])}


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.93
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)


def test_stage_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.filter_stage(spark, docs, sf)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert quality.filter_stage(spark, docs.limit(0), sf).count() == 0


def sets(t):
    w = [x for x in WORD.findall((t or "").lower())]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def brute_pairs(docs, items):
    d, q = {}, {}
    for out, rows in ((d, docs), (q, items)):
        for i, t in rows:
            out.setdefault(i, set()).update(sets(t))
    return sorted((str(i), str(j), len(a & b), len(b)) for i, a in d.items() for j, b in q.items() if b and 5 * len(a & b) >= 4 * len(b))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "small", lambda df: F.broadcast(df) if limit else df)
    item = [f"w{i}" for i in range(200)]
    items = [(1, " ".join(item[:30])), (2, " ".join(item[40:60])), (3, "tiny item"), (4, None), (5, ""), (None, " ".join(item[70:180])), (7, " ".join(item[:30]).upper()), (7, "more words for item seven to hold"), (8, "a b c d e")]
    filler = [f"f{i}" for i in range(3000)]
    docs = [(10, " ".join(filler[:1500] + item[:30] + filler[1500:])), (11, " ".join(item[:27])), (12, " ".join(item[:20])), (13, "Tiny ITEM"), (14, None), (15, ""), (None, " ".join(item[60:190])), (16, " ".join(item[:15] + ["x"] + item[16:30])),
            (17, " ".join(item[:10])), (17, " ".join(item[6:30])), (18, "z a b c d e"), (19, " ".join(item[i] for i in range(40, 60)) + " \n" + " ".join(filler[:40]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(i, t, "h") for i, t in items], "item_id long, text string, h string")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_item_shingles) for r in decontaminate.contained(df, q).collect())
    assert got == brute_pairs(docs, items) and len(got) > 5
    assert decontaminate.contained(df.limit(0), q).count() == 0 and decontaminate.contained(df, q.limit(0)).count() == 0


def test_sketch_misses_nothing(spark):
    """Any 80 % of an item's shingles hold as many of its sketch as a candidate needs."""
    items = spark.createDataFrame([(n, " ".join(f"w{n}_{i}" for i in range(n + 4))) for n in (1, 4, 5, 9, 16, 31, 32, 100, 500)], "item_id long, text string")
    sketch, sizes = decontaminate.sketches(items)
    n = {r.item_id: r.n for r in sizes.collect()}
    count = {r.item_id: (r.k, r.need) for r in sketch.groupBy("item_id").agg(F.count("*").alias("k"), F.max("need").alias("need")).collect()}
    for i, size in n.items():
        k, need = count[i]
        assert size == i and 1 <= need <= k - size // 5 or k == size


def test_stages_take_any_columns(spark, sf):
    """Names that the stages use themselves, nulls, empty and long texts, repeated rows, an empty table."""
    rows = [(1, None, "x"), (None, "a plain text of enough words to be kept by the rules that there are here, once or twice", "y"), (2, "", "z"), (3, "word " * 40_000, "w")] + [(4, " ".join(f"word{k}" for k in range(60)) + ".", "v")] * 2
    names = ["__ledger", "__kept", "ledger", "kept", "__q_text", "__id", "bad_id", "bands", "n", "row", "h", "leader"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *[f"concat(source, '{c}') AS `{c}`" for c in names])
    for df in (docs, docs.limit(0)):
        for stage in (quality.filter_stage, decontaminate.decontaminate_stage, neardup.near_dedup_stage, secrets.redact_stage):
            out = stage(spark, df, sf)
            assert out.columns == docs.columns
            for r in out.collect():
                assert all(r[c] == r.source + c for c in names)
    kept = [r.doc_id for r in decontaminate.decontaminate_stage(spark, docs, sf).collect()]
    assert sorted(map(str, kept)) == ["1", "2", "3", "4", "4", "None"]
