"""The whole pipeline against brute force at the smallest scale."""

import sys
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from test_native import brute_pairs  # noqa: E402
from test_packing import verify  # noqa: E402
from test_pairs import brute_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from graphloom.llm import packing, quality, secrets  # noqa: E402


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.op4_quality_rules(spark, sf).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    component = brute_components(rows, 5)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i, *_ in brute_pairs(rows, items)}
    assert 0 < len(bad) < len(rows)
    rows = [(i, t) for i, t in rows if str(i) not in bad]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    least = secrets.thresholds(secrets.find(left))
    tokenizer, expected = Tokenizer.from_file(packing.default_tokenizer()), {}
    for i, t in rows:
        base, more = secrets.scan(t or "")
        t = secrets.redact_text(t or "", [(s, e) for s, _, e in base] + [(s, e) for s, e, cls, b in more if b >= least.get(cls, secrets.BINS)])
        expected[i] = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    verify(corpus_pipeline.run(spark, sf).collect(), expected)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"] and corpus_pipeline.ORACLE_SQL is None
