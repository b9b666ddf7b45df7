"""Near duplicates and repeated spans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from graphloom.llm import neardup, substrings
from graphloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture_texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéü|") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts: list[str | None] = [None, "", "  \n", "one", "One", "one two", "ONE two", "a a a a a a"]
    passage = say(60)
    for k in range(6):
        texts.append(" ".join([*say(20 + k), *passage, *say(15)]))
    for _ in range(4):  # families with a range of similarities, so that chains of links occur
        base = say(120)
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(say(100))] * 3 + ["loop " * 90, "loop " * 50, " ".join(say(3000)), " ".join([*say(40), *passage[:34], *say(3)]), " ".join([*passage[5:41], "x"])]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, bands string, n long")


def shingles(t, size):
    w = [x.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute_components(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = fixture_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), size=size).collect()}
    assert got == brute_components(rows, size)


def test_near_duplicates_driver_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = neardup.op6_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_bucket_needs_rounds(spark):
    """One bucket, two families and a document between them: all pairs of different components are compared or ruled out."""
    rng = random.Random(3)
    common = [f"w{i}" for i in range(100)]
    rows = []
    for f in range(3):
        base = common[:70] + [f"f{f}_{i}" for i in range(30)]
        for k in range(5):
            rows.append((f * 10 + k, " ".join(base[:95] + [f"v{f}{k}{i}" for i in range(k)])))
    rng.shuffle(rows)
    df = frame(spark, rows)
    one = neardup.sketched(df, "doc_id", "text", 2).selectExpr("doc_id AS id", "n", "array(1L) AS bands")
    pool = lambda ids: df.selectExpr("doc_id AS id", "cast(text AS binary) AS text").join(ids, "id", "left_semi")
    expected = {i: c for i, (_, c) in brute_components(rows, 2).items()}
    # one group of the whole cell, its bucket as a group, the bucket split in blocks
    for most in (neardup.MOST_WEIGHT, 15 * 1150, 5000, 1):
        found = components(neardup.links(pool, one, 2, most=most), "leader", "node")
        assert {i: i for i, _ in rows} | {r.node: r.component for r in found.collect()} == expected


def test_near_duplicates_in_split_cells(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.components.ONE_TASK", 0)
    monkeypatch.setattr(neardup.links, "__defaults__", (*neardup.links.__defaults__[:-1], 9000))
    rows = fixture_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 2)


def test_near_duplicates_edges(spark):
    empty = frame(spark, [])
    assert neardup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c"), (5, "q r s")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("5", "5", True), ("9", "4", False), ("None", "None", True), ("None", "None", True)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        s = neardup.sketch(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)))
        assert (s != neardup._FREE).all()
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    agree = np.mean([np.mean(neardup.sketch(np.unique(neardup.mix(x[:2000] + np.uint64(k)))) == neardup.sketch(np.unique(neardup.mix(x[500:2500] + np.uint64(k))))) for k in range(20)])
    assert abs(agree - 0.6) < 0.04


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr("graphloom.llm.components.ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100} or got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def brute_spans(rows, k=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen: dict = {}
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append((d, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + k))
    return sorted((str(i), len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest()) for (i, _), w, g in zip(rows, words, gone, strict=True))


def spans_of(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_repeated_spans(spark):
    rows = [*fixture_texts(), (None, "z " * 40), (3, "other words " * 30)]
    assert spans_of(substrings.remove(frame(spark, rows))) == brute_spans(rows)


def test_repeated_spans_driver_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = spans_of(substrings.op9_substring_dedup(spark, sf))
    assert got == brute_spans(rows)
    assert sum(r[2] for r in got) > 0


def test_repeated_spans_empty(spark):
    assert substrings.remove(frame(spark, [])).count() == 0
