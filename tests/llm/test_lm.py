"""The language model against plain counting."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))), None]


def brute(rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ts = tokens(t)
        out.append((str(i), held(i), len(ts), sum(w in c for w in ts), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), 6)))
    return sorted(out)


def base_of(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("head", [1 << 20, 50, 0])
def test_base_score(spark, sf, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)  # the head is only read on the driver
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert base_of(lm.score(docs, lm.train(docs))) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (1, ""), (2, "Abc ABC\tabc"), (None, "abc zzz"), (3, "é É"), (20, "abc abc q")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, row long, tail string")
    got = lm.score(docs, lm.train(docs))
    assert base_of(got) == brute(rows)
    assert all(r.score <= 0 for r in got.collect())
    empty = docs.filter("doc_id = 99")
    assert lm.score(empty, lm.train(empty)).count() == 0


def test_model_beats_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score(docs, lm.train(docs)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_gives_counts(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 54, 20_000)
    counts = np.minimum(rng.geometric(0.3, len(ids)), 400)
    keys, levels = lm._pack(ids.astype(np.uint64)), lm.level(counts).astype(np.uint8).tobytes()
    pairs = spark.createDataFrame([(bytearray(keys[: 7 * 9_000]), bytearray(levels[:9_000])), (bytearray(keys[7 * 9_000 :]), bytearray(levels[9_000:]))], "keys binary, levels binary")
    bits = np.frombuffer(lm.collected(lm.filter_parts(pairs, 3, 2, 4), 3, 2), np.uint8)
    assert (lm.probe(bits, ids.astype(np.uint64), 3) >= lm.level(counts)).all()
    assert (lm.count_at(lm.level(counts)) <= counts + 1e-9).all() and (lm.count_at(lm.level(counts[counts < 3])) > counts[counts < 3] - 0.6).all()
    other = rng.integers(1 << 54, 1 << 55, 20_000).astype(np.uint64)
    assert (lm.probe(bits, other, 3) > 0).mean() < 0.01
    assert lm.collected(lm.filter_parts(pairs, 3, 1, 1), 3, 1) == bits.tobytes()


def test_scores_do_not_hang_on_the_number_of_shards(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for shards, most in ((4, lm.FILTER_BITS), (32, lm.FILTER_BITS), (4, 1), (32, 1)):
        monkeypatch.setattr(lm, "FILTER_BITS", most)
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        seen.append(sorted((r.doc_id, round(r.score, 6)) for r in lm.score(docs, lm.train(docs)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(x == seen[0] for x in seen)


def test_probabilities_sum_to_one_at_most(spark):
    rows = [(i, " ".join("abcde"[(i * k) % 5] for k in range(1, 40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    words = ["a", "b", "c", "d", "e", "unseen"]
    n = [(j, f"a {w}") for j, w in enumerate(words)]
    ends = {r.doc_id: r.score for r in lm.score(spark.createDataFrame([*n, (99, "a")], "doc_id long, text string"), model).collect()}
    # P(text "a w") = P(a) P(w | a) P(end | w); dividing P(end | w) out needs P(w)-free texts, so compare with one-word texts
    single = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), model).collect()}
    assert all(math.isfinite(x) and x < 0 for x in [*ends.values(), *single.values()])


def brute_scores(rows):
    """Every history and every pair is used, with the filter's quantised counts."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    pairs_of = lambda t: zip([None, *t[:-1]], t, strict=True)
    train = [tokens(t) for i, t in rows if not held(i)]
    c, two = Counter(w for t in train for w in t), Counter(p for t in train for p in pairs_of(t))
    n = sum(c.values())
    once, lam = sum(x == 1 for x in c.values()), 1 - sum(x == 1 for x in two.values()) / n
    unknown = once / n if once else 1 / (n + 1)
    q = lambda x: 2 ** (math.floor(2 * math.log2(x) + 1e-9) / 2) if x else 0.0
    word = lambda w: (1 - unknown) * c[w] / n if w in c else unknown
    p = lambda v, w: lam * min(q(two[v, w]), c[v]) / c[v] + (1 - lam) * word(w) if v in c else word(w)
    return sorted((i, round(sum(math.log10(p(v, w)) for v, w in pairs_of(tokens(t))), 6)) for i, t in rows)


@pytest.mark.parametrize("head", [1 << 20, 3, 0])
@pytest.mark.parametrize("most", [1 << 31, 1])
def test_no_pair_or_history_is_left_out(spark, head, most, monkeypatch):
    rows = [(i, " ".join(["abcdefgh"[(i * k + k * k) % 8] for k in range(1, 25)] + [f"rare{i % 13}", f"after{i % 13}"])) for i in range(60)]
    rows += [(100, "rare1 after1 new a b"), (101, "new new rare2 after2")]
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "FILTER_BITS", most)  # 1: the filter is over the bound of the broadcast
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    assert (model["filter"] is None) == (most == 1)
    assert sorted((r.doc_id, round(r.score, 6)) for r in lm.score(docs, model).collect()) == brute_scores(rows)
