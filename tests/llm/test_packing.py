"""Packing: an exact round trip against the tokenizer, and little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing


def reference(text):
    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def verify(rows, docs, window=2048, end=1):
    """docs: {id: ids with the end id}.  Every id once, offsets gapless, little padding."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == docs.keys()
    for i, ids in docs.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0


def test_round_trip(spark):
    texts = {1: "Hello, world! It's 42 ünïcode ÄÖß's", 2: None, 3: "", 4: " \t\n", 5: "word " * 5000, 6: "<|endoftext|> x<|startoftext|>y", 7: "İstanbul ΣΑΣ é  x y 漢字 ½²µ ÷×", 8: "don't WE'LL 'S'll", 9: "\x1c\x85\x01a"}
    df = spark.createDataFrame([(k, v, 0, 0) for k, v in texts.items()], "doc_id long, text string, start long, offset long")
    verify(packing.pack_documents(df).collect(), {k: [*reference(v), 1] for k, v in texts.items()})


def test_driver_table(spark, sf):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verify(packing.op7_packing(spark, sf).collect(), docs)


def test_words_equal_the_tokenizer(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    words = sorted({w for r in rows for w in (r.text or "").encode().split()})
    own, tokenizer = packing.WordEncoder(packing.default_tokenizer(), 1000), Tokenizer.from_file(packing.default_tokenizer())
    for at in range(0, len(words), 2000):
        part = words[at : at + 2000]
        theirs = tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        assert own.encode(part) == [np.array(x.ids, "<u4").tobytes() for x in theirs]


def test_same_twice_and_edges(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert sorted(map(tuple, packing.pack_documents(df).collect()), key=str) == sorted(map(tuple, packing.pack_documents(df).collect()), key=str)
    assert packing.pack_documents(df).count() >= 3
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(10)
    rng = random.Random(2)
    counts = [0] * 11
    for _ in range(500):
        size = rng.randint(1, 9)
        cost = {}
        for level in range(11 - size):
            if level == 0 or counts[level]:
                after = counts.copy()
                if level:
                    after[level] -= 1
                if level + size < 10:
                    after[level + size] += 1
                cost[level] = sum(c * c for c in after)
        packer.add((0, 0, size), size)
        now = packer.counts.tolist()
        assert sum(c * c for c in now) == min(cost.values())
        counts = now


@pytest.mark.parametrize("window", [8, 64])
def test_pack_is_exact(window):
    rng = random.Random(window)
    items = [(k, rng.randint(1, 3 * window)) for k in range(300)]
    out = list(packing.pack(iter([(k, n) for k, n in items]), window))
    got, fill = defaultdict(list), defaultdict(int)
    for key, start, length, sequence, offset in out:
        got[key].append((start, length))
        fill[sequence] += length
    for k, n in items:
        at = 0
        for start, length in sorted(got[k]):
            assert start == at
            at += length
        assert at == n
    assert all(f == window or f & (f - 1) == 0 for f in fill.values())
