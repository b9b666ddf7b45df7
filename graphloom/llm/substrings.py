"""Repeated token spans by compaction of a de Bruijn graph.

The graph's edges are the windows (token k-mers) of ``WINDOW`` words.  Each edge is keyed by its minimizer, the leftmost
smallest hash among its ``MINIMIZER``-word grams, so equal windows have equal keys.  Neighbouring edges of a document that
share one minimizer occurrence are compacted to a path at once, while the text is read; a path's source coordinates are
(document, first window, number of windows).

1. A key that occurs once over the whole corpus has no repeated edge: its paths end here (an aggregation and a join).
2. Paths that are equal as a whole (same key, same words) are compacted to one with its number of sources.  With two or
   more sources all its edges are repeated.
3. Where a key has paths that differ, the graph branches: one source of each distinct path is expanded to its edges, read
   from the text at its coordinates, and edges found in two or more distinct paths are repeated.

So work follows the minimizers (about 2 / 29 of the words), and edges are only made one by one where paths branch.
Equality is by two 64-bit hashes, of the key and of the words of the path or edge, from different mixes.

Rows are told apart by id and a hash of the text, so equal ids with different texts are different documents, and equal
rows repeat each other.  Null and empty texts have no words.  A null id is an id.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hashed_docs, mix, stash, table, unstash, window_hash

WINDOW, MINIMIZER = 35, 8
_SALT = np.uint64(0x5851F42D4C957F2D)
_BATCH = 200_000


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each full window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    val, pos, span = values, np.arange(len(values), dtype=np.int64), 1
    while span < width:
        shift = min(span, width - span)
        left = val[:-shift] <= val[shift:]
        val, pos = np.where(left, val[:-shift], val[shift:]), np.where(left, pos[:-shift], pos[shift:])
        span += shift
    return pos


def paths(texts: list[bytes], window: int = WINDOW, k: int = MINIMIZER) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, key, hash of the path) of each path, as arrays."""
    h, offset = hashed_docs(texts)
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = np.arange(len(h) - k + 1)
    grams = window_hash(h, at, at + k)
    anchor = _sliding_argmin(grams, window - k + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(offset))
    whole = doc[:n] == doc[window - 1 :]
    starts = np.ones(n, bool)
    starts[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1])
    run = np.cumsum(starts) - 1
    counts = np.bincount(run, weights=whole).astype(np.int64)  # windows that cross a text's end close its last run
    first = np.flatnonzero(starts)
    keep = whole[first] & (counts > 0)
    first, counts = first[keep], counts[keep]
    body = window_hash(mix(h ^ _SALT), first, first + counts + window - 1, 1)
    return doc[first], first - offset[doc[first]], counts, grams[anchor[first]], mix(body + (anchor[first] - first).astype(np.uint64) * _SALT)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(t).alias("tc"), t.cast("binary").alias("text"))


_PATHS = "doc_id long, tc int, p int, n int, h long, s long"


def path_table(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                doc, p, n, h, s = paths(texts[a:b], window)
                row = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(p, pa.int32()), pa.array(n, pa.int32()), _signed(h), _signed(s)], names=["doc_id", "tc", "p", "n", "h", "s"])

    return keyed.mapInArrow(run, _PATHS)


_EDGES = "doc_id long, tc int, p int, c long, h long, e long"


def _expand(with_paths: DataFrame, window: int) -> DataFrame:
    """Edges of the listed paths: ``with_paths`` has doc_id, tc, text and list (p, n, c, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tcs, texts, lists = (c.to_pylist() for c in batch.columns)
            for a, b in blocks(texts):
                h, offset = hashed_docs(texts[a:b])
                values = mix(h ^ _SALT)
                flat = [(i, x["p"], x["n"], x["c"], x["h"]) for i in range(a, b) for x in lists[i]]
                row, p, n, c, key = (np.array(x, np.int64) for x in zip(*flat, strict=True))
                one = np.repeat(np.arange(len(flat)), n)
                p = p[one] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                start = offset[row[one] - a] + p
                edges = window_hash(values, start, start + window, 1)
                for x in range(0, len(one), _BATCH):
                    cut = slice(x, x + _BATCH)
                    r = row[one[cut]]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r], pa.int64()), pa.array([tcs[i] for i in r], pa.int32()), pa.array(p[cut], pa.int32()), pa.array(c[one[cut]]), pa.array(key[one[cut]]), _signed(edges[cut])], names=["doc_id", "tc", "p", "c", "h", "e"])

    return with_paths.mapInArrow(run, _EDGES)


def _same(a: str, b: str):
    return F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.tc = {b}.tc")


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tc, p, n): n consecutive windows from word p, each of which starts elsewhere too."""
    keyed = _keyed(docs, id_col, text)
    everything = stash(path_table(keyed, window), "paths")
    keys = everything.groupBy("h").agg(F.count("*").alias("k"), F.min("s").alias("low"), F.max("s").alias("high")).filter("k > 1").select("h", (F.col("low") != F.col("high")).alias("branches"))
    some = stash(everything.join(keys, "h"), "repeated-keys")
    unstash(everything)
    compact = stash(some.groupBy("h", "s", "branches").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "tc", "p", "n")).alias("source")), "compact")
    whole = some.join(compact.filter("c > 1").select("h", "s"), ["h", "s"]).select("doc_id", "tc", "p", "n")
    listed = compact.filter("branches").select("source.*", "c", "h").groupBy("doc_id", "tc").agg(F.collect_list(F.struct("p", "n", "c", "h")).alias("list"))
    read = keyed.alias("d").join(listed.hint("shuffle_hash").alias("l"), _same("d", "l")).select("d.doc_id", "d.tc", "text", "list")
    # a source that is there twice (equal rows) has c > 1, so its edges are repeated however often they are counted
    edges = stash(_expand(read, window), "edges")
    twice = edges.groupBy("h", "e").agg(F.count("*").alias("k")).filter("k > 1").select("h", "e")
    single = edges.filter("c = 1").join(twice, ["h", "e"]).select("doc_id", "tc", "p", F.lit(1).alias("n"))
    return whole.unionByName(single)


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; ``kept``: the words that stay, joined by one space."""
    marks = repeated(docs, id_col, text, window).groupBy("doc_id", "tc").agg(F.collect_list(F.struct("p", "n")).alias("marks"))  # at most a row's own windows
    joined = _keyed(docs, id_col, text).alias("d").join(marks.hint("shuffle_hash").alias("m"), _same("d", "m"), "left").select("d.doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                kept = words
                if marks:
                    cover = np.zeros(len(words) + 1, np.int64)
                    p = np.array([m["p"] for m in marks])
                    np.add.at(cover, p, 1)
                    np.add.at(cover, p + np.array([m["n"] for m in marks]) + window - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                out = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest(), out.decode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL: dict[str, str] = {}
