"""Bigram language model in a log-frequency Bloom filter.

*Counts.*  Tasks count the hashes of tokens and of token pairs in blocks; sorted runs of (hash, count) go to shards, which
add them up.  Unigrams are told apart by 64 bits, bigrams by 56.  The number of shards follows
``spark.sql.shuffle.partitions`` and changes no result.

*Filter.*  A bigram of count c is quantised to level q(c) = floor(2 log2 c), 1 at least, and (bigram, 1) ... (bigram, q) are
put into a Bloom filter of ``BITS_EACH`` bits a member at every size of the corpus, cut into segments of ``_SEGMENT`` bits.
Up to ``FILTER_BITS`` it is broadcast, and workers map the broadcast's file, so that an executor holds it once.  A larger
filter stays in groups of segments, none above ``_PART`` bits, and the ids of a block of texts go to the groups and their
levels come back.  The bits are the same either way.  Probing (bigram, 1),
(bigram, 2), ... until the first miss gives the level, and with it at most the count, but for false positives.

*Probability.*  P(w | v) = L f(v, w) / c(v) + (1 - L) P(w), where f is the count that the filter gives, L = 1 - (bigrams seen
once) / (bigram tokens) is the Good-Turing mass of bigrams seen before, and P(w) = (1 - U) c(w) / N for known words and U, the share of
tokens seen once, for the class of all unknown ones; f / c(v) sums to 1 at most, so P to 1 at most but for false positives.
A history that no training row has gets no bigram term.

*Exact unigrams at any size.*  Words with the largest counts, at most ``HEAD`` of them, are broadcast; all other tokens and
histories of a text are joined with the full counts.

Texts without words are the end token alone, null as empty.  A null id is held out.  Rows are scored each, repeated ids
and rows too; every training row counts.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hashed_docs, mix, stash, table

HEAD, FILTER_BITS, BITS_EACH, PROBES = 1 << 20, 1 << 31, 12, 3
_PART = 1 << 27  # bits of a group of segments at most
_SEGMENT = 1 << 21
_FLUSH = 1 << 21
_PACKED = 1 << 20  # bytes of text in a row that goes through a join
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_LEVELS = mix(np.arange(1, 130, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text ended by END, and the offsets of the texts (one more than texts)."""
    h, offset = hashed_docs([t.lower() for t in texts])
    out = np.insert(h, offset[1:], END)
    return out, offset + np.arange(len(offset))


def pair_ids(h: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """56-bit id of (token before, token) for each token; before a text's first token stands END."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[offset[:-1]] = END
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(h)) >> np.uint64(8)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def level(counts: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.floor(2 * np.log2(counts) + 1e-9).astype(np.int64))


def count_at(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(levels > 1, 2.0 ** (levels / 2), levels)


def _bits(ids: np.ndarray, j: int) -> list[np.ndarray]:
    """Positions of member (id, level j) in its segment."""
    x = mix(ids ^ _LEVELS[j])
    return [((x >> np.uint64(21 * p)) & np.uint64(_SEGMENT - 1)).astype(np.int64) for p in range(PROBES)]


def segment_of(ids: np.ndarray, segments: int) -> np.ndarray:
    return (mix(ids) % np.uint64(segments)).astype(np.int64)


def probe(filter_bits: np.ndarray, ids: np.ndarray, segments: int, groups: int = 1) -> np.ndarray:
    """Level of each id: probes go on until the first miss.  ``filter_bits``: every ``groups``-th segment, with those of the ids."""
    out = np.zeros(len(ids), np.int64)
    alive = np.arange(len(ids))
    for j in range(1, len(_LEVELS)):
        if not len(alive):
            break
        some = ids[alive]
        base = segment_of(some, segments) // groups * _SEGMENT
        hit = np.ones(len(some), bool)
        for pos in _bits(some, j):
            at = base + pos
            hit &= (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        alive = alive[hit]
        out[alive] = j
    return out


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel().astype(np.uint64)


_RUNS = "shard int, kind int, keys binary, counts binary"
_COUNTS = "kind int, h long, c long, keys binary, levels binary"


def ngram_counts(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """kind 0: (hash, count) of every token; kind 1: many pairs in a row, with the sum of their levels as h and the number of those seen once as c."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: list[np.ndarray] = []
        bi: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in ((0, uni), (1, bi)):
                keys, counts = add_up(np.concatenate(parts), np.ones(sum(map(len, parts)), np.uint32))
                counts = counts.astype(np.uint32)
                parts.clear()
                shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                keys, counts = keys[order], counts[order]
                ends = np.cumsum(np.bincount(shard, minlength=shards))
                rows = [(s, kind, keys[a:b].tobytes() if kind == 0 else _pack(keys[a:b]), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "kind", "keys", "counts"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                h, offset = tokens(texts[a:b])
                uni.append(h)
                bi.append(pair_ids(h, offset))
                if sum(map(len, uni)) >= _FLUSH:
                    yield from flush()
        if uni:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, size = None, [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            k, c = add_up(np.concatenate(keys), np.concatenate(counts))
            kind = at[1]
            for x in range(0, len(k), 100_000):
                key, count = k[x : x + 100_000], c[x : x + 100_000]
                if kind == 0:
                    none = pa.nulls(len(key), pa.binary())
                    row = [pa.array(np.zeros(len(key), np.int32)), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64)), none, none]
                else:
                    q = level(count)
                    row = [pa.array([1], pa.int32()), pa.array([int(q.sum())], pa.int64()), pa.array([int((count == 1).sum())], pa.int64()), pa.array([_pack(key)], pa.binary()), pa.array([q.astype(np.uint8).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["kind", "h", "c", "keys", "levels"])

        for batch in batches:
            for shard, kind, key, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at != (shard, kind):
                    yield from give()
                    keys, counts, size = [], [], 0
                at = shard, kind
                keys.append(np.frombuffer(key, np.uint64) if kind == 0 else _unpack(key))
                counts.append(np.frombuffer(count, np.uint32).astype(np.uint64))
                size += len(keys[-1])
                if size > _FLUSH:
                    k, c = add_up(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [c], 0
        if at is not None:
            yield from give()

    source = docs.filter(~held_out(F.col(id_col))).select(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return source.mapInArrow(local, _RUNS).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(merge, _COUNTS)


_ASKED = "g int, kind int, block long, data binary, levels binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "kind", "block", "data", "levels"])


def filter_parts(pairs: DataFrame, segments: int, groups: int, tasks: int) -> DataFrame:
    """The filter over ``pairs`` (keys, levels) as one row of kind 0 for each group g: the segments s with s mod ``groups`` = g."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q = _unpack(keys), np.frombuffer(levels, np.uint8)
                g = segment_of(ids, segments) % groups
                order = np.argsort(g, kind="stable")
                ids, q, g = ids[order], q[order], g[order]
                starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                yield _rows([(int(g[a]), 0, 0, _pack(ids[a:b]), q[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(g)], strict=True)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = -1, np.zeros(0, np.uint8)
        for batch in batches:
            for g, _, _, keys, levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at:
                    if at >= 0:
                        yield _rows([(at, 0, 0, bits.tobytes(), None)])
                    at, bits = g, np.zeros(-(-(segments - g) // groups) * _SEGMENT // 8, np.uint8)
                ids, q = _unpack(keys), np.frombuffer(levels, np.uint8)
                for j in range(1, int(q.max()) + 1):
                    some = ids[q >= j]
                    base = segment_of(some, segments) // groups * _SEGMENT
                    for pos in _bits(some, j):
                        spot = base + pos
                        np.bitwise_or.at(bits, spot >> 3, np.left_shift(1, spot & 7).astype(np.uint8))
        if at >= 0:
            yield _rows([(at, 0, 0, bits.tobytes(), None)])

    return pairs.select("keys", "levels").mapInArrow(cut, _ASKED).repartition(min(tasks, groups), "g").sortWithinPartitions("g").mapInArrow(fill, _ASKED)


def collected(parts: DataFrame, segments: int, groups: int) -> bytearray:
    """The whole filter from its parts, ``FILTER_BITS`` at most; one partition of it at a time is on its way to the driver."""
    out = bytearray(segments * _SEGMENT // 8)
    rows = np.frombuffer(out, np.uint8).reshape(segments, -1)
    for r in parts.select("g", "data").toLocalIterator():
        rows[r["g"] :: groups] = np.frombuffer(r["data"], np.uint8).reshape(-1, _SEGMENT // 8)
    return out


def _by_group(ids: np.ndarray, segments: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids by group, their groups, and the place of each id among them."""
    distinct, inverse = np.unique(ids, return_inverse=True)
    g = segment_of(distinct, segments) % groups
    order = np.argsort(g, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], g[order], place[inverse]


def block_levels(texts: DataFrame, parts: DataFrame, segments: int, groups: int, tasks: int) -> DataFrame:
    """(block, levels): for each row of (block, texts) the levels of its distinct ids, as parts (g, data) of the groups."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, g, _ = _by_group(pair_ids(*tokens(own.as_py())), segments, groups)
                starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                yield _rows([(int(g[a]), 1, block, _pack(ids[a:b]), None) for a, b in zip(starts, [*starts[1:], len(g)], strict=True)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = -1, None
        for batch in batches:
            blocks_, gs, out = [], [], []
            for g, kind, block, data in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if kind == 0:
                    at, bits = g, np.frombuffer(data, np.uint8)
                    continue
                ids = _unpack(data)
                blocks_.append(block)
                gs.append(g)
                out.append((probe(bits, ids, segments, groups) if at == g else np.zeros(len(ids))).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array(gs, pa.int32()), pa.array(out, pa.binary())], names=["block", "g", "data"])

    asked = texts.mapInArrow(ask, _ASKED).unionByName(parts)
    answers = asked.repartition(tasks, "g").sortWithinPartitions("g", "kind").mapInArrow(answer, "block long, g int, data binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("g", "data")).alias("levels"))


def _least_for(by_value: list[tuple[int, int]], most: int) -> int:
    """by_value: (value, load) with values from high to low; the least value whose loads down to it stay within ``most``."""
    total, least = 0, 1 << 62
    for value, load in by_value:
        total += load
        if total > most:
            break
        least = value
    return least


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> dict:
    """The model: figures, head words, filter, and ``counts``, a table of all token counts."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = stash(ngram_counts(docs, shards, id_col, text), "ngrams")
    uni, pairs = counts.filter("kind = 0").select("h", "c"), counts.filter("kind = 1").select("h", "c", "keys", "levels")
    n, v, once = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    members, lone = pairs.agg(F.coalesce(F.sum("h"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    q = F.floor(2 * F.log2("c") + 1e-9)  # counts are binned by level, so this table has at most 128 rows
    words = [(r["q"], r["k"]) for r in uni.groupBy(q.alias("q")).agg(F.count("*").alias("k")).orderBy(F.desc("q")).collect()]
    as_count = lambda q: int(np.ceil(2 ** (min(q, 120) / 2) - 1e-6))
    least_word = as_count(_least_for(words, HEAD))
    segments = max(1, -(-members * BITS_EACH // _SEGMENT))
    shared = segments * _SEGMENT <= FILTER_BITS
    groups = min(segments, max(shards, -(-segments * _SEGMENT // _PART)))
    parts = filter_parts(pairs, segments, groups, shards)
    head = uni.filter(F.col("c") >= F.lit(min(least_word, (1 << 63) - 1))).toArrow()  # at most HEAD rows
    h, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(h)
    return {"n": n, "v": v, "unknown": once / n if once else 1 / (n + 1), "bigram": 1 - lone / n if n else 0.0, "shards": shards, "segments": segments, "groups": groups, "head_h": h[order], "head_c": c[order],
            "filter": collected(parts, segments, groups) if shared else None, "parts": parts, "least_word": least_word, "counts": uni}


def mapped(broadcast: Broadcast, size: int) -> np.ndarray:
    """The ``size`` bytes of a broadcast, mapped from the file that Spark keeps on the executor where there is one."""
    path = getattr(broadcast, "_path", None)
    if path:
        with open(path, "rb") as file:
            start = file.read(64)
        mark = b"\x96" + size.to_bytes(8, "little")  # a pickled bytearray: its bytes follow
        if (at := start.find(mark)) >= 0:
            return np.memmap(path, np.uint8, "r", at + len(mark), (size,))
    return np.frombuffer(broadcast.value, np.uint8)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<h:long,c:long,v:long,vc:long,g:double>>"


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    n, v, unknown, lam, segments, groups = (model[k] for k in ("n", "v", "unknown", "bigram", "segments", "groups"))
    shared = spark.sparkContext.broadcast((model["head_h"], model["head_c"]))  # HEAD * 16 bytes at most
    filter_ = None if model["filter"] is None else spark.sparkContext.broadcast(model["filter"])  # FILTER_BITS at most
    size = segments * _SEGMENT // 8
    whole, cut = n + 0.1 * (v + 1), model["least_word"] > 1  # cut: some words are not in the head
    kinds = (("h", pa.int64()), ("c", pa.int64()), ("v", pa.int64()), ("vc", pa.int64()), ("g", pa.float64()))

    def scored(ids: pa.Array, held: pa.Array, h: np.ndarray, offset: np.ndarray, given: np.ndarray | None) -> pa.RecordBatch:
        """given: the level of each token's pair, or None to look only at pairs that can count in the broadcast filter."""
        head_h, head_c = shared.value
        at = np.minimum(np.searchsorted(head_h, h), max(0, len(head_h) - 1))
        c = np.where(head_h[at] == h, head_c[at], 0) if len(head_h) else np.zeros(len(h), np.int64)
        starts = offset[:-1]
        before, history = np.empty_like(c), np.empty_like(h)
        before[1:], history[1:] = c[:-1], h[:-1]
        before[starts], history[starts] = c[offset[1] - 1], END
        known = c > 0
        open_ = ~known | (before == 0) if cut else ~known
        g = np.zeros(len(h))
        some = np.flatnonzero((before > 0) | open_)
        g[some] = count_at(probe(mapped(filter_, size), pair_ids(h, offset)[some], segments) if given is None else given[some])
        x = np.where(before > 0, lam * np.minimum(g, before) / np.maximum(before, 1), 0.0)
        back = np.where(before > 0, 1 - lam, 1.0)
        base = np.where(known, np.log10((c + 0.1) / whole), 0.0)
        s = np.where(open_, 0.0, np.log10(np.maximum(x + back * (1 - unknown) * c / max(n, 1), 1e-300)))
        add = lambda z: np.add.reduceat(z, starts)
        rest = np.flatnonzero(open_)
        parts = (h[rest].view(np.int64), c[rest].astype(np.int64), history[rest].view(np.int64), before[rest].astype(np.int64), g[rest])
        tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, offset).astype(np.int32)), pa.StructArray.from_arrays([pa.array(y, t) for y, (_, t) in zip(parts, kinds, strict=True)], names=[k for k, _ in kinds]))
        return pa.RecordBatch.from_arrays([ids, held, pa.array(np.diff(offset)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(s)), tail.cast(pa.list_(pa.struct(kinds)))], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                part = batch.slice(a, b - a)
                yield scored(part.column(0), part.column(1), *tokens(texts[a:b]), None)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(2).to_pylist(), _PACKED):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist()], pa.list_(x.type)) for x in part.columns], names=["ids", "held", "texts"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, texts, levels in zip(*batch.columns, strict=True):
                h, offset = tokens(texts.as_py())
                _, _, place = _by_group(pair_ids(h, offset), segments, groups)
                given = np.concatenate([np.frombuffer(p["data"], np.uint8) for p in sorted(levels.as_py(), key=lambda p: p["g"])])
                yield scored(ids.values, held.values, h, offset, given[place].astype(np.int64))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    if model["filter"] is not None:
        made = source.mapInArrow(run, _SCORED)
    else:
        packed = source.mapInArrow(pack, "ids array<long>, held array<boolean>, texts array<binary>")
        packed = stash(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")  # blocks are fixed from here on
        levels = block_levels(packed.select("block", "texts"), model["parts"], segments, groups, model["shards"])
        made = packed.join(levels, "block").select("ids", "held", "texts", "levels").mapInArrow(unpack, _SCORED)
    rows = stash(made.withColumn("row", F.monotonically_increasing_id()), "scored")  # row is fixed from here on
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    if cut:
        rare = model["counts"].filter(F.col("c") < F.lit(min(model["least_word"], (1 << 63) - 1)))
        for key, own in (("h", "c"), ("v", "vc")):  # what the head has counted joins by row, which spreads it and finds nothing
            found = rare.select(F.col("h").alias("k"), F.col("c").alias("found"))
            tail = tail.withColumn("k", F.when(F.col(own) > 0, F.col("row")).otherwise(F.col(key))).join(found, "k", "left")
            tail = (tail.withColumn("late", F.col("c") == 0) if key == "h" else tail).withColumn(own, F.when(F.col(own) > 0, F.col(own)).otherwise(F.coalesce("found", F.lit(0)))).drop("k", "found")
    else:
        tail = tail.withColumn("late", F.col("c") == 0)
    c, vc = F.col("c"), F.col("vc")
    word = F.when(c > 0, (1 - unknown) * c / max(n, 1)).otherwise(F.lit(unknown))
    p = F.when(vc > 0, lam * F.least(F.col("g"), vc.cast("double")) / vc + (1 - lam) * word).otherwise(word)
    # base has the tokens whose count the head gave
    more = tail.groupBy("row").agg(F.count_if(F.col("late") & (c > 0)).alias("k"), F.sum(F.when(F.col("late"), F.log10((c + 0.1) / F.lit(whole)))).alias("b"), F.sum(F.log10(F.greatest(p, F.lit(1e-300)))).alias("s"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))


QUERIES = {"op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
