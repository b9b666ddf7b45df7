"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

*Sketch.*  Each of ``T`` coordinates is a bin.  In round i < T every element goes to a hashed bin with value (i, hash);
in rounds T to 2T - 1 every element goes to bin i - T, so that all bins are filled for any set that isn't empty; a bin
keeps its smallest value and rounds end when all bins are filled.  The share of equal coordinates estimates the Jaccard
similarity with the concentration of as many independent MinHashes, after expected O(n + T log T) hashes.

*Banding.*  ``BANDS`` x ``ROWS`` coordinates; at similarity 0.8 a pair shares no band with probability 3e-7.  Six rows keep chance
collisions, whose number grows with the square of the documents, rare.

*Verification.*  Nodes are distinct sets (documents whose sets agree in size and in two 64-bit sums over all members are one
node).  A node's score is the number of meetings in its buckets, so the text that others were copied from scores highest.
First a star: each node is compared exactly with the highest scored node of its buckets, one comparison a node.  That links
nearly all that is linked; a bucket whose nodes are all in one component is done.  In the buckets left, every pair of
different components is looked at.  Buckets that share nodes form a cell; a cell of bounded weight is one group, the buckets
of heavier cells are groups of their own, and a bucket that is too heavy itself is split: its main component in blocks,
the other nodes in blocks, each block of others against itself, the blocks of others, and those of the main component.  So a set travels once
for each group, not for each pair.  Inside a group the shares of equal coordinates rule out pairs more than six
standard deviations below the limit (at the limit, a chance of about 1e-9); the rest are compared exactly, most alike first,
unless found links connect them already.  Nothing is capped.

Components are found by ``components``.  Null and empty texts have no shingles and are linked with nothing.  Rows that
share an id are one document.  Rows with a null id are linked with nothing, have a null component, and are kept.  Only id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hashed_docs, kept, mix, sliced, small, stash, table, unstash, window_hash
from graphloom.llm.components import components

T, ROWS, SHINGLE, NUM, DEN = 300, 6, 2, 80, 100
BANDS = T // ROWS
_SALT_ROWS = 500
#: Shingles (and 1000 for each node) of a group that one task holds at a time: 32 MB of hashes.
MOST_WEIGHT = 4_000_000
_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (A-Z in lower case; with fewer words, the whole sequence)."""
    for a, b in blocks(texts):
        h, offset = hashed_docs([t.lower() for t in texts[a:b]])
        at = np.arange(max(0, len(h) - size + 1))
        grams = window_hash(h, at, at + size) if len(at) else np.zeros(0, np.uint64)
        for s, e in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
            if e - s >= size:
                yield np.unique(grams[s : e - size + 1])
            elif e > s:
                yield window_hash(h[s:e], np.array([0]), np.array([e - s]))
            else:
                yield np.zeros(0, np.uint64)


def sketch(elements: np.ndarray, t: int = T) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty."""
    out = np.full(t, _FREE)
    i = 0
    while i < 2 * t:
        step = min(max(1, 4 * t // len(elements)), (t if i < t else 2 * t) - i)
        rounds = np.arange(i, i + step, dtype=np.uint64)[:, None]
        x = mix(elements[None, :] ^ _SEEDS[i : i + step, None])
        value = (rounds << np.uint64(52)) | (x >> np.uint64(12))
        if i < t:
            np.minimum.at(out, (x & np.uint64(0xFFF)).astype(np.int64).ravel() % t, value.ravel())
        else:
            at = slice(i - t, i - t + step)
            out[at] = np.minimum(out[at], value.min(1))
        i += step
        if (out != _FREE).all():
            break
    return out


def bands(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    m = s.reshape(-1, rows)
    key = np.arange(1, len(m) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
    return key


_SKETCHED = "doc_id long, n long, f1 long, f2 long, bands array<long>"


def sketched(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """For each row: id, set size, two fingerprints of the set, and its band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_dedup")
        for batch in sliced(batches):
            n, f, keys = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), size):
                n.append(len(s))
                f.append((mix(s).sum(dtype=np.uint64), mix(s ^ _SEEDS[0]).sum(dtype=np.uint64)))
                keys.append(bands(sketch(s)).view(np.int64) if len(s) else None)
            prints = np.array(f, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "f1", "f2", "bands"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(run, _SKETCHED)


_SETS = "id long, n long, members binary, coordinates binary"
_COMPARED = "leader long, node long, both long, either long"


def sets_of(pool: DataFrame, size: int) -> DataFrame:
    """(id, n, members, coordinates) of ``pool``: (id, text); a coordinate is the low byte of the sketch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_dedup")
        for batch in sliced(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist(), size))
            low = [sketch(s).astype(np.uint8).tobytes() if len(s) else b"\0" * T for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(low, pa.binary())], names=["id", "n", "members", "coordinates"])

    return pool.mapInArrow(run, _SETS)


def compare(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, node, both, either): exact sizes of intersection and union for each of ``pairs``; a node's set travels once a pair, a leader's once for each ``_SALT_ROWS`` of its pairs."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / _SALT_ROWS).cast("int").alias("salts"))
    member = pairs.join(salts, "leader").select(F.col("node").alias("id"), "leader", F.pmod(F.hash("node"), "salts").alias("salt"), F.lit(True).alias("member"))
    lead = salts.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    routed = sets.join(small(stash(member.unionByName(lead), "routes")), "id").select("leader", "salt", "member", F.col("id").alias("node"), "members")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_dedup")
        at, leads = None, []
        for batch in sliced(batches, 4):
            out = []
            for leader, salt, member, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (leader, salt):
                    at, leads = (leader, salt), []
                s = np.frombuffer(data, np.uint64)
                if not member:
                    leads.append(s)
                    continue
                for lead in leads:
                    both = _common(lead, s)
                    out.append((leader, node, both, len(lead) + len(s) - both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["leader", "node", "both", "either"])

    return routed.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member").mapInArrow(meet, _COMPARED)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def group_links(part: np.ndarray, label: np.ndarray, sets: list[np.ndarray], coordinates: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Positions of pairs that link different labels of one group, none that earlier ones connect.  Parts 0 and 1 meet each other, part -1 meets all."""
    n, label = np.array([len(s) for s in sets]), label.copy()
    order = np.argsort(n, kind="stable")
    n_sorted, share = n[order], num / den
    least = T * share - 6 * np.sqrt(T * share * (1 - share))
    for k, i in enumerate(order.tolist()):
        others = order[k + 1 : np.searchsorted(n_sorted, den * n[i] // num, "right")]
        others = others[(label[others] != label[i]) & ((part[others] != part[i]) | (part[i] < 0))]
        if not len(others):
            continue
        equal = np.count_nonzero(coordinates[others] == coordinates[i], axis=1)
        for j in others[np.argsort(-equal, kind="stable")][: np.count_nonzero(equal >= least)].tolist():
            if label[j] != label[i]:
                both = _common(sets[i], sets[j])
                if den * both >= num * (n[i] + n[j] - both):
                    yield i, j
                    label[label == label[j]] = label[i]


def compare_groups(sets: DataFrame, routes: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, node) of links between components; ``routes``: (id, c, g, part).  A task holds one group at a time."""
    together = sets.join(small(routes), "id").select("g", "part", "id", "c", "members", "coordinates").repartition("g").sortWithinPartitions("g")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_dedup")
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                part, ids, label, members, low = zip(*held, strict=True)
                found = list(group_links(np.array(part), np.array(label), [np.frombuffer(m, np.uint64) for m in members], np.frombuffer(b"".join(low), np.uint8).reshape(-1, T), num, den))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["leader", "node"])

        for batch in sliced(batches, 4):
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at:
                    yield from close()
                    at, held = g, []
                held.append(row)
        yield from close()

    return together.mapInArrow(meet, "leader long, node long")


def _star(alive: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, node): each node with the highest scored node that leads one of its buckets and that its size allows."""
    score = alive.groupBy("id").agg(F.sum("m").alias("score"))
    rank = F.struct("score", (-F.col("id")).alias("less"), F.col("n").alias("n_leader"))
    scored = alive.join(small(score), "id").select("key", "id", "n", rank.alias("rank"))
    top = scored.groupBy("key").agg(F.max("rank").alias("top"))
    led = scored.join(top, "key").filter("-top.less <> id").filter(den * F.least("n", "top.n_leader") >= num * F.greatest("n", "top.n_leader"))
    return led.groupBy("id").agg(F.max("top").alias("top")).select((-F.col("top.less")).alias("leader"), F.col("id").alias("node"))


def _open(alive: DataFrame, linked: DataFrame) -> DataFrame:
    """The buckets whose nodes aren't all in one component of ``linked``, with the component ``c`` of each node."""
    found = components(linked, "leader", "node").select(F.col("node").alias("id"), "component")
    own = alive.join(small(found), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    keys = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    return own.join(keys, "key")


def _routes(mixed: DataFrame, most: int) -> DataFrame:
    """(id, c, g, part): the groups that each node goes to, so that any two nodes of different components in one bucket meet."""
    first = mixed.groupBy("key").agg(F.min("id").alias("first"))
    cells = components(mixed.join(first, "key").select("first", "id"), "first", "id").select(F.col("node").alias("id"), F.col("component").alias("cell"))
    # the smallest node of a cell may stand only as its component
    nodes = mixed.select("id", "n", "c").distinct().join(small(cells), "id", "left").withColumn("cell", F.coalesce("cell", "id"))
    nodes = stash(nodes.withColumn("w", F.col("n") + 1000), "nodes")
    heavy = nodes.groupBy("cell").agg(F.sum("w").alias("weight")).filter(F.col("weight") > most).select("cell")
    heavy = stash(heavy, "heavy")
    alone, heavy = heavy.isEmpty(), small(heavy)
    whole = nodes.join(heavy, "cell", "left_anti").select("id", "c", F.xxhash64(F.lit(0), "cell").alias("g"), F.lit(-1).alias("part"))
    if alone:
        return whole
    # buckets of heavy cells; many have the same nodes
    rest = stash(mixed.join(small(nodes.join(heavy, "cell", "left_semi").select("id").distinct()), "id", "left_semi").distinct(), "rest")
    same = rest.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("h"), F.sum(F.col("n") + 1000).alias("weight"))
    same = same.groupBy("m", "h").agg(F.min(F.struct("key", "weight")).alias("k")).select("k.key", "k.weight")
    by = rest.join(same, "key")
    light = by.filter(F.col("weight") <= most).select("id", "c", F.xxhash64(F.lit(1), "key").alias("g"), F.lit(-1).alias("part"))
    by = by.filter(F.col("weight") > most)
    each = by.groupBy("key", "c").agg(F.sum(F.col("n") + 1000).alias("w"))
    main = each.groupBy("key").agg(F.max(F.struct("w", "c")).alias("x"), F.sum("w").alias("w")).select("key", F.col("x.c").alias("main"), F.ceil(F.col("x.w") / (most / 2)).cast("int").alias("s_main"), F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("x.w")) / (most / 2)).cast("int")).alias("s_other"))
    split = by.join(main, "key").withColumn("is_main", F.col("c") == F.col("main"))
    split = split.withColumn("s", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("s_main")).otherwise(F.col("s_other"))).cast("int"))
    to_main = F.transform(F.sequence(F.lit(0), F.col("s_main") - 1), lambda t: F.struct(F.lit(3).alias("kind"), F.col("s").alias("i"), t.alias("j"), F.lit(0).alias("part")))
    to_other = F.transform(F.sequence(F.lit(0), F.col("s_other") - 1), lambda t: F.struct(F.lit(2).alias("kind"), F.least("s", t).alias("i"), F.greatest("s", t).alias("j"), F.when(t == F.col("s"), -1).otherwise((t < F.col("s")).cast("int")).alias("part")))
    of_main = F.transform(F.sequence(F.lit(0), F.col("s_other") - 1), lambda t: F.struct(F.lit(3).alias("kind"), t.alias("i"), F.col("s").alias("j"), F.lit(1).alias("part")))
    split = split.select("id", "c", "key", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(to_main, to_other))).alias("t"))
    return whole.unionByName(light).unionByName(split.select("id", "c", F.xxhash64("t.kind", "key", "t.i", "t.j").alias("g"), "t.part"))


def links(pool_of, reps: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, most: int = MOST_WEIGHT) -> DataFrame:
    """(leader, node) of verified links that connect whatever all links connect.  ``reps``: (id, n, bands); ``pool_of(ids)`` gives (id, text)."""
    keyed = reps.select("id", "n", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    alive = stash(keyed.join(crowded, "key"), "buckets")
    sets = stash(sets_of(pool_of(stash(alive.select("id").distinct(), "ids")), size), "sets")
    tested = stash(compare(sets, stash(_star(alive, num, den), "pairs")), "compared")
    star = tested.filter(den * F.col("both") >= num * F.col("either")).select("leader", "node").distinct()
    mixed = stash(_open(alive, star), "open")
    unstash(alive)
    if mixed.isEmpty():
        return star
    more = stash(compare_groups(sets, stash(_routes(mixed, most), "routes"), num, den), "links")
    unstash(sets)
    return star.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = stash(sketched(docs, id_col, text, size), "sketches")
    key = ["f1", "f2", "n"]
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    several = full.groupBy(*key).agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")).filter("id <> last").drop("last")
    copies = stash(full.select("doc_id", *key).join(small(stash(several, "nodes")), key).filter("doc_id <> id"), "copies")
    reps = full.join(small(copies.select("doc_id", *key).distinct()), ["doc_id", *key], "left_anti").select(F.col("doc_id").alias("id"), "n", "bands")

    def pool_of(ids: DataFrame) -> DataFrame:
        return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).join(small(ids), "id", "left_semi")

    edges = copies.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).unionByName(links(pool_of, reps, size, num, den).toDF("a", "b"))
    found = small(components(edges, "a", "b").select(F.col("node").alias("doc_id"), "component"))
    return rows.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the rows with its smallest id; five-word shingles, similarity 0.8 or more."""
    gone = stash(near_duplicates(docs, size=5).filter("NOT kept").select("doc_id").distinct(), "duplicates")
    return docs.join(small(gone), "doc_id", "left_anti")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
SQL: dict[str, str] = {}
