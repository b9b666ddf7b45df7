"""Size-partitioned MinHash containment search for benchmark items inside documents, with exact verification.

An item's set is its distinct five-word shingles (lower case; a text of one to four words is one shingle).  Items are
partitioned by size class, [2**p, 2**(p+1)).  In class p an item keeps the ``sketch_size`` shingles with the smallest
hashes, its MinHash coordinates; a document is a candidate for it if it holds at least ``sketch - floor(|item| / 5)`` of
them.  A document that holds 0.8 of an item misses at most floor(|item| / 5) of its shingles, so no such pair is lost,
however long the document is.  Candidates are then verified: shared shingles are counted as text, over whole documents.

Only documents are large.  Their shingle hashes are made row by row and meet the sketches in a broadcast join if the
sketches have at most ``BROADCAST_ROWS`` rows, else in a shuffled one; only hits are shuffled.

Null and empty texts have no shingles and are in no pair.  Rows that share an id (a null one too) are one document, or
one item, with the union of their sets.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import free_name, small, stash, table

WORDS, NUM, DEN = 5, 4, 5  # containment of NUM / DEN
_MARGIN = 4


def _words(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    return df.select(F.col(key).alias(out), F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \x09-\x0D]+"), "").alias("w"))


def _per_window(each: str, whole: str) -> Column:
    """An expression for each window of ``w``: ``each`` at its index ``i``, or ``whole`` for a text of fewer words."""
    return F.expr(f"CASE WHEN size(w) >= {WORDS} THEN transform(sequence(0, size(w) - {WORDS}), i -> {each}) WHEN size(w) > 0 THEN array({whole}) END")


def shingles(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """Distinct (``out``, s): the shingles as text."""
    return _words(df, key, text, out).select(out, F.explode(F.array_distinct(_per_window(f"array_join(slice(w, i + 1, {WORDS}), ' ')", "array_join(w, ' ')"))).alias("s")).distinct()


def hashes(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """(``out``, h): the distinct hashes of a row's shingles."""
    df = _words(df, key, text, out).withColumn("w", F.transform("w", lambda w: F.xxhash64(w)))
    five = f"xxhash64({', '.join(f'w[i + {k}]' for k in range(WORDS))})"
    return df.select(out, F.explode(F.array_distinct(_per_window(five, "aggregate(w, 42L, (a, x) -> xxhash64(a, x))"))).alias("h"))


def sketches(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, h, need) of the sketches, and (item_id, n) with the exact size of each item's set."""
    sizes = shingles(items, key, text, "item_id").groupBy("item_id").agg(F.count("*").alias("n"))
    class_end = F.expr("shiftleft(1L, CAST(floor(log2(n)) AS INT) + 1) - 1")
    sized = hashes(items, key, text, "i").distinct().join(sizes, F.expr("i <=> item_id"))
    ranked = sized.withColumn("sketch", F.least("n", F.floor(class_end / DEN).cast("long") + _MARGIN)).withColumn(
        "r", F.expr("row_number() OVER (PARTITION BY item_id ORDER BY h)")).filter("r <= sketch")
    return ranked.select("item_id", "h", F.greatest(F.lit(1).cast("long"), F.col("sketch") - F.floor(F.col("n") * (DEN - NUM) / DEN)).cast("long").alias("need")), sizes


def contained(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item_shingles) of all pairs in which the document holds 0.8 of the item's shingles."""
    sketch, sizes = (stash(x, "sketches") for x in sketches(items, item_key, text))
    hits = hashes(docs, doc_key, text, "doc_id").join(small(sketch), "h").select("doc_id", "item_id", "need", "h").distinct()
    candidates = stash(hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("doc_id", "item_id"), "candidates")
    some = candidates.select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.select(doc_key, text).join(small(some), F.col(doc_key).eqNullSafe(F.col("__id")), "left_semi")
    whole = small(stash(shingles(items, item_key, text, "item_id"), "shingles"))
    shared = shingles(kept, doc_key, text, "doc_id").join(whole, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    c, z = candidates.alias("c"), small(sizes.select(F.col("item_id").alias("__item"), F.col("n").alias("n_item_shingles")))
    shared = shared.alias("x").join(c, F.expr("x.doc_id <=> c.doc_id AND x.item_id <=> c.item_id"), "left_semi")
    return shared.join(z, F.col("item_id").eqNullSafe(F.col("__item"))).filter(f"{DEN} * n_shared >= {NUM} * n_item_shingles").select("doc_id", "item_id", "n_shared", "n_item_shingles")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item."""
    other = free_name(docs, "bad_id")
    bad = stash(contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(other)).distinct(), "contaminated")
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col(other)), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_shingles(name: str, source: str, key: str) -> str:
    lead = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER p" for k in range(1, WORDS)]])
    return rf"""
 {name}_w AS (SELECT {key}, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM {source}),
 {name}_u AS (SELECT {key}, r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM {name}_w),
 {name} AS (SELECT DISTINCT {key}, s FROM (SELECT {key}, {lead} AS s FROM {name}_u WINDOW p AS (PARTITION BY r ORDER BY i)) WHERE s IS NOT NULL
   UNION SELECT {key}, array_to_string(ws, ' ') AS s FROM {name}_w WHERE len(ws) BETWEEN 1 AND {WORDS - 1})"""


OP5_SQL = f"""
WITH {_sql_shingles("ds", "documents", "doc_id")}, {_sql_shingles("its", "benchmark", "item_id")},
 z AS (SELECT item_id, count(*) AS n_item_shingles FROM its GROUP BY item_id)
SELECT doc_id, its.item_id AS item_id, count(*) AS n_shared, n_item_shingles FROM ds JOIN its ON ds.s = its.s JOIN z ON its.item_id IS NOT DISTINCT FROM z.item_id
GROUP BY doc_id, its.item_id, n_item_shingles HAVING {DEN} * count(*) >= {NUM} * n_item_shingles
"""

QUERIES = {"op5_decontamination": op5_decontamination}
SQL = {"op5_decontamination": OP5_SQL}
