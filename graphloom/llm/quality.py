"""Rule bitmask ledger: every rule is evaluated once, its failure goes to a bit, and policies are masks over the bits.

``ledger`` adds one struct column with the measurements and ``fail_bits``; ``apply_policy`` turns it into a verdict for a
versioned policy; ``ablations`` says, for every rule of a policy, how many more rows would stay without it, from a count
for each distinct value of the bits.  All of it is Spark expressions on one scan without a shuffle (``ablations``
aggregates at most ``2 ** len(RULES)`` groups).

Null and empty texts have no words: every measurement is 0, ``too_few_words`` fails.  Repeated rows and null ids are
measured like all others.  Other columns stay, whatever they are called; ``into`` replaces one of its name.
Windows are compared by a 64-bit hash of their five words, within one text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import free_name, table

#: Bit, name, SQL condition over the measurements under which the rule fails.  Integer arithmetic, so that no engine rounds.
RULES: list[tuple[int, str, str]] = [
    (0, "too_few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbols", "100 * n_symbols > 25 * n_words"),
    (3, "shouting", "100 * n_upper > 30 * (n_upper + n_lower)"),
    (4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (5, "short_words", "word_chars < 2 * n_words"),
    (6, "long_words", "word_chars > 15 * n_words"),
]
BITS = {name: 1 << bit for bit, name, _ in RULES}
BASE = ("too_few_words", "repeated_windows")
#: (name, version) -> the rules that count.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): BASE,
    ("prose", 1): (*BASE, "symbols", "shouting"),
    ("prose", 2): tuple(BITS),
}
CURRENT = ("prose", 2)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")
_WINDOW = 5


def mask(policy: tuple[str, int]) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def _kept_chars(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def ledger(df: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``df`` with the struct column ``into``: ``MEASURES`` and ``fail_bits``, all long."""
    q = free_name(df, "__q_", prefix=True)
    t = F.col(f"{q}text")
    df = df.withColumn(f"{q}text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        f"{q}words": F.array_remove(F.split(t, r"[ \x09-\x0D]+"), ""),
        f"{q}lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")),
    })
    # each hash is made once, here; what follows works on longs
    df = df.withColumn(f"{q}hash", F.transform(f"{q}words", lambda w: F.xxhash64(w)))
    df = df.withColumn(f"{q}windows", F.when(F.size(f"{q}hash") < _WINDOW, F.array().cast("array<bigint>")).otherwise(F.expr(
        f"transform(sequence(0, size({q}hash) - {_WINDOW}), i -> xxhash64({', '.join(f'{q}hash[i + {k}]' for k in range(_WINDOW))}))")))
    df = df.withColumn(f"{q}sorted", F.expr(
        f"CASE WHEN size(array_distinct({q}windows)) = size({q}windows) THEN CAST(array() AS array<struct<h:bigint,i:int>>)"
        f" ELSE sort_array(transform({q}windows, (h, i) -> named_struct('h', h, 'i', i))) END"))
    df = df.withColumn(f"{q}found", F.expr(
        f"sort_array(transform(filter({q}sorted, (x, j) -> (j > 0 AND get({q}sorted, j - 1).h = x.h)"
        f" OR coalesce(get({q}sorted, j + 1).h = x.h, false)), x -> x.i))"))
    df = df.withColumn(f"{q}measures", F.struct(
        F.size(f"{q}words").cast("long").alias("n_words"),
        F.length(F.array_join(f"{q}words", "")).cast("long").alias("word_chars"),
        _kept_chars(t, "#*$%&|<>").alias("n_symbols"),
        (F.size(f"{q}lines") - F.size(F.array_distinct(f"{q}lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"aggregate(transform({q}found, (p, j) -> least({_WINDOW}, coalesce(get({q}found, j + 1) - p, {_WINDOW}))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size(f"{q}lines").cast("long").alias("n_lines"),
        _kept_chars(t, r"\p{Lu}").alias("n_upper"),
        _kept_chars(t, r"\p{Ll}").alias("n_lower"),
    ))
    qualified = lambda rule: re.sub(r"\b(n_\w+|word_chars)\b", rf"{q}measures.\1", rule)
    bits = " + ".join(f"(CASE WHEN {qualified(rule)} THEN {1 << bit}L ELSE 0L END)" for bit, _, rule in RULES)
    whole = F.expr(f"named_struct({', '.join(f'{m!r}, {q}measures.{m}' for m in MEASURES)}, 'fail_bits', {bits})")
    # a generator of one row: filters on the bits stay above it.  Else the optimizer pushes them down to the scan, and with
    # them a copy of every expression above into every place, also inside lambdas, that names its column
    df = df.withColumn(into, F.explode(F.array(whole)))
    return df.drop(*[c for c in df.columns if c.startswith(f"{q}")])


def apply_policy(df: DataFrame, policy: tuple[str, int] = CURRENT, ledger_col: str = "ledger", into: str = "kept") -> DataFrame:
    """``df`` with the boolean ``into``: true if no rule of the policy failed."""
    return df.withColumn(into, F.col(ledger_col)["fail_bits"].bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(ledgers: DataFrame, policy: tuple[str, int] = CURRENT, ledger_col: str = "ledger") -> DataFrame:
    """For each rule of the policy: rule, n_rows, n_kept under it, n_failed by the rule, n_only (rows that only this rule rejects)."""
    whole = mask(policy)
    bits = ledgers.groupBy(F.col(ledger_col)["fail_bits"].bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return bits.withColumn("r", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_rows"), total(F.col("bits") == 0).alias("n_kept"),
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), total(F.col("bits") == F.col("r.bit")).alias("n_only"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the current policy keeps, with their own columns, whatever these are called."""
    into, kept = free_name(docs, "ledger"), free_name(docs, "kept")
    return apply_policy(ledger(docs, into=into), ledger_col=into, into=kept).filter(F.col(kept)).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    x = F.col("ledger")
    return df.select("doc_id", *[x[m].alias(m) for m in MEASURES[:5]], (x["fail_bits"].bitwiseAND(F.lit(mask(("base", 1))).cast("long")) != 0).alias("base_failed"), "kept", x["fail_bits"].alias("fail_bits"))


_SQL_CASE = " + ".join(f"(CASE WHEN {rule} THEN {1 << bit} ELSE 0 END)" for bit, _, rule in RULES)
_SQL_LEADS = " || chr(31) || ".join(["w", *[f"lead(w, {k}) OVER p" for k in range(1, _WINDOW)]])
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
 u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
 g AS (SELECT doc_id, i, {_SQL_LEADS} AS g FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 c AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS dup FROM g),
 v AS (SELECT doc_id, i, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {_WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM c),
 r AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM v GROUP BY doc_id),
 m AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g')) AS BIGINT) AS n_lower
       FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
 b AS (SELECT *, CAST({_SQL_CASE} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(("base", 1))}) <> 0 AS base_failed,
 (fail_bits & {mask(CURRENT)}) = 0 AS kept, fail_bits FROM b
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL = {"op4_quality_rules": OP4_SQL}
