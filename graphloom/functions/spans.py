"""Source texts: byte spans, line tables, search, verification.  A file is (file_id, rel_path, content BINARY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space at the end.
TAIL = r"(?U)\s+$"


def read_span(content: Column, start: Column, end: Column) -> Column:
    """Text of bytes [start, end): the end is clamped; "" for an empty span or a cut inside a character."""
    stop = F.least(end, F.octet_length(content).cast("bigint"))
    cut = F.substring(content, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    return F.when((start < stop) & (start >= 0), F.coalesce(F.try_validate_utf8(cut.cast("string")), F.lit(""))).otherwise(F.lit(""))



def read_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (file_id, start, end) with ``text``; files join by id, a missing file gives null."""
    return spans.join(files.select("file_id", "content"), "file_id", "left").withColumn("text", F.when(F.col("content").isNotNull(), read_span(F.col("content"), F.col("start").cast("bigint"), F.col("end").cast("bigint")))).drop("content")


def line_starts(text: Column) -> Column:
    """Byte offset of every line's start, then the length: [0, each after a newline ..., length]."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    sizes = F.transform(lines, lambda x: F.octet_length(x).cast("bigint") + 1)
    ends = F.aggregate(sizes, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.concat(F.slice(ends, F.lit(1), F.size(ends) - 1), F.array(F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")))


def lines(files: DataFrame, text: str = "text", key: str = "file_id") -> DataFrame:
    """(key, line, start, text): 1-based lines of each file; the end of a text after its last newline is no line, a final carriage return goes."""
    each = files.select(key, F.split(F.col(text), "\n").alias("__l")).select(key, F.expr(
        "transform(__l, (x, i) -> named_struct('line', i + 1, 'n', CAST(octet_length(x) AS BIGINT) + 1, 'text', x, 'last', i = size(__l) - 1))").alias("__l"))
    rows = each.select(key, F.explode("__l").alias("x")).select(key, F.col("x.line").alias("line"), F.col("x.n").alias("__n"), F.regexp_replace("x.text", r"\r$", "").alias("text"), F.col("x.last").alias("__last"))
    start = F.expr(f"coalesce(sum(__n) OVER (PARTITION BY {key} ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return rows.withColumn("start", start).filter("NOT (__last AND text = '')").select(key, "line", "start", "text")


def grep(files: DataFrame, pattern: str, text: str = "text", key: str = "file_id") -> DataFrame:
    """(key, line) of the lines that hold ``pattern`` literally; files without it are dropped before they are split."""
    some = files.filter(F.contains(F.col(text), F.lit(pattern)))
    each = some.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("k", "x"))
    return each.filter(F.contains(F.col("x"), F.lit(pattern))).select(key, (F.col("k") + 1).alias("line"))


def to_byte(starts: Column, line: Column, column: Column) -> Column:
    """Byte of (1-based line, column) in ASCII text by a line table: null past the end, clamped to the next line's start."""
    at, after = F.try_element_at(starts, line.cast("int")), F.try_element_at(starts, (line + 1).cast("int"))
    return F.when((line >= 1) & (line < F.size(starts)), F.least(at + column, F.coalesce(after, at + column)))


def to_span(starts: Column, l1: Column, c1: Column, l2: Column, c2: Column) -> Column:
    """struct(start, end): a missing start is 0, a missing end the start."""
    start = F.coalesce(to_byte(starts, l1, c1), F.lit(0).cast("bigint"))
    return F.struct(start.alias("start"), F.coalesce(to_byte(starts, l2, c2), start).alias("end"))


def byte_offset(text: Column, starts: Column, line: Column, column: Column) -> Column:
    """Byte of (1-based line, character column): the line is clamped, the column clamps at the line's text without line end."""
    n = F.size(starts) - 1
    at = F.greatest(F.lit(1), F.least(line, n))
    body = F.regexp_replace(F.element_at(F.split(text, "\n"), at.cast("int")), r"\r$", "")
    return F.element_at(starts, at.cast("int")) + F.octet_length(F.substring(body, F.lit(1), column)).cast("bigint")


def span_contains(a_file: Column, a_start: Column, a_end: Column, b_file: Column, offset: Column) -> Column:
    """Whether the half-open span holds the offset of the same file."""
    return (a_file == b_file) & (offset >= a_start) & (offset < a_end)


def span_len(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def verify(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``findings`` (id, file_id, start, end, snippet) with ``ok``: the span's text is the snippet, white space at either end aside."""
    trimmed = lambda c: F.regexp_replace(c, TAIL, "")
    read = read_spans(files, findings)
    return read.withColumn("ok", F.coalesce((F.col("end") >= F.col("start")) & (trimmed(F.col("text")) == trimmed(F.col("snippet"))), F.lit(False))).drop("text")


def find_file(files: DataFrame, path: str) -> DataFrame:
    """The file with that relative path, or whose absolute path ends with its components; of several the smallest id."""
    whole = F.concat(F.lit("/"), F.col("rel_path"))
    return files.filter((F.col("rel_path") == path) | whole.endswith("/" + path.lstrip("/"))).orderBy("file_id").limit(1)
