"""Secret scan: three fixed patterns, and a battery of randomness tests with false-discovery control for the rest.

The battery takes every maximal run of 20 or more letters, digits and ``+/_=-`` that no pattern covers.  Its encoding is
the first alphabet (digits, letters of one case, hex, base32, letters of one case with digits, base62, base64, base64url)
that holds its characters.  A run is cut at ``=`` inside it.  A part that mixes ``+/`` with ``-_`` is read twice, cut at
``-_`` and cut at ``+/``; its pieces' p-values are doubled, and of pieces that overlap the one with most evidence stays.
Three tests ask whether it is uniform over that alphabet: chi-squared over the symbols (moments that are exact for a
uniform source, whatever the length), runs above and below the middle of the alphabet, and serial correlation at lag 1.
Their smallest p-value times three is the battery's; a run stays if that is at least ``ALPHA``.

Passing is weak evidence for short runs, so a discovery also needs evidence against the ordinary hypothesis.  That is an
e-value, the likelihood ratio of "uniform over the encoding" to "ordinary token" (a chain over character classes in which
a class follows itself with probability ``SAME``); p = min(1, 1/e).  Benjamini-Hochberg at ``LEVEL`` runs within each
length class over all candidates of all rows, so many short runs can't lend their size to long ones or the reverse.
The p-values are binned downwards in significance, which only makes it stricter; the driver sees one count for each
length class and bin (at most ``len(LENGTHS) * BINS`` rows).

Null and empty texts have no spans.  Repeated rows and null ids are scanned like all others.  Only the id and the text of
the input are read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import kept, sliced, stash, table, unstash

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")
PIECES = (re.compile(r"[A-Za-z0-9+/]+(?:=+\Z)?"), re.compile(r"[A-Za-z0-9_-]+(?:=+\Z)?"))
KINDS = ("assign", "access", "hex", "random")
LEAST = 20

ALPHA, LEVEL, SAME, BINS = 0.01, 0.01, 0.9, 400
LENGTHS = (20, 24, 32, 48, 96)
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [("digits", _DIGIT), ("lower", _LOWER), ("upper", _UPPER), ("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("base32", _UPPER + "234567"), ("lower36", _DIGIT + _LOWER), ("upper36", _DIGIT + _UPPER), ("base62", _DIGIT + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGIT + "+/"), ("base64url", _UPPER + _LOWER + _DIGIT + "-_")]
_SETS = [(n, frozenset(a), {c: i for i, c in enumerate(a)}) for n, a in ENCODINGS]
_CLASS = {c: k for k, chars in enumerate((_LOWER, _UPPER, _DIGIT)) for c in chars}


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(codes: list[int], size: int) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity, runs about the middle, and lag-1 serial correlation, for codes in range(size)."""
    n = len(codes)
    chi = sum(v * v for v in Counter(codes).values()) * size / n - n
    p_chi = _two_sided((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = [2 * c >= size for c in codes]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    m = (size - 1) / 2
    var = sum((c - m) ** 2 for c in codes) / n
    r = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:], strict=False)) / (n - 1) / var if var else 1.0
    return p_chi, p_runs, _two_sided(r * math.sqrt(n - 1))


def examine(run: str) -> tuple[str, float, float] | None:
    """(encoding, battery p, p under the ordinary hypothesis), or None if no encoding holds it or it is short."""
    bare = run.rstrip("=")
    chars = set(bare)
    for name, alphabet, code in _SETS:
        if chars <= alphabet:
            break
    else:
        return None
    classes = [_CLASS.get(c, 3) for c in bare]
    if len(bare) < LEAST:
        return None
    p = min(1.0, 3 * min(battery([code[c] for c in bare], len(alphabet))))
    share = Counter(_CLASS.get(c, 3) for c in alphabet)
    log_e = 0.0
    for before, now in zip(classes, classes[1:], strict=False):
        log_e += math.log(share[now] / len(alphabet) / (SAME if now == before else (1 - SAME) / 3))
    return name, p, math.exp(-max(0.0, min(log_e, 700)))


def parts(run: str) -> list[tuple[int, str, int]]:
    """(start in the run, part, number of readings) of what is to be tested."""
    out = []
    for m in PART.finditer(run):
        bare = m[0].rstrip("=")
        if len(bare) < LEAST:
            continue
        if ("+" in bare or "/" in bare) and ("-" in bare or "_" in bare):
            out += [(m.start() + x.start(), x[0], 2) for reading in PIECES for x in reading.finditer(m[0])]
        else:
            out.append((m.start(), m[0], 1))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(base spans as (start, kind, end), candidates as (start, end, length class, bin)) of one text."""
    base: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found, at = [], 0
    for word in text.split():  # a run holds no white space
        if len(word) >= LEAST:
            at = text.index(word, at)
            base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word)]
            found += [(at + m.start(), m[0]) for m in RUN.finditer(word)]
            at += len(word)
    base.sort()
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # greatest end so far
    covered = lambda start, end: (k := bisect_left(starts, end)) and ends[k - 1] > start
    out = []
    for at, run in found:
        own: list[tuple[float, int, int]] = []
        for start, part, readings in parts(run):
            start += at
            end = start + len(part)
            if covered(start, end) or not (got := examine(part)) or got[1] < ALPHA:
                continue
            own.append((min(1.0, readings * got[2]), start, end))
        taken: list[tuple[int, int]] = []  # in order, none overlaps another
        for p, start, end in sorted(own):
            k = bisect_left(taken, (end, end))
            if not k or taken[k - 1][1] <= start:
                taken.insert(k, (start, end))
                out.append((start, end, bisect_right(LENGTHS, end - start) - 1, min(BINS - 1, int(-10 * math.log10(p)))))
    out.sort()
    return base, out


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, candidates array<struct<start:int,stop:int,cls:int,bin:int>>"


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts, the base spans, and the battery's candidates with length class and bin."""
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "stop", "cls", "bin")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("secrets")
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = scan(text)
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest(), joined, [dict(zip(("start", "stop", "cls", "bin"), x, strict=True)) for x in more]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, _FOUND)


def thresholds(found: DataFrame, level: float = LEVEL) -> dict[int, int]:
    """For each length class the lowest bin that Benjamini-Hochberg rejects."""
    counts: dict[int, Counter] = {}
    for r in found.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin").count().collect():  # bounded: classes x bins
        counts.setdefault(r["cls"], Counter())[r["bin"]] = r["count"]
    out = {}
    for cls, by_bin in counts.items():
        m, k = sum(by_bin.values()), 0
        for b in sorted(by_bin, reverse=True):
            k += by_bin[b]
            if 10 ** (-b / 10) <= level * k / m:  # the bin's largest p
                out[cls] = b
    return out


def spans(found: DataFrame, least: dict[int, int]) -> DataFrame:
    """``found`` with ``spans``: base spans and the discoveries, by start, then kind; ``n_random`` counts the discoveries."""
    ok = F.lit(False)
    c = lambda x: x
    taken = F.filter("candidates", lambda x: _any([(x["cls"] == k) & (x["bin"] >= b) for k, b in sorted(least.items())], ok))
    named = F.transform(taken, lambda x: F.struct(x["start"].alias("s"), F.lit(3).alias("k"), F.format_string("random:%d:%d", x["start"], x["stop"]).alias("v")))
    parts = F.transform(F.filter(F.split("base", ","), lambda v: v != ""), lambda v: F.struct(F.split(v, ":")[1].cast("int").alias("s"), F.lit(0).alias("k"), v.alias("v")))
    # the sort is by start, then base before discoveries; base spans with one start are in kind order already
    order = F.array_sort(F.concat(F.transform(parts, lambda p, i: F.struct(p["s"].alias("s"), i.alias("k"), p["v"].alias("v"))), F.transform(named, lambda p: F.struct(p["s"].alias("s"), F.lit(1 << 30).alias("k"), p["v"].alias("v")))))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform(order, lambda p: p["v"]), ",").alias("spans"), F.size(taken).cast("long").alias("n_random"))


def _any(conditions: list, start):
    for c in conditions:
        start = start | c
    return start


def scan_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", level: float = LEVEL) -> DataFrame:
    found = stash(find(docs, id_col, text), "secrets")
    return spans(found, thresholds(found, level))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; each secret span of its text becomes ``[secret]`` and ``n_chars`` follows.

    Overlapping spans are replaced as one.
    """
    found = stash(find(docs), "secrets")
    least = thresholds(found)
    unstash(found)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("secrets")
        for batch in sliced(batches, text_at):
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = []
            for text in cols["text"].to_pylist():
                if text is not None:
                    base, more = scan(text)
                    text = redact_text(text, [(s, e) for s, _, e in base] + [(s, e) for s, e, cls, b in more if b >= least.get(cls, BINS)])
                texts.append(text)
            cols["text"] = pa.array(texts, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def redact_text(text: str, taken: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(taken):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
