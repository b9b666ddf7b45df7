"""File sources: source trees, advisory corpora, snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.ordered import numbered
from graphloom.sources.rust import parse

_SYMBOL = "struct<name:string,qual:string,kind:string,start:bigint,end:bigint,name_start:bigint,name_end:bigint,entry_reason:string>"
PARSED = f"rel_path string, abs_path string, content binary, symbols array<{_SYMBOL}>, calls array<struct<caller:int,callee:string>>"
CORPUS = "entries array<struct<id:string,class:string,vuln_file:string,vuln_line:int,patch_file:string,patch_line:int,kloc:double>>"


Pattern = tuple[str, str, bool, bool, bool]  # folder, regular expression, negated, anchored to the folder, for folders only


def glob_regex(glob: str) -> str:
    """Regular expression of a glob of ignore files: ``*`` and ``?`` stay within a name, ``**`` crosses folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


def parse_ignore(folder: str, text: str) -> list[Pattern]:
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if line and not line.startswith("#"):
            negated, line = line.startswith("!"), line.removeprefix("!")
            bare = line.strip("/")
            if bare:
                out.append((folder, glob_regex(bare), negated, "/" in line.rstrip("/"), line.endswith("/")))
    return out


def _patterns(spark: SparkSession, root: str, paths: DataFrame) -> list[Pattern]:
    """The rules of the tree's ignore files, those that come later winning: the repository's own exclude file, ignore files of
    folders above ``root`` up to the repository's, then those of the folders that hold ``paths`` (abs_path), outer ones first.

    Spark lists no hidden files, so the driver asks for each folder's; there are as many as folders with sources.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(path: str) -> str:
        if not fs.exists(fs_path(path)):
            return ""
        stream = fs.open(fs_path(path))
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    above, folder = [], root
    while "/" in folder.split(":", 1)[-1].strip("/") and not fs.exists(fs_path(f"{folder}/.git")):
        folder = folder.rpartition("/")[0]
        above.append(folder)
    out: list[Pattern] = []
    if fs.exists(fs_path(f"{folder}/.git")):
        out += parse_ignore(folder, read(f"{folder}/.git/info/exclude"))
        for up in reversed(above):
            out += parse_ignore(up, read(f"{up}/.gitignore"))
    rel = paths.select(F.split(F.expr(f"substring(abs_path, {len(root) + 2})"), "/").alias("parts"))
    folders = rel.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("folder")).distinct()
    for name in sorted((r["folder"] for r in folders.collect()), key=lambda f: (f.count("/") + bool(f), f)):
        folder = f"{root}/{name}".rstrip("/")
        out += parse_ignore(folder, read(f"{folder}/.gitignore"))
    return out


def ignored(path: str, patterns: list[Pattern]) -> bool:
    """Whether the last pattern that matches the path, or a folder above it, is no negation."""
    out = False
    for folder, pattern, negated, anchored, folders in patterns:
        if not path.startswith(folder + "/"):
            continue
        parts = path[len(folder) + 1 :].split("/")
        for k in range(1, len(parts) + (not folders)):
            if re.fullmatch(pattern, "/".join(parts[:k]) if anchored else parts[k - 1]):
                out = not negated
                break
    return out


def source_files(spark: SparkSession, root: str, extension: str = "rs") -> DataFrame:
    """(file_id, rel_path, abs_path, content) of the tree's files in path order: no hidden names, none that ignore files name, UTF-8 only."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(full).select(F.col("path").alias("abs_path"), "content")
    rel = F.expr(f"substring(abs_path, {len(full) + 2})")
    seen = raw.withColumn("rel_path", rel).filter(~F.col("rel_path").rlike(r"(^|/)\.")).filter(F.is_valid_utf8(F.col("content").cast("string")))
    if patterns := _patterns(spark, full, raw):
        dropped = F.pandas_udf(lambda paths: paths.map(lambda p: ignored(p, patterns)).astype(bool), "boolean")
        seen = seen.filter(~dropped("abs_path"))
    numbers = numbered(seen.select("abs_path", "rel_path"), "rel_path", name="number").select("abs_path", (F.col("number") - 1).cast("int").alias("file_id"))
    return seen.join(numbers, "abs_path").select("file_id", "rel_path", "abs_path", "content")


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` with arrays symbols and calls, both empty where a file doesn't parse."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse(bytes(c).decode(), p) or ([], []) for c, p in zip(pdf["content"], pdf["rel_path"], strict=True)]
            yield pdf.assign(symbols=[[s._asdict() for s in x[0]] for x in got], calls=[[{"caller": a, "callee": b} for a, b in x[1]] for x in got])

    return files.select("file_id", "rel_path", "abs_path", "content").mapInPandas(run, "file_id int, " + PARSED)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Advisories, a row each, of a JSON file {"entries": [...]}."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def corpus_json(corpus: DataFrame) -> DataFrame:
    """One row (json) with the whole corpus; advisories are few."""
    return corpus.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*corpus.columns))).alias("entries"))).alias("json"))


def corpus_kloc(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.coalesce(F.sum("kloc"), F.lit(0.0)).alias("kloc"), F.count("*").alias("n"))
