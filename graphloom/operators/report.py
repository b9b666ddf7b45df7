"""Reports of findings: SARIF, Markdown, terminal text, JSON, counts and the exit gate.

findings: (id, class, rubric_version, severity, file, start, end, line, message, evidence, rationale, confidence, e_value,
p_value, fingerprint BINARY, sites); ``id`` gives the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL = "graphloom"
LEVELS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, k in LEVELS.items():
        out = F.when(severity == name, k).otherwise(out)
    return out


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))


def primary_location(findings: DataFrame) -> DataFrame:
    return findings.select("id", "file", "line", "start")


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(id, rule, level, result): one SARIF result object for each finding."""
    level = sarif_level(F.col("severity"))
    region = F.struct(F.col("line").alias("startLine"), F.col("start").alias("byteOffset"), F.greatest(F.lit(0), F.col("end") - F.col("start")).alias("byteLength"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    props = F.struct("confidence", F.col("e_value").alias("eValue"), F.col("p_value").alias("pValue"), "sites", "rationale", F.col("rubric_version").alias("rubricVersion"))
    result = F.struct(F.col("class").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(hex_of(F.col("fingerprint")).alias(f"{TOOL}/primary")).alias("partialFingerprints"), props.alias("properties"))
    return findings.select("id", F.col("class").alias("rule"), level.alias("level"), result.alias("result"))


def sarif(findings: DataFrame) -> DataFrame:
    """One row (json): a SARIF 2.1.0 log; rules in the order of first findings with their level."""
    rows = sarif_rows(findings)
    rules = rows.groupBy("rule").agg(F.min(F.struct("id", "level")).alias("f")).agg(F.transform(F.sort_array(F.collect_list(F.struct("f.id", "rule", "f.level"))), lambda x: F.struct(
        x["rule"].alias("id"), x["rule"].alias("name"), F.struct(x["rule"].alias("text")).alias("shortDescription"), F.struct(x["level"].alias("level")).alias("defaultConfiguration"))).alias("rules"))
    results = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.to_json("result").alias("j")))), lambda x: x["j"]).alias("results"))
    schema = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/cs01/schemas/sarif-schema-2.1.0.json"
    return rules.crossJoin(results).select(F.concat(  # one row by one row
        F.lit(f'{{"version":"2.1.0","$schema":"{schema}","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","rules":'), F.to_json("rules"),
        F.lit('}},"results":['), F.array_join("results", ","), F.lit("]}]}")).alias("json"))


def _text(rows: DataFrame, head: Column, none: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line_text"))), lambda x: x["line_text"]), "")
    return rows.agg(F.when(F.count("*") == 0, F.lit(none)).otherwise(F.concat(head, body)).alias("text"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    return findings.select("id", F.concat(F.lit("| "), F.col("severity"), F.lit(" | `"), F.col("class"), F.lit("` | `"), F.col("file"), F.lit(":"), F.col("line"), F.lit("` | "), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit(" | "), F.col("sites"), F.lit(" | "), F.replace("message", F.lit("|"), F.lit("\\|")), F.lit(" |\n")).alias("line_text"))


def markdown(findings: DataFrame) -> DataFrame:
    """One row (text)."""
    head = F.concat(F.lit("# scan\n\n"), F.count("*"), F.lit(" finding(s)\n\n| Severity | Class | File:Line | Confidence | Sites | Message |\n|---|---|---|---|---|---|\n"))
    return _text(markdown_rows(findings), head, "# scan\n\n_No findings at the configured FDR threshold._\n")


def _pad(c: Column, n: int) -> Column:
    return F.rpad(c, F.greatest(F.length(c), F.lit(n)), F.lit(" "))


def terminal_rows(findings: DataFrame) -> DataFrame:
    first = F.trim(F.coalesce(F.get(F.split("evidence", "\n"), F.lit(0)), F.lit("")))
    return findings.select("id", F.concat(_pad(F.col("severity"), 8), F.lit(" "), _pad(F.col("class"), 22), F.lit(" "), F.col("file"), F.lit(":"), F.col("line"), F.lit("  p="), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit(" e="), F.format_string("%.1f", F.col("e_value").cast("double")), F.lit("\n  "), F.col("message"), F.lit("\n  > "), first, F.lit("\n\n")).alias("line_text"))


def terminal(findings: DataFrame) -> DataFrame:
    return _text(terminal_rows(findings), F.lit(""), "no findings\n")


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", hex_of(F.col("fingerprint"))).select("id", F.to_json(F.struct("*")).alias("json"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: total and a count for each severity."""
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")])


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """One row (fail): the highest severity reaches the threshold; ``info`` and unknown thresholds never fail."""
    least = LEVELS.get(fail_on, 0)
    return findings.agg(((F.lit(least) > 0) & (F.coalesce(F.max(rank(F.col("severity"))), F.lit(0)) >= least)).alias("fail"))
