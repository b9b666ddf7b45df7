"""Review by a model: prompts, answers, verification of cited spans, sequential judgment, tools.

Answers come from a table, so a run can be repeated: ``responses`` (candidate, turn, content, tool_calls).
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.spans import grep, read_spans, verify
from graphloom.operators.stats import sequential_test

CLASSES = ("tenant-isolation", "cache-poisoning", "authz-missing", "accounting-integrity", "inflight-race", "resource-unbounded", "panic-on-input", "unsafe-soundness", "ssrf-upstream", "secret-exposure", "injection", "deser-bomb")
_FINDINGS = "struct<findings:array<struct<class:string,start_byte:bigint,end_byte:bigint,cited_snippet:string,confidence:double,rationale:string>>>"
_JUDGMENT = "verdict string, p double, note string"


class Model(Protocol):
    """What answers prompts: a callable from a DataFrame (candidate, turn, prompt) to (candidate, turn, content, tool_calls)."""

    def complete(self, prompts: DataFrame) -> DataFrame: ...


class ScriptedModel:
    """Canned answers by turn; the last one of a candidate repeats."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def complete(self, prompts: DataFrame) -> DataFrame:
        last = self.responses.groupBy("candidate").agg(F.max("turn").alias("__last"))
        at = prompts.select("candidate", "turn").join(last, "candidate").withColumn("__t", F.least("turn", "__last"))
        r = self.responses.withColumnRenamed("turn", "__t")
        return at.join(r, ["candidate", "__t"]).drop("__t", "__last")


def chat_request(model: str, prompt: str, schema: dict | None = None, tools: list | None = None) -> str:
    """Body of a chat-completions request at temperature 0."""
    body: dict = {"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
    if schema:
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}
    if tools:
        body["tools"] = [{"type": "function", "function": t} for t in tools]
    return json.dumps(body)


def chat_answer(body: str) -> tuple[str, list[tuple[str, dict]]]:
    """(content, tool calls) of a chat-completions answer; arguments that aren't JSON count as none."""
    message = json.loads(body)["choices"][0]["message"]
    calls = []
    for call in message.get("tool_calls") or []:
        try:
            args = json.loads(call["function"]["arguments"])
        except ValueError:
            args = {}
        calls.append((call["function"]["name"], args))
    return message.get("content") or "", calls


def http_model(url: str, model: str, timeout: float = 60.0):
    """A function for ``mapInPandas`` over (candidate, turn, prompt); one connection at a time for each task."""
    def run(batches):
        import urllib.request

        for pdf in batches:
            answers = []
            for prompt in pdf["prompt"]:
                request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", chat_request(model, prompt).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                    content, calls = chat_answer(answer.read().decode())
                answers.append((content, json.dumps(calls)))
            yield pdf[["candidate", "turn"]].assign(content=[a for a, _ in answers], tool_calls=[c for _, c in answers])

    return run


def system_prompt(version: Column) -> Column:
    return F.concat(F.lit("Role: reviewer of Rust sources for security defects, with read access through the listed tools alone.\nEvery report needs a span whose bytes equal the cited text; without one, report nothing.\nRubric "), version, F.lit(". Classes: " + ", ".join(CLASSES) + ".\n"))


def rubric(cls: Column) -> Column:
    """Instruction for a class; two have their own."""
    return F.when(cls == "tenant-isolation", F.concat(cls, F.lit(": keys or routes that leave out the tenant, so that one tenant's request touches another's data."))).when(
        cls == "panic-on-input", F.concat(cls, F.lit(": unwrap, expect, indexing or slicing of data that a request controls."))).otherwise(
        F.concat(cls, F.lit(": cite the exact span, and the path on which an attacker reaches it.")))


def pass1_prompt(version: Column, cls: Column, source: Column) -> Column:
    return F.concat(system_prompt(version), F.lit("\n"), rubric(cls), F.lit("\n\nSource:\n```\n"), source, F.lit("\n```\n"))


def braces(content: Column) -> Column:
    """From the first opening to the last closing brace; null if they aren't there in that order."""
    s = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    return F.when(s != "", s)


def parse_judgment(content: Column) -> Column:
    """struct(verdict, p, note), or null unless the verdict is vuln or benign and p is a number."""
    j = F.from_json(braces(content), _JUDGMENT)
    return F.when(j["verdict"].isin("vuln", "benign") & j["p"].isNotNull(), F.struct(j["verdict"].alias("verdict"), j["p"].alias("p"), F.coalesce(j["note"], F.lit("")).alias("note")))


def parse_findings(content: Column) -> Column:
    """The findings of an answer; null for all of them if any lacks a required field (a rationale isn't)."""
    rows = F.from_json(braces(content), _FINDINGS)["findings"]
    whole = F.forall(rows, lambda x: x["class"].isNotNull() & x["start_byte"].isNotNull() & x["end_byte"].isNotNull() & x["cited_snippet"].isNotNull())
    return F.when(whole, F.transform(rows, lambda x: x.withField("confidence", F.coalesce(x["confidence"], F.lit(0.0)))))


def pass1(files: DataFrame, slices: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates whose cited text stands in the file: (slice, file_id, class, start, end, snippet, confidence).

    slices: (slice, file_id, start); responses: (slice, content).  Offsets of an answer count from the slice's start.
    """
    found = slices.join(responses, "slice").select("slice", "file_id", F.col("start").alias("__at"), F.explode(parse_findings(F.col("content"))).alias("f"))
    raw = found.select("slice", "file_id", F.col("f.class").alias("class"), (F.col("__at") + F.col("f.start_byte")).alias("start"), (F.col("__at") + F.col("f.end_byte")).alias("end"), F.col("f.cited_snippet").alias("snippet"), F.col("f.confidence").alias("confidence"))
    return verify(files, raw).filter("ok").drop("ok")


def pass2(responses: DataFrame, alpha: float = 0.05, beta: float = 0.05, cap: int = 16) -> DataFrame:
    """(candidate, decision, turn, llr, e): each judgment adds ln(p / (1 - p)), p within [1e-4, 0.9999]; answers without judgment (tool calls too) are no turn."""
    judged = responses.withColumn("j", parse_judgment(F.col("content"))).filter("j IS NOT NULL")
    p = F.least(F.greatest(F.col("j.p"), F.lit(1e-4)), F.lit(0.9999))
    turns = judged.select("candidate", "turn", p.alias("p")).select("candidate", "turn", F.log(F.col("p") / (1 - F.col("p"))).alias("llr"), (F.col("p") / (1 - F.col("p"))).alias("e"))
    return sequential_test(turns, alpha, beta, cap, ["candidate"])


TOOLS = [
    {"name": "read_span", "description": "Text of a byte span of a file.", "parameters": {"type": "object", "properties": {"path": {"type": "string"}, "start": {"type": "integer"}, "end": {"type": "integer"}}, "required": ["path", "start", "end"]}},
    {"name": "definition_of", "description": "Where a symbol is defined.", "parameters": {"type": "object", "properties": {"symbol": {"type": "string"}}, "required": ["symbol"]}},
    {"name": "callers_of", "description": "Direct callers of a symbol.", "parameters": {"type": "object", "properties": {"symbol": {"type": "string"}}, "required": ["symbol"]}},
    {"name": "reaches", "description": "Whether one symbol reaches another by calls.", "parameters": {"type": "object", "properties": {"from": {"type": "string"}, "to": {"type": "string"}}, "required": ["from", "to"]}},
    {"name": "grep", "description": "Lines that hold a literal text.", "parameters": {"type": "object", "properties": {"pattern": {"type": "string"}, "glob": {"type": "string"}}, "required": ["pattern"]}},
]


def execute_tool(index, name: str, args: dict) -> str:
    """JSON result of a tool call on a ``graphloom.sources.index.Index``; unknown tools and symbols give ok false."""
    if name == "read_span":
        file = index.find_file(args.get("path", "")).first()
        if file is None:
            return json.dumps({"ok": False, "error": "no such file"})
        spans = index.spark.createDataFrame([(file["file_id"], int(args.get("start", 0)), int(args.get("end", 0)))], "file_id int, start long, end long")
        return json.dumps({"ok": True, "text": read_spans(index.files, spans).first()["text"]})
    if name == "grep":
        hits = grep(index.texts(), args.get("pattern", "")).join(index.files.select("file_id", "rel_path"), "file_id").orderBy("file_id", "line")
        return json.dumps({"ok": True, "hits": [{"path": r["rel_path"], "line": r["line"]} for r in hits.toLocalIterator()]})
    if name in ("definition_of", "callers_of", "reaches"):
        ids = [index.definition_of(args.get(k, "")) for k in (("from", "to") if name == "reaches" else ("symbol",))]
        if None in ids:
            return json.dumps({"ok": False, "error": "unknown symbol"})
        if name == "reaches":
            return json.dumps({"ok": True, "reaches": index.reaches(*ids)})
        rows = index.symbols.filter(F.col("id") == ids[0]) if name == "definition_of" else index.callers_of(ids[0])
        return json.dumps({"ok": True, "symbols": [{"id": r["id"], "qual": r["qual"]} for r in rows.orderBy("id").toLocalIterator()]})
    return json.dumps({"ok": False, "error": f"unknown tool {name}"})


