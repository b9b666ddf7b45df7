"""All queries of the subpackage and the SQL of those that SQL can express."""

from graphloom.llm import decontaminate, html, lm, neardup, packing, quality, secrets, substrings, toxicity, warc

_MODULES = (secrets, toxicity, html, quality, decontaminate, neardup, packing, warc, substrings, lm)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
