"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  Every stage but the last returns
the columns of ``documents``; the last returns the packed pieces.  Between stages rows are written to the shared folder and
read again, so a stage never computes another one anew and a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, neardup, packing, quality, secrets
from graphloom.llm.common import stash, table

STAGES = [
    ("quality_rules", quality.filter_stage),
    ("near_dedup", neardup.near_dedup_stage),
    ("decontamination", decontaminate.decontaminate_stage),
    ("secret_scan", secrets.redact_stage),
    ("packing", packing.pack_stage),
]
#: The ids of a public tokenizer can't be computed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
