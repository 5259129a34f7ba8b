"""The corpus pipeline: each stage reads its predecessor's rows as Parquet.  ORACLE_SQL is None: SQL has no automaton or learned model."""

from __future__ import annotations

import uuid

from veilmark.llm import stages
from veilmark.llm.common import documents, scratch_root, session_defaults
from veilmark.scratch import drop, with_tables

STAGES = [
    ("language_id", stages.language_stage),
    ("minhash_dedup", stages.dedup_stage),
    ("decontaminate", stages.decontaminate_stage),
    ("secret_scan", stages.secret_stage),
    ("bpe", stages.bpe_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    session_defaults(spark)
    docs = documents(spark, sf_dir)
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        with with_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}-{name}")
        docs = spark.read.parquet(f"{root}/{n}-{name}")
        if n:  # what the stage before wrote has been read
            drop(spark, f"{root}/{n - 1}-{STAGES[n - 1][0]}")
    return docs
