"""The corpus pipeline: quality, near copies, repeated passages, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the
stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import minhash, packing, pii, quality, substring
from tallyforge.llm.common import materialise, released, table

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", minhash.stage),
    ("repeated_passages", substring.stage),
    ("private_data", pii.stage),
    ("packing", packing.stage),
]

#: A learned model takes part, so SQL can't express it; a test holds each stage, on what the one before kept, against a plain version or planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if done is not None:
            released(done)  # the next stage has read it
        done = docs
    return docs
