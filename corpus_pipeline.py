"""The corpus pipeline; counted as part of the subpackage llm.

Each stage is written and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.line_rules import quality_stage
from strandloom.llm.mixing import mixing_stage
from strandloom.llm.near_dedup import near_dedup_stage
from strandloom.llm.packing import packing_stage
from strandloom.llm.pseudonyms import pseudonym_stage
from strandloom.llm.util import documents
from strandloom.plans.storage import shared_dir

STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_dedup_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Sketches, Feistel permutations and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
