"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, packing.

Each stage works on all that the one before has kept; ``run`` writes its result as
Parquet into the folder that driver and executors share, and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import materialize, table
from leafline.llm.decontaminate import RESULT, decontaminate
from leafline.llm.near_dedup import near_duplicates
from leafline.llm.packing import pack, packing_digest
from leafline.llm.pii import redacted
from leafline.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs, carry=docs.columns).where("kept").select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class of near-duplicates, whatever ids rows share.

    Rows are numbered by their place in the files of ``docs``, which every scan gives alike.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    classes = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text"))
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_row"))
    return numbered.join(gone.hint("merge"), "_row", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).drop(*RESULT).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing_digest(pack(docs))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

#: Consistent sampling, the label model and the tokenizer can't be expressed in SQL; see tests/llm/test_methods.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
