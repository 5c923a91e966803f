"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.llm.common import table
from dosegrid.llm.decontamination import contaminated_removed
from dosegrid.llm.near_duplicates import drop_near_duplicates
from dosegrid.llm.private_data import redact_private_data
from dosegrid.llm.quality import quality_filter
from dosegrid.llm.queries import mixed
from dosegrid.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality_filter(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    return contaminated_removed(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return redact_private_data(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken into the mix, with the times each is read.

    Columns domain, n_tokens and copies are added, in place of any of these names.
    """
    taken = mixed(docs)
    return taken.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ("domain", "n_tokens", "copies")),
        F.col("mix_domain").alias("domain"),
        F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_copies").alias("copies"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("source_mixing", source_mixing),
]

#: Shingle signatures and tokenisers have no SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
