"""Parquet and text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_parquet(
    df: DataFrame,
    output: str | None,
    partitions: int | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame | None:
    """Overwrite ``output``; without one, hand the table back unwritten."""
    if not output:
        return df
    if partitions:
        df = df.repartition(partitions)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(output)
    return None


def write_counted(
    df: DataFrame,
    output: str,
    partitions: int | None = None,
    partition_by: list[str] | None = None,
) -> int:
    """Write Parquet and return the number of rows, counted by the same pass."""
    seen = Observation()
    write_parquet(
        df.observe(seen, F.count(F.lit(1)).alias("rows")), output, partitions, partition_by
    )
    return seen.get["rows"]


def write_tsv(df: DataFrame, output: str) -> None:
    """Tab-separated text with a header, one part file per partition in row order."""
    df.write.mode("overwrite").csv(output, sep="\t", header=True)
