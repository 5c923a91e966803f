"""Text files as rows of (source, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.sources.blocks import RANGE_BYTES, block_files, escaped, read_blocks

_PACKED = (".gz", ".bgz", ".zst", ".xz")


def read_lines(
    spark: SparkSession, paths: list[str], spread: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """All lines of all files; compression goes by the file extension.

    Block gzip is unpacked by a task for each range of a file, any other packed
    file by one task; ``spread`` deals out the lines of those.
    """
    text = spark.read.text(list(paths))
    files = text.inputFiles()
    packed = [f for f in files if f.endswith((".gz", ".bgz"))]
    found = block_files(spark, packed).collect() if packed else []  # a row for each file
    place = F.col("_metadata.file_path")
    rest = text.where(~place.isin([f.source for f in found])) if found else text
    lines = rest.select(place.alias("source"), "value")
    if spread and any(f.endswith(_PACKED) for f in files):
        lines = lines.hint("rebalance")
    if not found:
        return lines
    blocks = read_blocks(spark.createDataFrame(found, "source string, size long"), range_bytes)
    return blocks if len(found) == len(files) else blocks.union(lines)


def is_data(value: str = "value"):
    """Condition for lines that are neither blank nor comments."""
    return (F.length(value) > 0) & ~F.startswith(F.col(value), F.lit("#"))


def read_lines_capped(spark: SparkSession, paths: list[str], limit: int) -> DataFrame:
    """Header lines and the first ``limit`` data lines of each file, for debugging."""

    def capped(path: str) -> DataFrame:
        lines = read_lines(spark, [path])
        header = lines.where(F.startswith(F.col("value"), F.lit("#CHROM")))
        return lines.where(is_data()).limit(limit).union(header)

    files = spark.read.text(list(paths)).inputFiles()
    return reduce(DataFrame.union, map(capped, map(escaped, files)))
