"""One entry point for the supported file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from dosegrid.sources.catalogue import parse_catalogue, write_catalogue
from dosegrid.sources.genotypes import GenotypePanel, panel_from_lines, write_panel
from dosegrid.sources.lines import read_lines, read_lines_capped
from dosegrid.sources.sinks import write_counted

FORMATS = ("pq", "gvcf", "dbsnp")


def merge_by_name(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _dealt_out(spark: SparkSession, paths: list[str], partitions: int | None) -> DataFrame:
    """Lines over several tasks, as a compressed file may arrive as one."""
    if partitions:
        return read_lines(spark, paths).repartition(partitions)
    return read_lines(spark, paths, spread=True)


def load_variants(
    spark: SparkSession,
    paths: list[str],
    format: str = "pq",
    output: str | None = None,
    partitions: int | None = None,
    limit: int = 0,
    partition_by: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame | GenotypePanel | int:
    """Load Parquet (pq), genotype (gvcf) or catalogue (dbsnp) files.

    Without ``output`` the loaded table or panel, else the number of records
    stored there. ``limit`` keeps the first lines of each genotype file. A table
    is stored by the values of ``partition_by``, a catalogue also in ``buckets``,
    to be read by ``read_catalogue``.
    """
    if format not in FORMATS:
        raise ValueError(f"format {format!r} is not one of {', '.join(FORMATS)}")
    if not paths:
        raise ValueError("no input paths")
    if buckets and (format != "dbsnp" or not output):
        raise ValueError("only a catalogue is stored in buckets")
    if format == "gvcf":
        if limit > 0:
            lines = read_lines_capped(spark, paths, limit)
        elif output:
            lines = read_lines(spark, paths)
        else:
            lines = _dealt_out(spark, paths, partitions)
        return write_panel(lines, output, partitions) if output else panel_from_lines(lines)
    if format == "dbsnp":
        table = parse_catalogue(_dealt_out(spark, paths, partitions))
    else:
        table = spark.read.option("mergeSchema", "true").parquet(*paths)
        table = table.repartition(partitions) if partitions else table
    if buckets:
        write_catalogue(table, output, buckets)
        return table.count()
    return write_counted(table, output, partition_by=partition_by) if output else table
