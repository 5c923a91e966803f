"""Trait-association results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.functions import chrom_code, whole_number
from dosegrid.session import broadcast_if_small, durable
from dosegrid.sources.blocks import first_lines
from dosegrid.sources.lines import read_lines

# Fixed value: position inside the variant text column.
POSITION_TEXT = r"chr([\dXYM]+):(\d+)"

# Columns that are used of an association file.
COLUMNS = [
    "SNP_ID_CURRENT", "rallele", "OR or BETA", "CHR_ID", "CHR_POS", "SNPs", "DISEASE/TRAIT",
    "DATE ADDED TO CATALOG", "PUBMEDID",
]


def _place(name: str) -> Column:
    """0-based place of a column in the header of a file."""
    return (F.array_position("columns", name) - 1).cast("int")


def file_layouts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, header, n_columns, places, lacking) of the first line of each file.

    ``places`` tells where the used columns are, ``lacking`` names those that
    are not there. Files without any line are left out.
    """
    heads = first_lines(spark, spark.read.text(list(paths)).inputFiles())
    columns = F.transform(F.split("value", "\t"), lambda c: F.trim(F.replace(c, F.lit('"'))))
    return heads.withColumn("columns", columns).select(
        "source",
        F.col("value").alias("header"),
        F.size("columns").alias("n_columns"),
        F.array(*map(_place, COLUMNS)).alias("places"),
        F.array_join(F.array_except(F.array(*map(F.lit, COLUMNS)), "columns"), ", ").alias("lacking"),
    )


def read_associations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Association rows from tab-separated files with a header.

    Columns go by their names, in whatever order each file has them and among
    whatever others; all files are read together. Fields may be quoted. A file
    whose first line lacks one of the columns, as one without a header does, is
    an error.
    """
    layouts = durable(file_layouts(spark, paths))
    width = layouts.agg(F.max("n_columns")).first()[0]
    if not width:
        raise ValueError("no header line in any of the files")
    if odd := layouts.where("lacking != ''").orderBy("source").first():
        raise ValueError(f"no header with {odd.lacking} in {odd.source}")
    texts = ", ".join(f"c{i} string" for i in range(width))
    lines = read_lines(spark, paths, spread=True).where(F.length("value") > 0)
    known = broadcast_if_small(layouts.select("source", "header", "places"))
    fields = F.from_csv("value", texts, {"sep": "\t"})
    rows = (
        lines.join(known, "source")
        .where("value != header")
        .select("places", fields.alias("fields"))
        .select("places", F.array(*(F.col(f"fields.c{i}") for i in range(width))).alias("fields"))
    )
    return clean_associations(
        rows.select(*(F.get("fields", F.col("places")[i]).alias(c) for i, c in enumerate(COLUMNS)))
    )


def clean_associations(raw: DataFrame) -> DataFrame:
    """Typed associations with a positive effect; gaps in position filled from text."""
    contig = F.coalesce("CHR_ID", F.regexp_extract("SNPs", POSITION_TEXT, 1))
    place = F.coalesce("CHR_POS", F.regexp_extract("SNPs", POSITION_TEXT, 2))
    return raw.select(
        whole_number(F.col("SNP_ID_CURRENT")).alias("rsID"),
        F.col("rallele").alias("alt"),
        F.col("OR or BETA").try_cast("double").alias("OR"),
        chrom_code(contig).alias("chr"),
        whole_number(place).alias("pos"),
        F.col("DISEASE/TRAIT").alias("trait"),
        F.col("DATE ADDED TO CATALOG").try_cast("date").alias("date"),
        whole_number(F.col("PUBMEDID")).alias("pubmedID"),
    ).where(F.col("OR") > 0)
