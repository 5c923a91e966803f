"""Variant catalogue (dbSNP layout): one row per variant and allele."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.functions import accession_code, allele_list, rsid_number, whole_number
from dosegrid.schemas import CATALOGUE, CATALOGUE_RAW
from dosegrid.session import durable, fits_broadcast, measured_bytes
from dosegrid.sources.lines import is_data


class BucketedCatalogue(NamedTuple):
    """The catalogue in buckets of (chr, pos), and again in buckets of (rsID, allele)."""

    by_place: DataFrame
    by_allele: DataFrame


_BUCKETS = {"by_place": ["chr", "pos"], "by_allele": ["rsID", "allele"]}


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """Catalogue from its text lines; contigs without a chromosome code are dropped."""
    fields = lines.where(is_data()).select(F.split("value", "\t").alias("fields"))
    raw = fields.select(
        *(F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(CATALOGUE_RAW))
    )
    placed = raw.withColumn("chr", accession_code(F.col("chr"))).where("chr IS NOT NULL")
    alleles = placed.select(
        "chr",
        whole_number(F.col("pos")).alias("pos"),
        rsid_number(F.col("rsID")).alias("rsID"),
        F.posexplode(allele_list(F.col("ref"), F.col("alt"))).alias("code", "allele"),
        "annot",
    )
    return unique_catalogue(alleles)


def unique_catalogue(alleles: DataFrame) -> DataFrame:
    """One row per (rsID, code): the first by position, allele and annotation.

    Only keys are counted and shuffled; rows whose key is their own stay as they
    are read. The others, normally few, are picked by an aggregate, so copies
    are merged before the exchange and a variant that fills a third of the table
    never meets in one task.
    """
    stored = durable(alleles.select(*CATALOGUE.names))
    keys = ["rsID", "code"]
    counted = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    repeated = durable(counted)
    if not measured_bytes(repeated):
        return stored
    if not fits_broadcast(repeated):
        return _first_rows(stored)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    among = lambda how: stored.alias("a").join(F.broadcast(repeated.alias("r")), same, how)
    return among("left_anti").unionByName(_first_rows(among("left_semi")))


def _first_rows(alleles: DataFrame) -> DataFrame:
    kept = [c for c in CATALOGUE.names if c not in ("rsID", "code")]
    first = alleles.groupBy("rsID", "code").agg(F.min(F.struct(*kept)).alias("row"))
    return first.select("row.chr", "row.pos", "rsID", "code", "row.allele", "row.annot")


def write_catalogue(catalogue: DataFrame, folder: str, buckets: int = 200) -> None:
    """Store a catalogue in buckets of (chr, pos) and of (rsID, allele), sorted within.

    Joins by either then read it where it lies: nothing of it is shuffled.
    """
    for name, keys in _BUCKETS.items():
        table = f"catalogue_{uuid.uuid4().hex}"
        (
            catalogue.repartition(buckets, *keys)
            .write.bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", f"{folder}/{name}")
            .saveAsTable(table)
        )
        catalogue.sparkSession.sql(f"DROP TABLE {table}")  # the files stay
    counted = catalogue.sparkSession.createDataFrame([(buckets,)], "buckets int")
    counted.write.mode("overwrite").parquet(f"{folder}/buckets")


def read_catalogue(spark: SparkSession, folder: str) -> BucketedCatalogue:
    """Catalogue stored by :func:`write_catalogue`."""
    buckets = spark.read.parquet(f"{folder}/buckets").first()["buckets"]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CATALOGUE.fields)
    tables = {}
    for name, keys in _BUCKETS.items():
        table = f"catalogue_{uuid.uuid4().hex}"
        by = ", ".join(keys)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
            f"INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
        )
        tables[name] = spark.table(table)
    return BucketedCatalogue(**tables)
