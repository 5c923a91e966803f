"""Allele codes of a panel and of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.functions import allele_list
from dosegrid.operators.joins import left_lookup
from dosegrid.operators.numbers import reduced_by_number
from dosegrid.operators.sparse import site_table
from dosegrid.session import broadcast_if_small, durable, fits_broadcast, one_task
from dosegrid.sources.catalogue import BucketedCatalogue


def site_alleles(calls: DataFrame) -> DataFrame:
    """(rsID, code, allele) as coded in the panel, each once."""
    return (
        site_table(calls)
        .where("rsID IS NOT NULL")
        .select("rsID", F.posexplode(allele_list(F.col("ref"), F.col("alt"))).alias("code", "allele"))
        .distinct()
    )


def allele_code_map(catalogue: DataFrame | BucketedCatalogue, calls: DataFrame) -> DataFrame:
    """(rsID, file_code, code): panel code and catalogue code of each shared allele.

    Where the alleles of the panel fit a broadcast, the catalogue is read once
    and does not move. Beyond, it is cut to the variants of the panel by bitmaps
    of their numbers before it moves; one in buckets stays where it is.
    """
    stored = one_task(durable(site_alleles(calls)))
    sites = stored.withColumnRenamed("code", "file_code")
    if isinstance(catalogue, BucketedCatalogue):
        known = catalogue.by_allele
    elif fits_broadcast(stored):
        known, sites = catalogue, F.broadcast(sites)
    else:
        known = reduced_by_number(catalogue, stored, "rsID")
    known = known.select("rsID", "allele", "code")
    return sites.join(known, ["rsID", "allele"]).select("rsID", "file_code", "code").distinct()


def with_allele(sparse: DataFrame, alleles: DataFrame) -> DataFrame:
    """Add the allele text to sparse rows, from a table of (rsID, code, allele).

    Use :func:`site_alleles` for panel codes, the catalogue for catalogue codes.
    """
    named = alleles.groupBy("rsID", "code").agg(F.min("allele").alias("allele"))
    return left_lookup(sparse, broadcast_if_small(durable(named)), ["rsID", "code"])
