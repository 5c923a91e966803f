"""Preparation of association weights.

Associations are few next to a catalogue or a panel. Where they fit a broadcast
the large side is filtered as it is read and is not shuffled. They are stored
once where they are measured, if they are not yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.operators.harmonise import position_lookup
from dosegrid.operators.joins import left_lookup, reduced
from dosegrid.session import broadcast_if_small, durable, one_task, remembered
from dosegrid.sources.catalogue import BucketedCatalogue

_KEYS = ["trait", "rsID", "alt"]


def unique_associations(associations: DataFrame) -> DataFrame:
    """One row per (trait, rsID, alt), independent of row order.

    Latest date first, then lowest study, highest effect, lowest remaining
    columns; nulls last. Taken by an aggregate, so a hot key is reduced before
    the exchange and never sorted as a group.
    """
    rest = [c for c in associations.columns if c not in [*_KEYS, "date", "pubmedID", "OR"]]
    best = F.max(
        F.struct(
            "date",
            (-F.col("pubmedID")).alias("pubmedID"),
            "OR",
            *((-F.col(c)).alias(c) for c in rest),
        )
    ).alias("row")
    flipped = {"pubmedID", *rest}
    return (
        associations.groupBy(*_KEYS)
        .agg(best)
        .select(
            *(
                F.col(c)
                if c in _KEYS
                else (-F.col(f"row.{c}") if c in flipped else F.col(f"row.{c}")).alias(c)
                for c in associations.columns
            )
        )
    )


def _found(catalogue: DataFrame, associations: DataFrame) -> DataFrame:
    """(chr, pos, found) for the positions of the (stored) associations only."""
    places = position_lookup(reduced(catalogue, associations, ["chr", "pos"]))
    return places.withColumnRenamed("rsID", "found")


def fill_rsids(
    catalogue: DataFrame, associations: DataFrame, overwrite: bool = False
) -> DataFrame:
    """Take missing rsIDs from the catalogue by position, or all with ``overwrite``."""
    associations = one_task(durable(associations))
    joined = left_lookup(associations, _found(catalogue, associations), ["chr", "pos"])
    rsid = F.col("found") if overwrite else F.coalesce("rsID", "found")
    return unique_associations(
        joined.withColumn("rsID", rsid).select(*associations.columns)
    )


def fill_rsids_two_assemblies(
    older: DataFrame, newer: DataFrame, associations: DataFrame
) -> DataFrame:
    """Missing rsIDs from the older assembly, then from the newer one."""
    filled = associations = one_task(durable(associations))
    for catalogue in (older, newer):
        filled = (
            left_lookup(filled, _found(catalogue, associations), ["chr", "pos"])
            .withColumn("rsID", F.coalesce("rsID", "found"))
            .drop("found")
        )
    return unique_associations(
        filled.select("trait", "rsID", "alt", "OR", "pubmedID", "date")
    )


def attach_codes(
    catalogue: DataFrame | BucketedCatalogue, associations: DataFrame
) -> DataFrame:
    """Add the catalogue code of the risk allele; rows with any null are dropped."""
    associations = durable(associations)
    if isinstance(catalogue, BucketedCatalogue):
        catalogue = catalogue.by_allele
    coded = catalogue.select("rsID", F.col("allele").alias("alt"), "code")
    return (
        broadcast_if_small(associations.na.drop(), within=associations)
        .join(coded, ["rsID", "alt"])
        .na.drop()
        .select(*associations.columns, "code")
    )


def recode_associations(associations: DataFrame, code_map: DataFrame) -> DataFrame:
    """Catalogue codes to panel codes; what the panel lacks becomes 0."""
    codes = one_task(remembered(code_map, "distinct", lambda: durable(code_map.distinct())))
    return (
        left_lookup(associations, broadcast_if_small(codes), ["rsID", "code"])
        .withColumn("code", F.coalesce("file_code", F.lit(0)))
        .select(*associations.columns)
        .distinct()
    )


def restrict_to_panel(associations: DataFrame, variants: DataFrame) -> DataFrame:
    """Associations of variants that occur in the panel, by (rsID, code).

    ``variants`` may be a sparse table: it is filtered to the associated
    variants before their occurrences are made distinct.
    """
    associations = durable(associations)
    present = reduced(variants.select("rsID", "code"), associations, ["rsID", "code"])
    return associations.join(present.distinct(), ["rsID", "code"], "left_semi").select(
        *associations.columns
    )
