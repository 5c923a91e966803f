"""Variant identifiers of a panel from the catalogue, by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.functions import rsid_number
from dosegrid.operators.joins import left_lookup
from dosegrid.operators.numbers import number_set, within
from dosegrid.operators.sparse import compact_genotypes
from dosegrid.session import durable, fits_broadcast, remembered
from dosegrid.sources.catalogue import BucketedCatalogue


def position_lookup(catalogue: DataFrame, multi: str = "all") -> DataFrame:
    """(chr, pos, rsID), each once. ``multi="min_rsid"`` keeps one rsID per position.

    The catalogue has a row per allele; joined as it is, it would repeat each
    site and inflate the doses.
    """
    places = catalogue.where("chr IS NOT NULL AND pos IS NOT NULL")
    if multi == "all":
        return places.select("chr", "pos", "rsID").distinct()
    if multi == "min_rsid":
        return places.groupBy("chr", "pos").agg(F.min("rsID").alias("rsID"))
    raise ValueError(f"multi {multi!r} is not one of all, min_rsid")


def refresh_rsids(
    calls: DataFrame,
    catalogue: DataFrame | BucketedCatalogue,
    keep: bool = False,
    multi: str = "all",
) -> DataFrame:
    """Replace the file's variant ids; the old text stays as ``oldID``.

    Sites without a catalogue entry are dropped, or kept with a null ``rsID``.
    A catalogue too large to broadcast is first cut, where it is read, to the
    positions of the panel. If those are too many as well, the panel is cut to
    the positions found, and calls come back in the form of
    ``compact_genotypes``: reference calls are removed before sites move. A
    catalogue in buckets is joined where it lies.
    """
    if isinstance(catalogue, BucketedCatalogue):
        lookup = position_lookup(catalogue.by_place, multi)
        found = calls if keep else _cut(calls, catalogue.by_place)
        sites = compact_genotypes(found) if "genotypes" in found.columns else found
        return attach_rsids(sites, lookup, keep, place_only=True)
    lookup = panel_lookup(calls, catalogue, multi)
    small = fits_broadcast(lookup)
    if not small:
        calls = calls if keep else _cut(calls, lookup)
        calls = compact_genotypes(calls) if "genotypes" in calls.columns else calls
    return attach_rsids(calls, lookup, keep, small)


def _cut(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows at a position that ``known`` has, filtered where they are read."""
    return within(rows, remembered(known, "positions", lambda: number_set(known, "pos", "chr")), "pos", "chr")


def panel_lookup(calls: DataFrame, catalogue: DataFrame, multi: str = "all") -> DataFrame:
    """Stored :func:`position_lookup` for a panel; of a large catalogue only what the panel needs.

    That of a small catalogue is the same for all panels and kept with it.
    """
    places = catalogue.select("chr", "pos", "rsID")
    if fits_broadcast(places, within=catalogue):
        return remembered(
            catalogue, f"lookup {multi}", lambda: durable(position_lookup(places, multi))
        )
    return durable(position_lookup(_cut(places, calls), multi))


def attach_rsids(
    calls: DataFrame,
    lookup: DataFrame,
    keep: bool = False,
    small: bool = False,
    place_only: bool = False,
) -> DataFrame:
    """Join a :func:`position_lookup` to the sites of a panel.

    A small one goes to the sites, so that their calls stay where they are.
    Otherwise both sides are shuffled by position; take ``compact_genotypes``
    of the panel then, and only the non-reference calls move. ``place_only``
    joins by nothing but the position, so that a lookup that lies in buckets of
    it stays there.
    """
    sites = calls.withColumnRenamed("id", "oldID")
    lookup = lookup.hint("broadcast" if small else "merge")
    if keep and not place_only:
        return left_lookup(sites, lookup, ["chr", "pos"])
    if keep:
        unplaced = F.col("chr").isNull() | F.col("pos").isNull()
        placed = sites.where(~unplaced).join(lookup, ["chr", "pos"], "left")
        rsid = F.lit(None).cast("long").alias("rsID")
        return placed.unionByName(sites.where(unplaced).select("*", rsid))
    return sites.join(lookup, ["chr", "pos"])


def own_rsids(calls: DataFrame) -> DataFrame:
    """Use the ids that the file itself carries."""
    return calls.withColumn("rsID", rsid_number(F.col("id"))).withColumnRenamed("id", "oldID")


def rsid_changes(refreshed: DataFrame, known_only: bool = False) -> DataFrame:
    """Sites whose id changed; ``known_only`` leaves out those that had none."""
    changed = refreshed.where(F.col("oldID") != F.concat(F.lit("rs"), F.col("rsID")))
    if known_only:
        changed = changed.where("oldID != '.'")
    return changed.select("contig", "pos", "oldID", "rsID", "ref", "alt")


def split_sites(calls: DataFrame) -> DataFrame:
    """Sites spread over several rows, whose allele codes cannot be told apart."""
    return (
        calls.groupBy("source", "contig", "pos", "ref")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
