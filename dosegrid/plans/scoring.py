"""From files' tables to one score per sample and study."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dosegrid.operators.alleles import allele_code_map
from dosegrid.operators.associations import attach_codes, fill_rsids, recode_associations
from dosegrid.operators.harmonise import attach_rsids, position_lookup
from dosegrid.operators.joins import reduced
from dosegrid.operators.score import polygenic_scores
from dosegrid.operators.sparse import compact_genotypes, to_sparse
from dosegrid.session import durable, fits_broadcast, one_task
from dosegrid.sources.genotypes import GenotypePanel


def prepare_associations(
    catalogue: DataFrame,
    associations: DataFrame,
    code_map: DataFrame | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Associations with rsID and code, in panel codes if a code map is given."""
    filled = durable(fill_rsids(catalogue, durable(associations), overwrite))
    coded = attach_codes(catalogue, filled)
    return coded if code_map is None else recode_associations(coded, code_map)


def weighted_positions(catalogue: DataFrame, known: DataFrame, multi: str = "all") -> DataFrame:
    """:func:`position_lookup` of the variants in ``known``, the catalogue rows with a weight.

    Which rsID of a position is the smallest depends on all rows there, so these
    are taken from the catalogue, cut to the positions that are known.
    """
    if multi == "all":
        return position_lookup(known, multi)
    places = position_lookup(reduced(catalogue, known, ["chr", "pos"]), multi)
    return reduced(places, known, ["rsID"])


def score_run(
    panel: GenotypePanel,
    catalogue: DataFrame,
    associations: DataFrame,
    overwrite: bool = False,
    multi: str = "all",
    **sparse_options: object,
) -> DataFrame:
    """Scores of a whole panel.

    Only variants with a weight can score, so the catalogue and the sites are
    reduced to those before any call is unpacked. The panel is filtered in
    place by a measured broadcast of positions; should these outgrow the limit,
    non-reference calls alone are shuffled.
    """
    coded = one_task(durable(prepare_associations(catalogue, associations, overwrite=overwrite)))
    known = one_task(durable(reduced(catalogue, coded, ["rsID"])))
    lookup = durable(weighted_positions(catalogue, known, multi))
    small = fits_broadcast(lookup)
    calls = panel.calls if small else compact_genotypes(panel.calls)
    sites = attach_rsids(calls, lookup, small=small)
    weights = recode_associations(coded, allele_code_map(known, sites))
    return polygenic_scores(to_sparse(sites, panel.headers, **sparse_options), weights)
