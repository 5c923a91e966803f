"""Whole panel to a sparse score matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.operators.alleles import allele_code_map
from dosegrid.operators.associations import (
    attach_codes,
    fill_rsids_two_assemblies,
    recode_associations,
)
from dosegrid.operators.harmonise import attach_rsids
from dosegrid.operators.ids import trait_ids
from dosegrid.operators.joins import reduced
from dosegrid.operators.score import with_trait_ids
from dosegrid.operators.sparse import compact_genotypes, to_sparse
from dosegrid.plans.scoring import weighted_positions
from dosegrid.session import broadcast_if_small, durable, fits_broadcast, one_task
from dosegrid.sources.genotypes import GenotypePanel


def panel_score_matrix(
    panel: GenotypePanel, older: DataFrame, newer: DataFrame, associations: DataFrame
) -> DataFrame:
    """(sample, trait, score) with dense ids, over one rsID per site.

    ``older`` is the assembly that the panel is placed on. Only variants with
    an association can score, so the catalogue and the sites are reduced to
    those before any call is unpacked; use ``variant_ids`` for an index of the
    whole panel.
    """
    filled = durable(fill_rsids_two_assemblies(older, newer, associations))
    coded = one_task(durable(attach_codes(older, filled)))
    known = one_task(durable(reduced(older, coded, ["rsID"])))
    lookup = durable(weighted_positions(older, known, "min_rsid"))
    small = fits_broadcast(lookup)
    calls = panel.calls if small else compact_genotypes(panel.calls)
    sites = attach_rsids(calls, lookup, small=small)
    weights = one_task(durable(recode_associations(coded, allele_code_map(known, sites))))
    placed = with_trait_ids(weights.where("code > 0"), trait_ids(weights))
    summed = durable(
        placed.groupBy("rsID", "code", F.col("traitID").alias("trait")).agg(
            F.sum(F.col("OR").cast("double")).alias("OR")
        )
    )
    return (
        to_sparse(sites, panel.headers)
        .select("sample", "rsID", "code", "dose")
        .join(broadcast_if_small(summed), ["rsID", "code"])
        .groupBy("sample", "trait")
        .agg(F.sum(F.col("dose").cast("double") * F.col("OR")).alias("score"))
    )
