"""Polygenic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosegrid.session import broadcast_if_small, durable, fits_broadcast, one_task

_STUDY = ["trait", "pubmedID"]


def variant_weights(associations: DataFrame) -> DataFrame:
    """Summed effect per (rsID, code) and study; the score is linear in it.

    Code 0 is the reference allele, which sparse rows never hold.
    """
    return (
        associations.where("code > 0 AND rsID IS NOT NULL")
        .groupBy("rsID", "code", *_STUDY)
        .agg(F.sum(F.col("OR").cast("double")).alias("weight"))
    )


def study_scores(sparse: DataFrame, associations: DataFrame) -> DataFrame:
    """(sample_name, trait, pubmedID, prs_score) for samples with any hit."""
    associations = durable(associations)
    weights = broadcast_if_small(variant_weights(associations), within=associations)
    return (
        sparse.where("code > 0")
        .select("sample_name", "rsID", "code", "dose")
        .join(weights, ["rsID", "code"])
        .groupBy("sample_name", *_STUDY)
        .agg(F.sum(F.col("dose").cast("double") * F.col("weight")).alias("prs_score"))
    )


def polygenic_scores(sparse: DataFrame, associations: DataFrame) -> DataFrame:
    """Scores with the dates of their study, sorted by sample and trait."""
    used = one_task(durable(associations.select("rsID", "code", "OR", *_STUDY, "date")))
    dates = used.select(*_STUDY, "date").distinct().alias("d")
    same_study = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in _STUDY]
    return (
        study_scores(sparse, used)
        .alias("s")
        .join(dates, same_study, "left")
        .select("sample_name", "prs_score", "s.trait", "s.pubmedID", "date")
        .orderBy("sample_name", "trait")
    )


def lookup_scores(
    scores: DataFrame, sample_name: str, pubmed_id: int, above: float
) -> DataFrame:
    """Scores of one sample and study above a bound."""
    return scores.where(
        (F.col("sample_name") == sample_name)
        & (F.col("pubmedID") == pubmed_id)
        & (F.col("prs_score") > above)
    )


def with_trait_ids(associations: DataFrame, traits: DataFrame) -> DataFrame:
    """Associations plus ``traitID``, with ids from ``trait_ids``."""
    same_study = [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in _STUDY]
    ids = broadcast_if_small(traits.select(*_STUDY, F.col("j").alias("traitID")), within=traits)
    return (
        associations.alias("a")
        .join(ids.alias("t"), same_study)
        .select(*(f"a.{c}" for c in associations.columns), "traitID")
    )


def index_genotypes(sparse: DataFrame, variants: DataFrame) -> DataFrame:
    """(sample, i, dose) coordinates, with ids from ``variant_ids``."""
    ids = broadcast_if_small(variants.select("rsID", "code", "i"), within=variants)
    return sparse.join(ids, ["rsID", "code"]).select("sample", "i", "dose")


def index_weights(
    associations: DataFrame, variants: DataFrame, traits: DataFrame
) -> DataFrame:
    """(i, j, OR) coordinates of the associations found in the panel."""
    placed = associations.join(variants.select("rsID", "code", "i"), ["rsID", "code"])
    return with_trait_ids(placed, traits).select(
        "i", F.col("traitID").alias("j"), F.col("OR").cast("double").alias("OR")
    )


#: Tasks that the genotypes of one variant are dealt out to where weights are not broadcast.
SALTS = 8


def score_matrix(genotypes: DataFrame, weights: DataFrame) -> DataFrame:
    """Product of two sparse matrices: (sample, i, dose) x (i, j, OR).

    All weights of a variant are one array, so a genotype is joined once however
    many traits the variant has, and becomes a row for each of them afterwards,
    next to the partial sums.
    """
    summed = weights.groupBy("i", "j").agg(F.sum("OR").alias("OR"))
    packed = summed.groupBy("i").agg(F.collect_list(F.struct("j", "OR")).alias("weights"))
    packed = durable(packed)  # a row for each variant, as long as there are traits
    if fits_broadcast(packed):
        joined = genotypes.join(F.broadcast(packed), "i")
    else:
        salt = F.pmod(F.xxhash64("sample"), F.lit(SALTS)).cast("int")
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        spread = packed.withColumn("salt", F.explode(salts))
        joined = genotypes.withColumn("salt", salt).join(spread, ["i", "salt"])
    return (
        joined.select("sample", "dose", F.inline("weights"))
        .groupBy("sample", F.col("j").alias("trait"))
        .agg(F.sum(F.col("dose").cast("double") * F.col("OR")).alias("score"))
    )
