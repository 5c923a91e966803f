"""Dense genotype arrays to sparse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosegrid.functions import pack_calls
from dosegrid.operators.joins import left_lookup
from dosegrid.schemas import SPARSE
from dosegrid.session import (
    broadcast_if_small,
    broadcast_limit,
    durable,
    measured_bytes,
    one_task,
    remembered,
)
from dosegrid.sources.genotypes import sample_table, single_panel_samples

_SITE = ["rsID", "chr", "pos"]


def site_table(calls: DataFrame) -> DataFrame:
    """Stored site columns of a panel with rsIDs, for the passes that need no calls."""
    columns = ["contig", *_SITE, "ref", "alt"]
    return remembered(calls, "sites", lambda: one_task(durable(calls.select(*columns))))


def quality_filter(
    calls: DataFrame, min_quality: float = 0, pass_only: bool = False
) -> DataFrame:
    """Keep sites by quality (a missing one fails) and by filter status."""
    if min_quality > 0:
        calls = calls.where(F.col("qual").try_cast("double") >= min_quality)
    if pass_only:
        calls = calls.where(F.col("filter") == "PASS")
    return calls


def compact_genotypes(calls: DataFrame) -> DataFrame:
    """Replace ``genotypes`` by ``alternates``: position and codes of the non-reference calls.

    A narrow step to take before anything that moves whole sites, and the form
    in which panels are stored. Codes are kept as read by default (a, b) and as
    ``phased_only`` reads them (pa, pb), so sub-fields go here; ``n_calls``
    keeps the number of calls.
    """
    return calls if "alternates" in calls.columns else pack_calls(calls)


def nonreference_cells(
    calls: DataFrame, phased_only: bool = False, who: str | None = None
) -> DataFrame:
    """One row per call that is not plain reference: site columns, position, codes a and b.

    ``who`` may name an array of sample structs by position; the sample of a
    call is picked from it as the call becomes a row.
    """
    chosen = ("pa", "pb") if phased_only else ("a", "b")
    compact = compact_genotypes(calls)
    kept = [c for c in compact.columns if c not in ("alternates", "n_calls", who)]
    cells = compact.select(*kept, *([who] if who else []), F.inline("alternates"))
    named = [F.get(F.col(who), F.col("position"))[c].alias(c) for c in ("sample", "sample_name")] if who else []
    codes = [F.col(c).alias(name) for c, name in zip(chosen, ("a", "b"))]
    return cells.select(*kept, "position", *codes, *named)


def _named_cells(calls: DataFrame, headers: DataFrame, phased_only: bool) -> DataFrame:
    """Non-reference calls with the sample they belong to.

    A site with more calls than its file has names is an error, and so is a
    name that a header lists twice. The names of a file go to the executors
    once and are picked by position. Should all names together exceed the
    broadcast limit, cells are joined to the names instead, which happens
    after the reference calls are gone.
    """
    headers = one_task(durable(headers))
    limit = broadcast_limit(headers.sparkSession)
    names_size = F.octet_length(F.array_join("samples", "")) + 64 * F.size("samples")
    twice = F.size(F.array_distinct("samples")) < F.size("samples")
    panels, names_bytes, files_bytes, whole_bytes, unclear = (
        headers.groupBy("panel")
        .agg(
            F.first(names_size).alias("names"),
            F.sum(F.octet_length("source") + F.lit(96)).alias("files"),
            F.sum(names_size).alias("whole"),
            F.min(F.when(twice, F.col("source"))).alias("twice"),
        )
        .agg(F.count(F.lit(1)), F.sum("names"), F.sum("files"), F.sum("whole"), F.min("twice"))
        .first()
    )
    if not panels:
        raise ValueError("no #CHROM line in any of the files")
    if unclear is not None:
        raise ValueError(f"a sample is listed twice in {unclear}")
    files = headers.select("source", "panel", F.size("samples").alias("n_samples"))
    samples = single_panel_samples(headers) if panels == 1 else sample_table(headers)
    names = samples.groupBy("panel").agg(
        F.sort_array(F.collect_list(F.struct("position", "sample", "sample_name"))).alias("who")
    )
    by_file = files_bytes + whole_bytes <= limit  # a list for each file, in one broadcast
    if by_file:
        files = files.join(names, "panel")
    if files_bytes <= limit:
        files = F.broadcast(files)
    missing = F.raise_error(F.concat(F.lit("no #CHROM line in "), F.col("source")))
    place = F.concat_ws(":", "contig", F.col("pos").cast("string"))
    surplus = F.raise_error(
        F.concat(F.lit("more calls than samples in "), F.col("source"), F.lit(" at "), place)
    )
    # Files without a header are found out by a part of the calls themselves, or of the join key,
    # and so are sites with too many calls, also those without any to show.
    wanted = F.when(F.col("n_calls") > F.col("n_samples"), surplus).otherwise(F.col("alternates"))
    checked = compact_genotypes(calls).join(files, "source", "left")
    if by_file:
        known = F.when(F.col("panel").isNull(), missing).otherwise(wanted)
        named = checked.withColumn("alternates", known).drop("n_samples")
        return nonreference_cells(named, phased_only, "who")
    checked = checked.withColumns(
        {"panel": F.coalesce("panel", missing), "alternates": wanted}
    ).drop("n_samples")
    if names_bytes > limit:
        cells = nonreference_cells(checked, phased_only)
        return cells.join(samples, ["panel", "position"])
    return nonreference_cells(checked.join(F.broadcast(names), "panel"), phased_only, "who")


def to_coordinates(
    calls: DataFrame, headers: DataFrame, phased_only: bool = False
) -> DataFrame:
    """(sample, rsID, haplotype, code): the non-zero entries of the two matrices."""
    _require_rsids(calls)
    kept = calls.select("source", "contig", "pos", "rsID", *_payload(calls))
    cells = _named_cells(kept, headers, phased_only)
    pair = F.array(
        F.struct(F.lit(1).alias("haplotype"), F.col("a").alias("code")),
        F.struct(F.lit(2).alias("haplotype"), F.col("b").alias("code")),
    )
    return cells.select("sample", "rsID", F.inline(pair)).where("code > 0")


def _payload(calls: DataFrame) -> list[str]:
    return ["alternates", "n_calls"] if "alternates" in calls.columns else ["genotypes"]


def _require_rsids(calls: DataFrame) -> None:
    if "rsID" not in calls.columns:
        raise ValueError("calls have no rsID column: use refresh_rsids or own_rsids first")


def _site_key() -> list[Column]:
    """rsID where known, else the position."""
    unknown = F.col("rsID").isNull()
    return [
        F.col("rsID").alias("key_rsid"),
        F.when(unknown, F.col("contig")).alias("key_contig"),
        F.when(unknown, F.col("pos")).alias("key_pos"),
    ]


_KEY = ["key_rsid", "key_contig", "key_pos"]


def repeated_sites(calls: DataFrame) -> DataFrame:
    """Keys of the sites that occur in more than one input row."""
    counted = calls.select(*_site_key()).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").drop("n")


def to_sparse(
    calls: DataFrame,
    headers: DataFrame,
    min_quality: float = 0,
    pass_only: bool = False,
    phased_only: bool = False,
    merge_duplicate_sites: bool = True,
    code_map: DataFrame | None = None,
) -> DataFrame:
    """One row per sample, variant and non-reference allele, with its dose.

    Both alleles of a call come from one input row, so they are counted there
    and nothing moves. Only sites found in several rows (by rsID, or by
    position where it is null) need an aggregate: their keys are found first,
    by a count over the keys alone, and just those sites are shuffled.
    """
    _require_rsids(calls)
    kept = quality_filter(calls, min_quality, pass_only).select(
        "source", "contig", *_SITE, *_payload(calls)
    )
    if merge_duplicate_sites:
        whole = min_quality <= 0 and not pass_only and {"ref", "alt"} <= set(calls.columns)
        sparse = _merged(kept, site_table(calls) if whole else kept, headers, phased_only)
    else:
        sparse = _rows(_named_cells(kept, headers, phased_only))
    sparse = sparse.select(*SPARSE.names)
    return sparse if code_map is None else recode_sparse(sparse, code_map)


def _rows(cells: DataFrame) -> DataFrame:
    """One row per allele of a call: homozygous 2, heterozygous 1 each."""
    kept = [c for c in cells.columns if c not in ("a", "b")]
    alleles = cells.select(*cells.columns, F.explode(F.array(F.lit(1), F.lit(2))).alias("nth"))
    same, first = F.col("a") == F.col("b"), F.col("nth") == 1
    code = F.when(first, F.col("a")).when(~same, F.col("b")).otherwise(0)
    dose = F.when(first & same, 2).otherwise(1)
    return alleles.select(*kept, code.alias("code"), dose.alias("dose")).where("code > 0")


def _merged(
    kept: DataFrame, sites: DataFrame, headers: DataFrame, phased_only: bool
) -> DataFrame:
    """Sparse rows, those of a site in several input rows summed.

    Such sites are marked by a broadcast of their keys in the one pass over the
    calls; its rows are stored by that mark, and the marked part is summed.
    """
    repeated = durable(repeated_sites(sites))
    size = measured_bytes(repeated)
    if size == 0:
        return _rows(_named_cells(kept, headers, phased_only))
    if size > broadcast_limit(kept.sparkSession):
        return _sum_doses(_rows(_named_cells(kept, headers, phased_only)))
    keyed = kept.withColumns(dict(zip(_KEY, _site_key()))).alias("s")
    keys = F.broadcast(repeated.withColumn("repeated", F.lit(True)).alias("r"))
    match = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in _KEY]
    mark = F.coalesce("repeated", F.lit(False)).alias("repeated")
    marked = keyed.join(keys, match, "left").select(*(f"s.{c}" for c in kept.columns), mark)
    rows = _rows(_named_cells(marked, headers, phased_only))
    columns = [*SPARSE.names, "contig", "repeated"]
    stored = durable(rows.select(*columns), partition_by=["repeated"])
    once = stored.where("NOT repeated").select(*SPARSE.names)
    return once.unionByName(_sum_doses(stored.where("repeated")))


def _sum_doses(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumns(dict(zip(_KEY, _site_key())))
        .groupBy("sample", "sample_name", *_KEY, "code")
        .agg(
            F.min("chr").alias("chr"),
            F.min("pos").alias("pos"),
            F.sum("dose").cast("int").alias("dose"),
        )
        .withColumnRenamed("key_rsid", "rsID")
        .select(*SPARSE.names)
    )


def recode_sparse(sparse: DataFrame, code_map: DataFrame) -> DataFrame:
    """Panel codes to catalogue codes; an allele the catalogue lacks becomes 0."""
    mapping = broadcast_if_small(remembered(code_map, "distinct", lambda: durable(code_map.distinct())))
    return (
        left_lookup(sparse.withColumnRenamed("code", "file_code"), mapping, ["rsID", "file_code"])
        .withColumn("code", F.coalesce("code", F.lit(0)))
        .select(*sparse.columns)
    )
