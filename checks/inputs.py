"""Genotypes, catalogues and associations derived from the relational tables.

Every part is a site, every supplier a sample. Suppliers form cohorts of 100,
one genotype file each, and a site is called in one cohort, so the number of
calls grows in step with the tables. The SQL texts run in Spark and in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.functions import chrom_code
from dosegrid.operators.sparse import compact_genotypes
from dosegrid.schemas import CALLS, VCF_FIXED
from dosegrid.session import durable
from dosegrid.sources import GenotypePanel, clean_associations, header_table, parse_catalogue

COHORT_SIZE = 100

# Columns used of the tables.
TABLES = {
    "part": "p_partkey long, p_type string, p_size int",
    "supplier": "s_suppkey long, s_name string",
}

# Sites, and the file (cohort) that holds each of them.
SITES = f"""
SELECT p_partkey AS k,
 'cohort_' || lpad(CAST(p_partkey % (SELECT CAST(floor(max(s_suppkey) / {COHORT_SIZE}) AS BIGINT) + 1 FROM supplier) AS STRING), 6, '0') AS source,
 CASE WHEN p_partkey % 25 = 22 THEN 'X' WHEN p_partkey % 25 = 23 THEN 'Y' WHEN p_partkey % 25 = 24 THEN 'M' ELSE CAST(p_partkey % 25 + 1 AS STRING) END AS contig,
 10000 + 10 * p_partkey AS pos,
 CASE WHEN p_partkey % 6 = 0 THEN '.' ELSE 'rs' || CAST(500000 + p_partkey AS STRING) END AS id,
 substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS ref,
 substr('CGTA', CAST(p_partkey % 4 + 1 AS INT), 1) || CASE WHEN p_partkey % 7 = 0 THEN ',' || substr('GTAC', CAST(p_partkey % 4 + 1 AS INT), 1) ELSE '' END AS alt,
 CASE WHEN p_partkey % 17 = 0 THEN '.' ELSE CAST(2 * p_size AS STRING) || '.5' END AS qual,
 CASE WHEN p_partkey % 5 = 0 THEN 'q10' ELSE 'PASS' END AS filter
FROM part
"""

SAMPLES = f"""
SELECT 'cohort_' || lpad(CAST(CAST(floor(s_suppkey / {COHORT_SIZE}) AS BIGINT) AS STRING), 6, '0') AS source,
 s_suppkey, s_name AS sample_name
FROM supplier
"""

# The same samples in smaller files that overlap: a sample is in two of them at most, and every
# fourth site is too.
OVERLAP_SIZE = 30
_FILE_NAME = "'part_' || lpad(CAST({f} AS STRING), 6, '0')"
OVERLAP_SAMPLES = f"""
SELECT {_FILE_NAME.format(f='f')} AS source, s_suppkey, s_name AS sample_name FROM (
 SELECT s_suppkey, s_name, CAST(floor(s_suppkey / {OVERLAP_SIZE}) AS BIGINT) AS f FROM supplier
 UNION
 SELECT s_suppkey, s_name, CAST(floor((s_suppkey + 10) / {OVERLAP_SIZE}) AS BIGINT) FROM supplier) a
"""
_FILES = f"(SELECT CAST(floor((max(s_suppkey) + 10) / {OVERLAP_SIZE}) AS BIGINT) + 1 FROM supplier)"
OVERLAP_SITES = f"""
SELECT k, {_FILE_NAME.format(f='f')} AS source FROM (
 SELECT p_partkey AS k, p_partkey % {_FILES} AS f FROM part
 UNION
 SELECT p_partkey, (p_partkey + 1) % {_FILES} FROM part WHERE p_partkey % 4 = 0) a
"""

# Two catalogue records per site. The first sits beside the site for every
# 11th, the second at the site for every 13th; unplaced contigs for every 19th.
CATALOGUE_RAW = """
SELECT CASE WHEN k % 19 = 0 THEN 'NT_113889.1' WHEN k % 25 = 24 THEN 'NC_012920.1' ELSE 'NC_0000' || lpad(CAST(k % 25 + 1 AS STRING), 2, '0') || '.10' END AS chr,
 CASE WHEN k % 11 = 0 THEN pos + 3 ELSE pos END AS pos,
 'rs' || CAST(1000000 + k AS STRING) AS rsID, ref,
 CASE WHEN k % 7 = 0 THEN substr('GTAC', CAST(k % 4 + 1 AS INT), 1) || ',' || substr('CGTA', CAST(k % 4 + 1 AS INT), 1) ELSE alt END AS alt,
 '.' AS q1, '.' AS q2, 'RS=' || CAST(1000000 + k AS STRING) AS annot
FROM sites
UNION ALL
SELECT 'NC_0000' || lpad(CAST(k % 25 + 1 AS STRING), 2, '0') || '.10',
 CASE WHEN k % 13 = 0 THEN pos ELSE pos + 5 END,
 'rs' || CAST(9000000 + k AS STRING), ref, alt, '.', '.', 'RS2'
FROM sites
"""

# The other assembly knows each site under its own number, at its position.
CATALOGUE_RAW_NEWER = """
SELECT CASE WHEN k % 25 = 24 THEN 'NC_012920.1' ELSE 'NC_0000' || lpad(CAST(k % 25 + 1 AS STRING), 2, '0') || '.11' END AS chr,
 pos, 'rs' || CAST(1000000 + k AS STRING) AS rsID, ref, alt, '.' AS q1, '.' AS q2, 'B2' AS annot
FROM sites
"""

ASSOCIATIONS_RAW = """
SELECT CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(1000000 + k AS STRING) END AS snp_id_current,
 CASE WHEN k % 8 IN (1, 2) THEN substr('CGTA', CAST(k % 4 + 1 AS INT), 1) WHEN k % 8 = 5 THEN ref ELSE substr('GTAC', CAST(k % 4 + 1 AS INT), 1) END AS rallele,
 CASE WHEN k % 20 = 2 THEN NULL WHEN k % 20 = 3 THEN '0' ELSE CAST(CAST(p_size % 8 + 1 AS DOUBLE) * 0.25E0 AS STRING) END AS or_or_beta,
 CASE WHEN k % 9 = 0 THEN NULL ELSE contig END AS chr_id,
 CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(pos AS STRING) END AS chr_pos,
 'chr' || contig || ':' || CAST(pos AS STRING) AS snps,
 'trait ' || p_type AS disease_trait,
 '2023-0' || CAST(k % 9 + 1 AS STRING) || '-15' AS date_added,
 CAST(25000000 + k % 3 AS STRING) AS pubmedid
FROM sites JOIN part ON k = p_partkey
"""

# Column names of an association file, for the columns of ASSOCIATIONS_RAW.
ASSOCIATION_COLUMNS = {
    "snp_id_current": "SNP_ID_CURRENT",
    "rallele": "rallele",
    "or_or_beta": "OR or BETA",
    "chr_id": "CHR_ID",
    "chr_pos": "CHR_POS",
    "snps": "SNPs",
    "disease_trait": "DISEASE/TRAIT",
    "date_added": "DATE ADDED TO CATALOG",
    "pubmedid": "PUBMEDID",
}


def call_sql(k: str, s: str) -> str:
    """Call of site ``k`` for sample ``s``: phased, unphased, missing, haploid, sub-field."""
    a = (
        f"CASE WHEN ({k} * 7 + {s} * 3) % 10 = 0 THEN '1' "
        f"WHEN {k} % 7 = 0 AND ({k} + {s}) % 9 = 0 THEN '2' ELSE '0' END"
    )
    b = f"CASE WHEN ({k} * 5 + {s} * 11) % 8 = 0 THEN '1' ELSE '0' END"
    return (
        f"CASE WHEN ({k} + {s}) % 29 = 0 THEN './.' "
        f"WHEN ({k} + {s}) % 31 = 0 THEN {a} "
        f"WHEN ({k} + {s}) % 6 = 0 THEN {a} || '/' || {b} "
        f"WHEN ({k} + {s}) % 37 = 0 THEN {a} || '|' || {b} || ':35' "
        f"ELSE {a} || '|' || {b} END"
    )


def _register(spark: SparkSession, sf_dir: str) -> None:
    for table, columns in TABLES.items():
        path = f"{sf_dir}/{table}.parquet"
        spark.read.schema(columns).parquet(path).createOrReplaceTempView(table)
    # A site becomes several lines, or a row of many calls: use all cores for the small table.
    dealt = spark.sql(SITES).repartition(spark.sparkContext.defaultParallelism, "k")
    dealt.createOrReplaceTempView("sites")
    spark.sql(SAMPLES).createOrReplaceTempView("samples")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir)
    return spark.table("sites")


def _cohorts(spark: SparkSession) -> DataFrame:
    """(source, who): the at most COHORT_SIZE suppliers of each cohort, in key order."""
    return (
        spark.table("samples")
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "sample_name"))).alias("who"))
    )


# Tables already stored by this application, by folder and name.
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]):
    """The table as a load step leaves it: written once, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = durable(build())
    return _STORED[key]


def panel(spark: SparkSession, sf_dir: str) -> GenotypePanel:
    """All sites with the calls of their cohort, stored on first use."""
    derived = derive_panel(spark, sf_dir)
    return GenotypePanel(
        _stored(spark, sf_dir, "calls", lambda: derived.calls),
        _stored(spark, sf_dir, "headers", lambda: derived.headers),
    )


def packed_panel(spark: SparkSession, sf_dir: str) -> GenotypePanel:
    """The panel with its calls packed, as ``write_panel`` stores them."""
    calls = _stored(spark, sf_dir, "packed", lambda: compact_genotypes(derive_panel(spark, sf_dir).calls))
    return GenotypePanel(calls, _stored(spark, sf_dir, "headers", lambda: derive_panel(spark, sf_dir).headers))


def derive_panel(spark: SparkSession, sf_dir: str) -> GenotypePanel:
    """The panel computed from the tables."""
    _register(spark, sf_dir)
    cohorts = _cohorts(spark)
    calls = (
        spark.table("sites")
        .join(cohorts, "source")
        .select(
            "source",
            "contig",
            chrom_code(F.col("contig")).alias("chr"),
            F.col("pos").cast("long").alias("pos"),
            "id",
            "ref",
            "alt",
            "qual",
            "filter",
            F.lit(".").alias("info"),
            F.lit("GT").alias("format"),
            F.expr(f"transform(who, w -> {call_sql('k', 'w.s_suppkey')})").alias("genotypes"),
        )
        .select(*CALLS.names)
    )
    return GenotypePanel(calls, header_table(_header_lines(cohorts)))


def _header_lines(cohorts: DataFrame) -> DataFrame:
    names = F.array_join(F.col("who.sample_name"), "\t")
    return cohorts.select(
        "source", F.concat(F.lit("#" + "\t".join(VCF_FIXED) + "\t"), names).alias("value")
    )


def genotype_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as text lines of one file per cohort."""
    calls = panel(spark, sf_dir).calls
    cohorts = _cohorts(spark)
    meta = cohorts.select("source", F.lit("##fileformat=VCFv4.2").alias("value"))
    fields = ["contig", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter"]
    data = calls.select(
        "source", F.concat_ws("\t", *fields, "info", "format", "genotypes").alias("value")
    )
    return meta.union(_header_lines(cohorts)).union(data)


def overlapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of files that share samples and sites."""
    _register(spark, sf_dir)
    who = F.sort_array(F.collect_list(F.struct("s_suppkey", "sample_name"))).alias("who")
    files = spark.sql(OVERLAP_SAMPLES).groupBy("source").agg(who)
    placed = spark.table("sites").drop("source").join(spark.sql(OVERLAP_SITES), "k").join(files, "source")
    calls = F.expr(f"transform(who, w -> {call_sql('k', 'w.s_suppkey')})")
    fields = ["contig", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter"]
    data = placed.select(
        "source", F.concat_ws("\t", *fields, F.lit("."), F.lit("GT"), calls).alias("value")
    )
    return _header_lines(files).union(data)


def catalogue_lines(spark: SparkSession, sf_dir: str, newer: bool = False) -> DataFrame:
    _register(spark, sf_dir)
    raw = spark.sql(CATALOGUE_RAW_NEWER if newer else CATALOGUE_RAW)
    return raw.select(
        F.lit("catalogue").alias("source"),
        F.concat_ws("\t", *(F.col(c).cast("string") for c in raw.columns)).alias("value"),
    )


def catalogue(spark: SparkSession, sf_dir: str, newer: bool = False) -> DataFrame:
    """Parsed catalogue, stored on first use."""
    return _stored(
        spark,
        sf_dir,
        "newer" if newer else "catalogue",
        lambda: parse_catalogue(catalogue_lines(spark, sf_dir, newer)),
    )


def associations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir)
    return spark.sql(ASSOCIATIONS_RAW).withColumnsRenamed(ASSOCIATION_COLUMNS)


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed associations, stored on first use."""
    return _stored(
        spark, sf_dir, "associations", lambda: clean_associations(associations_raw(spark, sf_dir))
    )
