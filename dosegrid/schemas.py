"""Column layouts of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

VCF_FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]

CATALOGUE_RAW = ["chr", "pos", "rsID", "ref", "alt", "q1", "q2", "annot"]

# Partition value under which a stored panel keeps its header rows.
HEADER_CHR = -1

CALLS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("contig", T.StringType()),
        T.StructField("chr", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("info", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("genotypes", T.ArrayType(T.StringType())),
    ]
)

# A call that is not plain reference: its place among the samples, its codes as read by default
# and as plain phased calls.
CALL = T.StructType(
    [T.StructField(name, T.IntegerType(), False) for name in ("position", "a", "b", "pa", "pb")]
)

# A stored panel holds its calls packed; the samples of its header rows are in ``genotypes``.
STORED_CALLS = T.StructType(
    [
        *CALLS.fields,
        T.StructField("alternates", T.ArrayType(CALL, False)),
        T.StructField("n_calls", T.IntegerType()),
    ]
)

CATALOGUE = T.StructType(
    [
        T.StructField("chr", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("rsID", T.LongType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("allele", T.StringType()),
        T.StructField("annot", T.StringType()),
    ]
)

CODE_MAP = T.StructType(
    [
        T.StructField("rsID", T.LongType()),
        T.StructField("file_code", T.IntegerType()),
        T.StructField("code", T.IntegerType()),
    ]
)

SPARSE = T.StructType(
    [
        T.StructField("sample", T.LongType()),
        T.StructField("sample_name", T.StringType()),
        T.StructField("rsID", T.LongType()),
        T.StructField("chr", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("dose", T.IntegerType()),
    ]
)

ASSOCIATIONS = T.StructType(
    [
        T.StructField("rsID", T.LongType()),
        T.StructField("alt", T.StringType()),
        T.StructField("OR", T.DoubleType()),
        T.StructField("chr", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("trait", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("pubmedID", T.LongType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("sample_name", T.StringType()),
        T.StructField("prs_score", T.DoubleType()),
        T.StructField("trait", T.StringType()),
        T.StructField("pubmedID", T.LongType()),
        T.StructField("date", T.DateType()),
    ]
)
