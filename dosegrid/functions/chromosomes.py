"""Chromosome names and accessions as small integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in the order of their codes 1..25.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y", "M"]

# Fixed value: RefSeq accession number of the human mitochondrion.
MITOCHONDRION = 12920

# Fixed value: chromosome number inside a RefSeq accession, with or without a version.
ACCESSION = r"^NC_0+(\d+)(?:\.\d+)?$"


def _code_of(known: list, value: Column) -> Column:
    """1-based place of ``value`` in ``known``; null if it is not there."""
    codes = F.array(F.lit(None).cast("int"), *map(F.lit, range(1, len(known) + 1)))
    return F.get(codes, F.array_position(F.array(*map(F.lit, known)), value))


def chrom_code(name: Column) -> Column:
    """1..22, X=23, Y=24, M=25; null for every other name."""
    return _code_of(CHROMOSOMES, name)


def chrom_code_or_number(name: Column) -> Column:
    """Like :func:`chrom_code`, but other whole numbers pass through."""
    return F.coalesce(chrom_code(name), name.try_cast("int"))


def accession_code(accession: Column) -> Column:
    """Chromosome code of a RefSeq accession; null for unplaced contigs."""
    number = F.regexp_extract(accession, ACCESSION, 1).try_cast("int")
    return _code_of([*range(1, 25), MITOCHONDRION], number)
