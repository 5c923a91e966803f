"""Allele lists and genotype calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls that carry no non-reference allele.
REFERENCE_CELLS = ["0|0", "0/0", ".|.", "./.", "0", "."]


# The same with sub-fields, none of which has a sign of a phased call.
_REFERENCE_WITH_FIELDS = r"\A(0[|/]0|[.][|/][.]|[0.]):[^|]*\z"

# Two codes of one digit, with such sub-fields or without.
_TWO_DIGITS = r"\A[0-9][|/][0-9](:[^|]*)?\z"


def allele_list(ref: Column, alt: Column) -> Column:
    """Alleles of a site in code order; the reference allele has code 0."""
    return F.split(F.concat_ws(",", ref, alt), ",")


def reference_cells(cell: Column) -> Column:
    """True for the common calls without an alternate; cheap text comparison."""
    with_fields = F.contains(cell, F.lit(":")) & cell.rlike(_REFERENCE_WITH_FIELDS)
    return cell.isNull() | cell.isin(REFERENCE_CELLS) | with_fields


def two_codes(cell: Column, phased_only: bool = False) -> tuple[Column, Column]:
    """First and second allele code of a call; what is missing reads as 0.

    ``phased_only`` reads ``|`` calls without sub-fields only.
    """
    if not phased_only:
        cell = F.translate(F.substring_index(cell, ":", 1), "/", "|")
    # substring_index avoids an array per call, which splitting would build.
    first = F.substring_index(cell, "|", 1)
    second = F.when(
        F.instr(cell, "|") > 0, F.substring_index(F.substring_index(cell, "|", 2), "|", -1)
    )
    return tuple(F.coalesce(c.try_cast("int"), F.lit(0)) for c in (first, second))


def _packed_call(cell: Column, i: Column) -> Column:
    """Position and codes as :func:`two_codes` reads them, by default (a, b) and phased only (pa, pb).

    Calls of two digits, nearly all there are, are read by their places: functions on array
    elements are interpreted, and many small steps for each call add up.
    """

    def digit(at: int) -> Column:
        return F.coalesce(F.ascii(F.substring(cell, at, 1)) - 48, F.lit(0))

    def call(*codes: Column) -> Column:
        named = zip(("position", "a", "b", "pa", "pb"), (i, *codes))
        return F.struct(*(c.alias(name) for name, c in named))

    phased = F.substring(cell, 2, 1) == "|"
    plain = phased & (F.length(cell) == 3)
    first = F.when(phased, digit(1)).otherwise(0)
    second = F.when(plain, digit(3)).otherwise(0)
    other = call(*two_codes(cell), *two_codes(cell, phased_only=True))
    return F.when(cell.rlike(_TWO_DIGITS), call(digit(1), digit(3), first, second)).otherwise(other)


def pack_calls(calls: DataFrame) -> DataFrame:
    """``alternates`` and ``n_calls`` in place of the text in ``genotypes``.

    Text is parsed here only, and only of calls that are not plain reference.
    """

    def coded(cell: Column, i: Column) -> Column:
        return F.when(~reference_cells(cell), _packed_call(cell, i))

    found = F.array_compact(F.transform("genotypes", coded))
    found = F.filter(found, lambda c: F.greatest(c["a"], c["b"], c["pa"], c["pb"]) > 0)
    return calls.withColumns({"alternates": found, "n_calls": F.size("genotypes")}).drop("genotypes")
