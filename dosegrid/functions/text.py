"""Numbers held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column) -> Column:
    """Long from text; ``12.0`` reads as 12, anything unreadable as null."""
    with_fraction = F.regexp_extract(text, r"^\s*([+-]?\d+)\.\d*\s*$", 1)
    return F.coalesce(text.try_cast("long"), with_fraction.try_cast("long"))


def rsid_number(text: Column) -> Column:
    """``rs123`` to 123; null when there is no such number."""
    return F.regexp_extract(text, r"rs(\d+)", 1).try_cast("long")
