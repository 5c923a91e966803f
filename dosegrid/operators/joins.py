"""Joins of large tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosegrid.session import broadcast_if_small, fits_broadcast


def left_lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join whose unmatched-by-nature rows do not pile up in one task.

    Rows with a null key match nothing, yet would all hash to one partition;
    a hash of the whole row spreads them. Hot keys that do match are split by
    adaptive execution.
    """
    unmatched = reduce(Column.__or__, (F.col(k).isNull() for k in on))
    content = [c for c in left.columns if c not in on]
    spread = F.pmod(F.xxhash64(*on, *content), F.lit(1 << 20))
    # Always 0, but not a constant: that would be taken out of the join key.
    zero = F.pmod(F.xxhash64(*on), F.lit(1))
    keyed = left.withColumn("_spread", F.when(unmatched, spread).otherwise(F.lit(0)))
    return keyed.join(right.withColumn("_spread", zero), [*on, "_spread"], "left").drop("_spread")


def reduced(large: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``large`` whose key occurs in ``small``.

    With keys that fit a broadcast, ``large`` is filtered where it is read.
    """
    keys = small.select(*on)
    if fits_broadcast(keys, within=small):
        keys = F.broadcast(keys)
    else:
        keys = broadcast_if_small(keys.distinct())
    return large.join(keys, on, "left_semi").select(*large.columns)
