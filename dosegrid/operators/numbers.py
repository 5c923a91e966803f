"""Exact sets of positions and identifiers as bitmaps, to filter large tables where they are read.

A set has a bitmap for each stretch of 32,768 numbers, so its size is bounded by
the length of the genome, or by the largest identifier, however many rows there
are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosegrid.operators.joins import reduced
from dosegrid.session import broadcast_limit, durable, measured_bytes

#: Most bitmaps of a set, of 4 KB each: enough for the positions of a human genome.
MOST_BITMAPS = 100_000
_WORD_BITS = 6  # of a 64-bit word
_BUCKET_BITS = 15  # of a bitmap


def _bits_of(word: Column) -> Column:
    """Places of the bits that are set in a 64-bit word."""
    places = F.array(*(F.lit(i) for i in range(1 << _WORD_BITS)))
    return F.filter(places, lambda i: F.call_function("getbit", word, i) == 1)


def number_set(rows: DataFrame, number: str, group: str | None = None) -> DataFrame | None:
    """Stored (group, bucket, bitmap) of the distinct numbers; nothing if they are too far spread.

    Numbers become bits of 64-bit words on the map side, so copies and hot
    numbers don't move.
    """
    keys = [group] if group else []
    known = rows.select(*keys, F.col(number).cast("long").alias("number")).na.drop()
    word = F.shiftright("number", _WORD_BITS).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(number & {(1 << _WORD_BITS) - 1} as int))")
    words = known.groupBy(*keys, word).agg(F.bit_or(bit).alias("bits"))
    shift = _BUCKET_BITS - _WORD_BITS
    first = F.expr(f"(word & {(1 << shift) - 1}) * {1 << _WORD_BITS}")
    dealt = words.withColumn("bucket", F.shiftright("word", shift)).repartition(*keys, "bucket")
    places = dealt.select(*keys, "bucket", first.alias("first"), F.explode(_bits_of(F.col("bits"))).alias("bit"))
    found = durable(
        places.groupBy(*keys, "bucket").agg(
            F.bitmap_construct_agg(F.col("first") + F.col("bit")).alias("bitmap")
        )
    )
    return found if found.limit(MOST_BITMAPS + 1).count() <= MOST_BITMAPS else None


def within(rows: DataFrame, numbers: DataFrame | None, number: str, group: str | None = None) -> DataFrame:
    """Rows whose number is in the set, filtered in place by a broadcast of its bitmaps."""
    if numbers is None:
        return rows
    place = F.col(f"r.{number}").cast("long")
    at = place.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    byte = F.substring("s.bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
    value = F.ascii(F.decode(byte, "ISO-8859-1"))
    held = F.call_function("getbit", value, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    same = F.shiftright(place, _BUCKET_BITS) == F.col("s.bucket")
    if group:
        same = same & (F.col(f"r.{group}") == F.col(f"s.{group}"))
    joined = rows.alias("r").join(F.broadcast(numbers).alias("s"), same & held, "left_semi")
    return joined.select(*rows.columns)


def reduced_by_number(large: DataFrame, small: DataFrame, number: str) -> DataFrame:
    """Rows of ``large`` whose number occurs in the stored table ``small``.

    Keys beyond the broadcast limit go as bitmaps; only numbers spread too far
    for those are shuffled.
    """
    if measured_bytes(small) > broadcast_limit(small.sparkSession):
        numbers = number_set(small, number)
        if numbers is not None:
            return within(large, numbers, number)
    return reduced(large, small, [number])
