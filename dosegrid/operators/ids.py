"""Dense integer ids without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosegrid.session import durable, fits_one_task, one_task

# monotonically_increasing_id keeps the row number of a partition in 33 bits.
_ROW_BITS = (1 << 33) - 1


def ordered_ids(
    rows: DataFrame, order: list[Column], name: str, of: DataFrame | None = None
) -> DataFrame:
    """``rows`` plus their 0-based position in the total order ``order``.

    ``order`` must tell all rows apart. Rows are range-partitioned and sorted,
    and stored so that partition and position stay fixed; an id is the position
    within the partition plus the sizes of the partitions before it. Only these
    sizes, one row per partition, are ever summed in one place. If ``rows`` are
    made ``of`` a small stored table, one task numbers them.
    """
    if of is not None and fits_one_task(of):
        place = F.row_number().over(Window.orderBy(*order)) - 1
        return rows.withColumn(name, place.cast("long"))
    placed = durable(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
            }
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_row") + F.col("_start"))
        .drop("_part", "_row", "_start")
    )


def frequency_ids(rows: DataFrame, keys: list[str], separator: str, name: str) -> DataFrame:
    """(keys, key, n, id) for the distinct keys, most frequent first.

    ``key`` joins the key columns as text; it breaks ties alphabetically. Keys
    of a small stored table are numbered by one task.
    """
    counted = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("key", F.concat_ws(separator, *keys))
    )
    order = [F.desc("n"), F.asc("key"), *map(F.asc, keys)]
    numbered = ordered_ids(counted, order, name, of=rows)
    return durable(numbered) if fits_one_task(rows) else numbered


def variant_ids(sparse: DataFrame) -> DataFrame:
    """(rsID, code, n, key, i) over the variants of a sparse table."""
    return frequency_ids(sparse.where("rsID IS NOT NULL"), ["rsID", "code"], ":", "i")


def trait_ids(associations: DataFrame) -> DataFrame:
    """(trait, pubmedID, n, key, j) over the trait-study pairs."""
    return frequency_ids(one_task(associations), ["trait", "pubmedID"], "|", "j")
