import re

import pytest
from pyspark.sql import functions as F

from dosegrid.operators.harmonise import attach_rsids
from dosegrid.operators.joins import left_lookup, reduced
from dosegrid.session import broadcast_if_small, durable, fits_broadcast, measured_bytes
from tests.helpers import rows


@pytest.fixture
def no_own_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def small_partitions(spark, no_own_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_sites(spark, n=60000):
    """A third of the sites at one position, a tenth of them without one."""
    return spark.range(0, n, 1, 12).select(
        F.when(F.col("id") % 10 == 1, None).otherwise(1).cast("int").alias("chr"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("pos"),
        F.sha2(F.col("id").cast("string"), 256).alias("id"),
    )


@pytest.mark.parametrize("keep", [False, True])
def test_hot_keys_of_a_shuffled_join_are_split(spark, small_partitions, keep):
    n = 60000
    lookup = spark.range(n).select(
        F.lit(1).alias("chr"), F.col("id").alias("pos"), (F.col("id") + 1).alias("rsID")
    )
    joined = attach_rsids(hot_sites(spark, n), durable(lookup), keep)
    counted = joined.agg(F.count(F.lit(1)), F.count("rsID"), F.countDistinct("oldID"))
    total = n if keep else n * 9 // 10
    assert tuple(counted.first()) == (total, n * 9 // 10, total)
    plan = joined.groupBy(F.length("oldID")).agg(F.max("rsID"))
    plan.collect()
    assert "SortMergeJoin(skew=true)" in physical(plan)


def test_rows_without_a_key_are_spread(spark, no_own_broadcast):
    left = spark.range(1000).select(F.when(F.col("id") < 5, F.col("id")).alias("k"), "id")
    right = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = left_lookup(left, right, ["k"])
    assert joined.where("v IS NULL").count() == 995 and joined.count() == 1000
    keys = re.search(r"(?:SortMerge|ShuffledHash)Join[^\[]*\[([^\]]*)\]", physical(joined))
    assert "_spread" in keys.group(1)


def test_hints_reach_the_join(spark, no_own_broadcast):
    left = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("a"))
    right = durable(spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    joined = left_lookup(left, broadcast_if_small(right), ["k"])
    assert "BroadcastHashJoin" in physical(joined)
    assert joined.where("v = 'x'").count() == 5 and joined.count() == 10
    kept = reduced(left, right, ["k"])
    assert "BroadcastHashJoin" in physical(kept)
    assert kept.columns == ["k", "a"] and kept.count() == 5


def test_sizes(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "t string, n int")
    assert measured_bytes(df) == 2 * 32 + 3
    stored = durable(df)
    assert measured_bytes(stored) == 67 and durable(stored) is stored
    assert rows(stored) == rows(df)
    assert measured_bytes(durable(df.where("n > 5"))) == 0
    lists = spark.createDataFrame([(["a", "b"],)], "l array<string>")
    assert measured_bytes(lists) == 16 + 128 + 2
    assert fits_broadcast(df, within=stored)
