"""Bitmaps of positions and identifiers, and catalogues in buckets."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dosegrid.operators import numbers
from dosegrid.operators.alleles import allele_code_map
from dosegrid.operators.associations import attach_codes
from dosegrid.operators.harmonise import panel_lookup, refresh_rsids
from dosegrid.operators.numbers import number_set, reduced_by_number, within
from dosegrid.session import durable
from dosegrid.sources import parse_catalogue, read_catalogue, write_catalogue
from tests.helpers import associations, catalogue, lines, panel, rows, site


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(plan, scan):
    """Operators between a join and a scan: the lines of the plan on the way up from the scan."""
    found = plan.splitlines()
    at = next(i for i, line in enumerate(found) if re.search(scan, line))
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    way, depth = [], indent(found[at])
    for line in reversed(found[:at]):
        if indent(line) < depth:
            depth = indent(line)
            way.append(line.strip(" :+-"))
            if "Join" in line:
                break
    return way


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 2), st.integers(-70_000, 140_000) | st.just(None)), max_size=40),
    st.lists(st.tuples(st.integers(1, 2) | st.just(None), st.integers(-70_000, 140_000)), max_size=40),
)
def test_within_is_a_semi_join(spark, some, others):
    schema = "chr int, pos long"
    known, asked = spark.createDataFrame(some, schema), spark.createDataFrame(others + some, schema)
    found = within(asked, number_set(known, "pos", "chr"), "pos", "chr")
    expected = [(c, p) for c, p in others + some if (c, p) in set(some) and None not in (c, p)]
    assert sorted(rows(found)) == sorted(expected)
    alone = within(asked, number_set(known, "pos"), "pos")
    places = {p for _, p in some}
    assert sorted(map(str, rows(alone))) == sorted(str((c, p)) for c, p in others + some if p in places and p is not None)


def test_numbers_at_the_ends(spark):
    far = [0, 1, 63, 64, 32767, 32768, 2**31, 2**62, -1, -(2**62)]
    known = spark.createDataFrame([(x,) for x in far * 3], "n long")
    asked = spark.createDataFrame([(x + d,) for x in far for d in (-1, 0, 1)], "n long")
    found = sorted(r.n for r in within(asked, number_set(known, "n"), "n").collect())
    assert found == sorted(x + d for x in far for d in (-1, 0, 1) if x + d in set(far))


def test_numbers_spread_too_far_are_shuffled(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(numbers, "MOST_BITMAPS", 3)
    small = durable(spark.range(0, 10_000_000, 1_000_000).withColumnRenamed("id", "n"))
    assert number_set(small, "n") is None
    large = spark.range(0, 10_000_000, 500_000).withColumnRenamed("id", "n")
    assert reduced_by_number(large, small, "n").count() == 10


def test_a_hot_position_is_merged_before_it_moves(spark):
    many = spark.range(300_000).select(F.lit(1).alias("chr"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("pos"))
    assert number_set(many, "pos", "chr").count() == 10
    assert within(many, number_set(many, "pos", "chr"), "pos", "chr").count() == 300_000


CATALOGUE = [(1, 10 * k, k, code, allele) for k in range(1, 60) for code, allele in enumerate("AC")]


@pytest.fixture
def stored(spark):
    files = {"f": (["S1", "S2"], [site("1", 10 * k, ["0|1", "1|1"], alt="C") for k in range(1, 120, 2)])}
    return durable(catalogue(spark, CATALOGUE)), panel(spark, files)


def test_both_sides_are_filtered_before_they_move(spark, stored, no_broadcast, monkeypatch):
    known, p = stored
    lookup = panel_lookup(p.calls, known)
    assert sorted(r.rsID for r in lookup.collect()) == list(range(1, 60, 2))  # not the whole catalogue
    sites = refresh_rsids(p.calls, known)
    plan = physical(sites)
    way = above(plan, "Scan ExistingRDD")  # the panel
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in way)
    first = next(i for i, line in enumerate(way) if "LeftSemi" in line)
    assert not any("Exchange" in line for line in way[:first])
    assert sites.count() == 30
    assert refresh_rsids(p.calls, known, keep=True).count() == 60


def test_lookup_of_a_small_catalogue_is_made_once(spark, stored):
    known, p = stored
    assert panel_lookup(p.calls, known) is panel_lookup(p.calls, known)
    assert panel_lookup(p.calls, known) is not panel_lookup(p.calls, known, "min_rsid")


def test_codes_of_many_variants_are_cut_by_bitmaps(spark, stored, no_broadcast):
    known, p = stored
    sites = refresh_rsids(p.calls, known)
    code_map = allele_code_map(known, sites)
    assert code_map.count() == 60
    assert "BroadcastHashJoin" in physical(code_map)


@pytest.mark.parametrize("keep", [False, True])
def test_a_catalogue_in_buckets_stays_where_it_is(spark, stored, no_broadcast, tmp_path, keep):
    known, p = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_catalogue(known, str(tmp_path), buckets=6)
        kept = read_catalogue(spark, str(tmp_path))
        assert rows(kept.by_place) == rows(kept.by_allele) == rows(known)
        sites = refresh_rsids(p.calls, kept, keep)
        scan = "SelectedBucketsCount"
        assert not any("Exchange" in line for line in above(physical(sites), scan))
        assert "Bucketed: true" in physical(sites)
        plain = refresh_rsids(p.calls, known, keep)
        columns = ["contig", "pos", "rsID", "oldID"]
        assert rows(sites.select(*columns)) == rows(plain.select(*columns))
        code_map = allele_code_map(kept, sites)
        assert not any("Exchange" in line for line in above(physical(code_map), "SelectedBucketsCount"))
        assert rows(code_map) == rows(allele_code_map(known, plain))
        gwas = associations(spark, [(k, "C", 1.5, 1, 10 * k, "t", "2020-01-01", 5) for k in range(1, 9)])
        coded = attach_codes(kept, gwas)
        assert not any("Exchange" in line for line in above(physical(coded), "SelectedBucketsCount"))
        assert rows(coded) == rows(attach_codes(known, gwas))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def record(chrom, pos, number, alt, annot):
    return ("c", f"NC_00000{chrom}.1\t{pos}\trs{number}\tA\t{alt}\t.\t.\t{annot}")


@pytest.mark.parametrize("limit", [None, "0"])
def test_conflicting_records(spark, limit):
    from dosegrid.session import BROADCAST_SETTING

    text = [record(1, 10, 5, "C", "x"), record(1, 10, 5, "C", "x"), record(2, 9, 6, "G", "b"), record(2, 9, 6, "G", "a"),
            record(2, 8, 6, "T", "z"), record(3, 7, 7, "G", "only"), ("c", "NC_000001.1\t4\tno number\tA\tC\t.\t.\ty"),
            ("c", "NC_000001.1\t3\tno number\tA\tC\t.\t.\ty")]
    lines = spark.createDataFrame(text, "source string, value string")
    if limit:
        spark.conf.set(BROADCAST_SETTING, limit)
    try:
        got = rows(parse_catalogue(lines).select("rsID", "code", "chr", "pos", "allele", "annot"))
    finally:
        spark.conf.unset(BROADCAST_SETTING)
    assert got == sorted([
        (5, 0, 1, 10, "A", "x"), (5, 1, 1, 10, "C", "x"), (6, 0, 2, 8, "A", "z"), (6, 1, 2, 8, "T", "z"),
        (7, 0, 3, 7, "A", "only"), (7, 1, 3, 7, "G", "only"), (None, 0, 1, 3, "A", "y"), (None, 1, 1, 3, "C", "y"),
    ], key=lambda r: tuple(map(str, r)))


def test_unique_records_are_not_sorted(spark):
    made = spark.range(1000).select(
        F.lit("c").alias("source"),
        F.format_string("NC_000001.1\t%d\trs%d\tA\tC\t.\t.\tx", F.col("id") + 1, F.col("id")).alias("value"),
    )
    table = parse_catalogue(made)
    assert "Sort" not in physical(table) and "Exchange" not in physical(table)
    assert table.count() == 2000


def test_text_is_read_once_when_a_panel_is_stored(spark, tmp_path):
    from dosegrid.sources import read_panel, write_panel

    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    files = {"f": (["S1"], [site(str(k % 22 + 1), 10 * k, ["0|1"], alt="C") for k in range(1, 500)])}
    text = lines(spark, files).mapInArrow(counted, "source string, value string")
    write_panel(text, str(tmp_path / "p"))
    assert reads.value == 501
    assert read_panel(spark, str(tmp_path / "p")).calls.count() == 499
