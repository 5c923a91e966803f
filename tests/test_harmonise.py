import pytest
from pyspark.sql import functions as F

from dosegrid.operators.alleles import allele_code_map, site_alleles, with_allele
from dosegrid.operators.harmonise import (
    own_rsids,
    position_lookup,
    refresh_rsids,
    rsid_changes,
    split_sites,
)
from dosegrid.operators.sparse import recode_sparse, to_sparse
from tests.helpers import catalogue, panel, rows, site

CATALOGUE = [
    (1, 10, 100, 0, "A"), (1, 10, 100, 1, "G"), (1, 10, 100, 2, "C"),
    (1, 10, 200, 0, "A"), (1, 10, 200, 1, "C"),
    (23, 5, 300, 0, "A"), (23, 5, 300, 1, "C"),
]
SITES = [
    site("1", 10, ["0|1", "1|2"], id="rs100"),
    site("X", 5, ["1|1", "0|0"], id="."),
    site("2", 7, ["0|1", "0|1"], id="rs9"),
    site("2", 8, ["0|1", "0|0"], id="."),
    site("GL1", 8, ["0|1", "0|0"], id="."),
]


@pytest.fixture
def data(spark):
    return panel(spark, {"f": (["A", "B"], SITES)}), catalogue(spark, CATALOGUE)


def test_lookup_has_each_pair_once(spark, data):
    assert rows(position_lookup(data[1])) == [(1, 10, 100), (1, 10, 200), (23, 5, 300)]
    assert rows(position_lookup(data[1], "min_rsid")) == [(1, 10, 100), (23, 5, 300)]
    with pytest.raises(ValueError):
        position_lookup(data[1], "one")


def test_inner_and_kept(spark, data):
    p, c = data
    inner = refresh_rsids(p.calls, c).select("contig", "pos", "oldID", "rsID")
    assert rows(inner) == [("1", 10, "rs100", 100), ("1", 10, "rs100", 200), ("X", 5, ".", 300)]
    kept = refresh_rsids(p.calls, c, keep=True, multi="min_rsid").select("contig", "pos", "rsID")
    assert rows(kept) == [
        ("1", 10, 100), ("2", 7, None), ("2", 8, None), ("GL1", 8, None), ("X", 5, 300),
    ]


def test_changes(spark, data):
    refreshed = refresh_rsids(data[0].calls, data[1], keep=True)
    assert rows(rsid_changes(refreshed).select("oldID", "rsID")) == [(".", 300), ("rs100", 200)]
    assert rows(rsid_changes(refreshed, known_only=True).select("oldID", "rsID")) == [("rs100", 200)]


def test_unmatched_sites_are_not_merged(spark, data):
    sites = refresh_rsids(data[0].calls, data[1], keep=True)
    sparse = to_sparse(sites, data[0].headers).where("rsID IS NULL")
    assert rows(sparse.select("sample_name", "chr", "pos", "code", "dose")) == [
        ("A", 2, 7, 1, 1), ("A", 2, 8, 1, 1), ("A", None, 8, 1, 1), ("B", 2, 7, 1, 1),
    ]


def test_code_map_and_recoding(spark, data):
    p, c = data
    sites = refresh_rsids(p.calls, c)
    code_map = allele_code_map(c, sites)
    assert rows(code_map) == [
        (100, 0, 0), (100, 1, 2), (100, 2, 1), (200, 0, 0), (200, 1, 1), (300, 0, 0), (300, 1, 1),
    ]
    recoded = recode_sparse(to_sparse(sites, p.headers), code_map)
    assert rows(recoded.where("sample_name = 'B'").select("rsID", "code", "dose")) == [
        (100, 1, 1), (100, 2, 1), (200, 0, 1), (200, 1, 1),
    ]


def test_allele_text(spark, data):
    p, c = data
    sites = refresh_rsids(p.calls, c)
    sparse = to_sparse(sites, p.headers)
    named = with_allele(sparse, site_alleles(sites)).where("rsID = 100")
    assert rows(named.select("sample_name", "code", "allele")) == [("A", 1, "C"), ("B", 1, "C"), ("B", 2, "G")]
    recoded = recode_sparse(sparse, allele_code_map(c, sites))
    named = with_allele(recoded, c).where("rsID = 100")
    assert rows(named.select("sample_name", "code", "allele")) == [("A", 2, "C"), ("B", 1, "G"), ("B", 2, "C")]


def test_code_map_is_not_repeated_by_copies_of_a_site(spark, data):
    sites = refresh_rsids(data[0].calls.union(data[0].calls), data[1])
    assert allele_code_map(data[1], sites).count() == 7


def test_split_sites(spark):
    p = panel(spark, {"f": (["A"], [site("1", 10, ["0|1"], alt="C"), site("1", 10, ["0|1"], alt="G"), site("1", 11, ["0|1"])])})
    assert rows(split_sites(p.calls)) == [("f", "1", 10, "A", 2)]


def test_own_ids(spark, data):
    got = own_rsids(data[0].calls).select("oldID", "rsID")
    assert rows(got) == [(".", None), (".", None), (".", None), ("rs100", 100), ("rs9", 9)]


def test_hot_null_position(spark):
    """Many sites off the map, one third of them alike, are kept once each."""
    sites = [site("GL1", 5, ["0|1"], id=f"{i}") for i in range(300)]
    p = panel(spark, {"f": (["A"], [*sites, site("1", 10, ["0|1"])])})
    kept = refresh_rsids(p.calls, catalogue(spark, CATALOGUE), keep=True, multi="min_rsid")
    assert kept.count() == 301
    assert kept.where(F.col("rsID").isNotNull()).count() == 1
