"""Every query against its SQL, and the chain against independent figures."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import inputs
from checks.oracle import oracle_sql
from checks.queries import QUERIES
from dosegrid import schemas
from dosegrid.operators.alleles import allele_code_map
from dosegrid.operators.harmonise import refresh_rsids
from dosegrid.operators.score import study_scores
from dosegrid.operators.sparse import to_sparse
from dosegrid.plans import prepare_associations
from dosegrid.session import durable

duckdb = pytest.importorskip("duckdb")

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in ("part", "supplier"):
        con.sql(f"CREATE VIEW {table} AS FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == oracle_sql().keys()
    assert QUERIES.keys() <= contract.queries().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, SF_DIR)
    expected = sql.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert normal(df.collect(), df.columns) == normal(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_without_any_broadcast(spark, sql, no_broadcast, name):
    test_query_equals_sql(spark, sql, name)


@pytest.mark.parametrize(
    "name, schema",
    {
        "catalogue_alleles": schemas.CATALOGUE,
        "allele_code_map": schemas.CODE_MAP,
        "sparse_default": schemas.SPARSE,
        "gwas_clean": schemas.ASSOCIATIONS,
        "prs": schemas.SCORES,
    }.items(),
)
def test_layouts(spark, name, schema):
    df = contract.queries()[name](spark, SF_DIR)
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.fields]


# Figures of FIXTURES.md, which leaves out the catalogue records beside a site
# and the associations of every other site.
FIGURES = {
    "/root/testdata/sf0.001": {
        "catalogue": 402, "pairs": 187, "map": (402, 50), "sparse": (387, 430, 2),
        "phased": (254, 284, 2), "coded": (51, 51.0), "scores": (36, 65.0, 4.75),
        "scores_phased": (25, 40.0, 4.0),
    },
    "/root/testdata/sf0.01": {
        "catalogue": 4007, "pairs": 1870, "map": (4007, 492), "sparse": (38123, 42494, 2),
        "phased": (25009, 27834, 2), "coded": (497, 557.5), "scores": (1050, 5799.75, 31.25),
        "scores_phased": (786, 3800.75, 29.25),
    },
}


@pytest.mark.parametrize("sf_dir", FIGURES)
def test_chain_figures(spark, sf_dir):
    expected = FIGURES[sf_dir]
    panel = inputs.packed_panel(spark, sf_dir)
    catalogue = durable(inputs.catalogue(spark, sf_dir).where("pos % 10 = 0"))
    given = inputs.associations(spark, sf_dir).where("pos % 20 = 10")
    assert catalogue.count() == expected["catalogue"]
    sites = refresh_rsids(panel.calls, catalogue)
    assert sites.count() == expected["pairs"]
    code_map = allele_code_map(catalogue, sites)
    assert (code_map.count(), code_map.where("file_code != code").count()) == expected["map"]
    weights = durable(prepare_associations(catalogue, given, code_map))
    assert tuple(weights.agg(F.count("OR"), F.sum("OR")).first()) == expected["coded"]
    for name, scores, phased in (("sparse", "scores", False), ("phased", "scores_phased", True)):
        sparse = to_sparse(sites, panel.headers, phased_only=phased)
        assert tuple(
            sparse.agg(F.count("dose"), F.sum("dose"), F.max("dose")).first()
        ) == expected[name]
        assert tuple(
            study_scores(sparse, weights)
            .agg(F.count("prs_score"), F.sum("prs_score"), F.max("prs_score"))
            .first()
        ) == expected[scores]
