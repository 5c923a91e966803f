from pyspark.sql import functions as F

from dosegrid.operators.alleles import allele_code_map
from dosegrid.operators.associations import (
    attach_codes,
    fill_rsids,
    fill_rsids_two_assemblies,
    recode_associations,
    restrict_to_panel,
    unique_associations,
)
from dosegrid.operators.harmonise import refresh_rsids
from dosegrid.operators.ids import frequency_ids, ordered_ids, trait_ids, variant_ids
from dosegrid.operators.score import lookup_scores, polygenic_scores, score_matrix
from dosegrid.operators.sparse import to_sparse
from dosegrid.plans import encode_panel, panel_score_matrix, prepare_associations, score_run
from tests.helpers import associations, catalogue, panel, rows, site

CATALOGUE = [
    (1, 10, 100, 0, "A"), (1, 10, 100, 1, "G"), (1, 10, 100, 2, "C"),
    (2, 20, 200, 0, "A"), (2, 20, 200, 1, "C"),
    (3, 30, 300, 0, "T"), (3, 30, 300, 1, "C"),
]
D = "2020-01-01"


def text_dates(df):
    return df.withColumn("date", F.col("date").cast("string"))


def test_one_row_per_association_whatever_the_order(spark):
    data = [
        (1, "A", 2.0, 1, 10, "t", "2019-01-01", 5),
        (1, "A", 1.0, 1, 10, "t", "2020-01-01", 7),
        (1, "A", 1.5, 1, 10, "t", "2020-01-01", 6),
        (1, "A", 1.7, 1, 12, "t", "2020-01-01", 6),
        (1, "A", 1.7, 1, 11, "t", "2020-01-01", 6),
        (1, "A", 9.0, 1, 10, "t", None, 1),
        (1, "A", 9.0, 1, 10, "t", "2020-01-01", None),
        (None, "A", 1.0, 1, 10, "t", D, 1),
        (None, "A", 2.0, 1, 10, "t", D, 1),
    ]
    expected = [
        (1, "A", 1.7, 1, 11, "t", "2020-01-01", 6), (None, "A", 2.0, 1, 10, "t", D, 1),
    ]
    for order in (data, data[::-1]):
        assert rows(text_dates(unique_associations(associations(spark, order)))) == expected


def test_fill_and_overwrite(spark):
    given = associations(
        spark,
        [
            (None, "C", 1.0, 1, 10, "t", D, 1),
            (999, "C", 1.0, 2, 20, "t", D, 1),
            (888, "C", 1.0, None, None, "t", D, 1),
            (None, "C", 1.0, 9, 9, "t", D, 1),
        ],
    )
    c = catalogue(spark, CATALOGUE)
    keep = fill_rsids(c, given).select("rsID", "pos")
    assert rows(keep) == [(100, 10), (888, None), (999, 20), (None, 9)]
    # Both rows without a hit lose their id and then share (trait, rsID, alt).
    over = fill_rsids(c, given, overwrite=True).select("rsID", "pos")
    assert rows(over) == [(100, 10), (200, 20), (None, 9)]


def test_two_assemblies(spark):
    newer = catalogue(spark, [(1, 10, 101, 0, "A"), (4, 40, 400, 0, "A")])
    given = associations(
        spark,
        [
            (None, "C", 1.0, 1, 10, "t", D, 1),
            (None, "C", 1.0, 4, 40, "t", D, 1),
            (7, "C", 1.0, 4, 40, "t", D, 1),
        ],
    )
    filled = fill_rsids_two_assemblies(catalogue(spark, CATALOGUE), newer, given)
    assert filled.columns == ["trait", "rsID", "alt", "OR", "pubmedID", "date"]
    assert rows(filled.select("rsID")) == [(100,), (400,), (7,)]


def test_codes_and_null_rows(spark):
    given = associations(
        spark,
        [
            (100, "C", 1.0, 1, 10, "t", D, 1),
            (100, "A", 1.0, 1, 10, "t", D, 1),
            (100, "T", 1.0, 1, 10, "t", D, 1),
            (200, "C", 1.0, 2, 20, "t", None, 1),
            (200, "C", 1.0, None, 20, "u", D, 1),
        ],
    )
    coded = attach_codes(catalogue(spark, CATALOGUE), given)
    assert rows(coded.select("rsID", "alt", "code")) == [(100, "A", 0), (100, "C", 2)]


def test_recoding_unknown_to_zero_and_distinct(spark):
    code_map = spark.createDataFrame([(100, 1, 2), (100, 1, 2)], "rsID long, file_code int, code int")
    given = associations(spark, [(100, "C", 1.0, 1, 10, "t", D, 1), (300, "C", 1.0, 3, 30, "t", D, 1)])
    coded = attach_codes(catalogue(spark, CATALOGUE), given.union(given))
    out = recode_associations(coded, code_map)
    assert rows(out.select("rsID", "code")) == [(100, 1), (300, 0)]


def make_panel(spark):
    return panel(
        spark,
        {
            "f": (
                ["A", "B"],
                [
                    site("1", 10, ["0|1", "1|2"], id="rs1"),
                    site("2", 20, ["1|1", "0|0"], alt="C"),
                    site("5", 50, ["1|1", "1|1"], alt="C"),
                ],
            )
        },
    )


ASSOCIATIONS = [
    (None, "C", 0.5, 1, 10, "height", "2020-01-01", 1),
    (None, "G", 0.25, 1, 10, "height", "2020-01-01", 1),
    (200, "C", 2.0, 2, 20, "height", "2021-01-01", 1),
    (200, "C", 4.0, 2, 20, "weight", "2021-01-01", 2),
    (200, "A", 8.0, 2, 20, "weight", "2021-01-01", 2),
    (300, "C", 1.0, 3, 30, "weight", "2021-01-01", 2),
    (777, "C", 1.0, 7, 70, "weight", "2021-01-01", 2),
]
# height: A has C once and rs200 twice; B has C and G once each.
SCORES = [
    ("A", 4.5, "height", 1, "2020-01-01"),
    ("A", 4.5, "height", 1, "2021-01-01"),
    ("A", 8.0, "weight", 2, "2021-01-01"),
    ("B", 0.75, "height", 1, "2020-01-01"),
    ("B", 0.75, "height", 1, "2021-01-01"),
]


def step_by_step(spark):
    p, c = make_panel(spark), catalogue(spark, CATALOGUE)
    sites = refresh_rsids(p.calls, c)
    weights = prepare_associations(c, associations(spark, ASSOCIATIONS), allele_code_map(c, sites))
    return to_sparse(sites, p.headers), weights


def test_chain_step_by_step(spark):
    sparse, weights = step_by_step(spark)
    scores = polygenic_scores(sparse, weights)
    assert [tuple(r)[0] for r in scores.collect()] == ["A", "A", "A", "B", "B"]
    assert rows(text_dates(scores)) == SCORES
    assert lookup_scores(scores, "A", 2, 1.0).count() == 1
    assert lookup_scores(scores, "A", 2, 8.0).count() == 0


def test_whole_run_is_the_same(spark):
    p, c = make_panel(spark), catalogue(spark, CATALOGUE)
    given = associations(spark, ASSOCIATIONS)
    assert rows(text_dates(score_run(p, c, given))) == SCORES


def test_whole_run_without_any_broadcast(spark, no_broadcast):
    p, c = make_panel(spark), catalogue(spark, CATALOGUE)
    given = associations(spark, ASSOCIATIONS)
    assert rows(text_dates(score_run(p, c, given))) == SCORES
    assert encode_panel(p, c).count() == 4


def test_restrict_to_panel(spark):
    sparse, weights = step_by_step(spark)
    kept = restrict_to_panel(weights, sparse)
    assert rows(kept.select("rsID", "code", "trait")) == [
        (100, 1, "height"), (100, 2, "height"), (200, 1, "height"), (200, 1, "weight"),
    ]


def test_score_matrix_agrees_with_scores(spark):
    p, c = make_panel(spark), catalogue(spark, CATALOGUE)
    got = panel_score_matrix(p, c, c, associations(spark, ASSOCIATIONS))
    # Of the coded associations height has 3, weight 3: alphabetical.
    assert rows(got) == [(0, 0, 4.5), (0, 1, 8.0), (1, 0, 0.75)]


def test_sparse_product(spark):
    left = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 1)], "sample long, i long, dose int")
    right = spark.createDataFrame([(0, 0, 0.5), (1, 0, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i long, j long, OR double")
    assert rows(score_matrix(left, right)) == [(0, 0, 4.5), (0, 1, 6.0), (1, 0, 2.0), (1, 1, 3.0)]


def test_ids_by_frequency(spark):
    sparse = spark.createDataFrame(
        [(10, 1), (10, 1), (9, 1), (9, 2), (100, 1), (None, 1)], "rsID long, code int"
    )
    got = variant_ids(sparse).select("i", "key", "n").orderBy("i")
    assert [tuple(r) for r in got.collect()] == [(0, "10:1", 2), (1, "100:1", 1), (2, "9:1", 1), (3, "9:2", 1)]
    traits = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), (None, 3)], "trait string, pubmedID long")
    got = trait_ids(traits).select("j", "key").orderBy("j")
    assert [tuple(r) for r in got.collect()] == [(0, "a|2"), (1, "3"), (2, "b|1")]


def test_ids_are_dense_over_many_partitions(spark):
    data = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"))
    got = ordered_ids(data, [F.col("v")], "i")
    assert got.where("i != v").count() == 0 and got.count() == 5000
    counted = frequency_ids(data.select((F.col("v") % 1000).alias("w")), ["w"], "", "i")
    assert {r.i for r in counted.collect()} == set(range(1000))


def test_hot_variant_scores_are_whole(spark):
    """One variant with a third of the rows and many studies is summed in full."""
    n = 3000
    sparse = spark.range(n).select(
        F.concat(F.lit("s"), (F.col("id") % 100)).alias("sample_name"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("rsID"),
        F.lit(1).alias("code"),
        F.lit(1).alias("dose"),
    )
    weights = associations(
        spark,
        [(1, "C", 0.25, 1, 1, f"t{t}", D, 1) for t in range(40)]
        + [(7, "C", 0.5, 1, 1, "t0", D, 1)],
    ).withColumn("code", F.lit(1))
    scores = polygenic_scores(sparse, weights)
    total = scores.agg(F.sum("prs_score")).first()[0]
    # id 1 is itself variant 1; variant 7 occurs once.
    assert total == (n // 3 + 1) * 40 * 0.25 + 0.5


def test_nothing_in_common(spark):
    p = make_panel(spark)
    elsewhere = associations(spark, [(5, "C", 1.0, 9, 90, "t", D, 1)])
    assert score_run(p, catalogue(spark, CATALOGUE), elsewhere).count() == 0
    assert score_run(p, catalogue(spark, []), associations(spark, [])).count() == 0
