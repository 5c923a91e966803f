from pyspark.sql import functions as F

from dosegrid.functions import (
    accession_code,
    allele_list,
    chrom_code,
    chrom_code_or_number,
    pack_calls,
    reference_cells,
    rsid_number,
    two_codes,
    whole_number,
)


def mapped(spark, expression, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_chromosome_names(spark):
    names = ["X", "Y", "M", "22", "1", "Q", "01", "23", None, ""]
    assert mapped(spark, chrom_code, names) == [23, 24, 25, 22, 1] + [None] * 5


def test_chromosome_numbers_pass_through(spark):
    names = ["X", "7", "30", "Q", None]
    assert mapped(spark, chrom_code_or_number, names) == [23, 7, 30, None, None]


def test_accessions(spark):
    names = ["NC_000010.10", "NC_000023.10", "NC_000024.9", "NC_012920.1", "NT_113889.1", "NC_012921.1", None]
    assert mapped(spark, accession_code, names) == [10, 23, 24, 25, None, None, None]


def test_numbers_in_text(spark):
    assert mapped(spark, whole_number, ["12", "12.0", " 7 ", "", "1;2", "x", None]) == [
        12, 12, 7, None, None, None, None,
    ]
    assert mapped(spark, rsid_number, ["rs123", "123", ".", "rs", None]) == [
        123, None, None, None, None,
    ]


def codes(spark, cell, phased_only=False):
    df = spark.createDataFrame([(cell,)], "v string")
    return tuple(df.select(*two_codes(F.col("v"), phased_only)).first())


def test_calls(spark):
    cases = {
        "0|1": ((0, 1), (0, 1)),
        "1|1": ((1, 1), (1, 1)),
        "1|2": ((1, 2), (1, 2)),
        "./.": ((0, 0), (0, 0)),
        ".": ((0, 0), (0, 0)),
        "1": ((1, 0), (1, 0)),
        "0/1": ((0, 1), (0, 0)),
        "0|1:35": ((0, 1), (0, 0)),
        "1|0:35": ((1, 0), (1, 0)),
        "12|3": ((12, 3), (12, 3)),
        ".|1": ((0, 1), (0, 1)),
        "1|2|3": ((1, 2), (1, 2)),
        "1|": ((1, 0), (1, 0)),
        "1:35": ((1, 0), (0, 0)),
    }
    for cell, (default, phased) in cases.items():
        assert codes(spark, cell) == default, cell
        assert codes(spark, cell, True) == phased, cell


def test_packed_calls_are_those_of_two_codes(spark):
    parts = ["", "0", "1", "2", "12", ".", " 1", "0|0", "./.", "1|1", "1/2", "0|2", ".|1", "1|0|1"]
    cells = [a + b for a in parts for b in ["", "\n", ":", ":9", ":0|1", ":.:1/1", "|", "|1", "/0"]] + [None]
    df = spark.createDataFrame([(cells,)], "genotypes array<string>").coalesce(1)
    got = pack_calls(df).select(F.inline("alternates")).collect()
    table = spark.createDataFrame(list(enumerate(cells)), "i int, v string").coalesce(1)
    read = table.select("i", *two_codes(F.col("v")), *two_codes(F.col("v"), True)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in read if max(r[1:]) > 0]


def test_reference_calls_with_fields_are_not_parsed(spark):
    plain = ["0|0:9", "0/0:1:2", "./.:.", ".|.:3", ".:3", "0:", None, "0|0"]
    other = ["0|1:9", "1:0", "0/0:0|1", "00|0:1", "1|1", "", ":0|0"]
    got = mapped(spark, reference_cells, plain + other)
    assert got == [True] * len(plain) + [False] * len(other)


def test_allele_list(spark):
    df = spark.createDataFrame([("A", "C,G"), ("A", None)], "r string, a string").coalesce(1)
    got = [r[0] for r in df.select(allele_list(F.col("r"), F.col("a"))).collect()]
    assert got == [["A", "C", "G"], ["A"]]
