import gzip

import pytest
from pyspark.sql import functions as F

from dosegrid.functions import accession_code
from dosegrid.operators.harmonise import own_rsids
from dosegrid.operators.sparse import to_sparse
from dosegrid.sources import (
    load_variants,
    merge_by_name,
    merge_wide,
    pack_wide,
    parse_catalogue,
    read_associations,
    read_panel,
    sample_table,
    write_counted,
    write_panel,
    write_tsv,
)
from tests.helpers import FIXED, lines, panel, rows, site


def write_gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)
    return str(path)


def vcf_text(samples, sites):
    head = ["##fileformat=VCFv4.2", "\t".join([FIXED, *samples])]
    return "\n".join(head + ["\t".join(map(str, s)) for s in sites]) + "\n"


@pytest.fixture
def two_files(tmp_path):
    a = vcf_text(["A", "B"], [site("1", 10, ["0|1", "1|1"], id="rs1"), site("X", 20, ["1|2", "."], id="rs2")])
    b = vcf_text(["B", "C"], [site("2", 30, ["0|1", "./."], id="rs3")])
    return [write_gz(tmp_path / "a.vcf.gz", a), write_gz(tmp_path / "b.vcf.gz", b)]


EXPECTED = [
    ("A", 1, 1, 1), ("A", 2, 1, 1), ("A", 2, 2, 1), ("B", 1, 1, 2), ("B", 3, 1, 1),
]


def sparse_rows(panel):
    sparse = to_sparse(own_rsids(panel.calls), panel.headers)
    return rows(sparse.select("sample_name", "rsID", "code", "dose"))


def test_gzip_files_with_different_samples(spark, two_files):
    loaded = load_variants(spark, two_files, format="gvcf")
    assert rows(loaded.calls.select("contig", "chr", "pos")) == [
        ("1", 1, 10), ("2", 2, 30), ("X", 23, 20),
    ]
    assert sparse_rows(loaded) == EXPECTED
    names = rows(sample_table(loaded.headers).select("sample", "sample_name").distinct())
    assert names == [(0, "A"), (1, "B"), (2, "C")]


def test_stored_panel_equals_lines(spark, two_files, tmp_path):
    out = str(tmp_path / "panel")
    assert load_variants(spark, two_files, format="gvcf", output=out, partitions=3) == 3
    stored = read_panel(spark, out)
    assert stored.calls.count() == 3
    assert stored.headers.count() == 2
    assert sparse_rows(stored) == EXPECTED


def test_header_is_found_behind_long_comments(spark, tmp_path):
    text = "##x\n" * 20000 + vcf_text(["A"], [site("1", 10, ["0|1"], id="rs1")])
    path = write_gz(tmp_path / "long.vcf.gz", text)
    assert sparse_rows(load_variants(spark, [path], format="gvcf")) == [("A", 1, 1, 1)]


def test_row_cap_is_per_file(spark, tmp_path):
    sites = [site("1", 10 + i, ["0|1"], id=f"rs{i}") for i in range(50)]
    paths = [write_gz(tmp_path / f"{n}.vcf.gz", vcf_text(["A"], sites)) for n in "ab"]
    loaded = load_variants(spark, paths, format="gvcf", limit=7)
    assert [r[0] for r in loaded.calls.groupBy("source").count().select("count").collect()] == [7, 7]
    assert loaded.headers.count() == 2
    assert {r[0] for r in loaded.calls.select("pos").collect()} == set(range(10, 17))


def test_row_cap_is_for_each_file_of_a_folder(spark, tmp_path):
    for name in "abc":
        write_gz(tmp_path / f"{name}.vcf.gz", vcf_text(["A"], [site("1", k, ["0|1"]) for k in range(1, 9)]))
    calls = load_variants(spark, [str(tmp_path)], format="gvcf", limit=2).calls
    assert sorted(r["count"] for r in calls.groupBy("source").count().collect()) == [2, 2, 2]


def test_missing_header_fails(spark, tmp_path):
    path, good = tmp_path / "bad.vcf", tmp_path / "good.vcf"
    path.write_text("\t".join(map(str, site("1", 10, ["0|1"], id="rs1"))) + "\n")
    good.write_text(vcf_text(["A"], [site("1", 10, ["0|1"], id="rs1")]))
    loaded = load_variants(spark, [str(path)], format="gvcf")
    with pytest.raises(ValueError, match="no #CHROM line in any"):
        to_sparse(own_rsids(loaded.calls), loaded.headers)
    loaded = load_variants(spark, [str(path), str(good)], format="gvcf")
    with pytest.raises(Exception, match="no #CHROM line in .*bad.vcf"):
        to_sparse(own_rsids(loaded.calls), loaded.headers).collect()


def test_unknown_format_and_empty_list(spark):
    with pytest.raises(ValueError, match="bed"):
        load_variants(spark, ["x"], format="bed")
    with pytest.raises(ValueError, match="no input"):
        load_variants(spark, [], format="gvcf")


CATALOGUE = "\n".join(
    [
        "##meta",
        "NC_000010.10\t5\trs7\tA\tC,G\t.\t.\tRS=7",
        "NC_000010.10\t5\trs7\tA\tC,G\t.\t.\tRS=7",
        "NC_000010.10\t4\trs7\tT\tG\t.\t.\tother",
        "NT_113889.1\t5\trs8\tA\tC\t.\t.\tRS=8",
        "NC_012920.1\t9\trs9\tG\tT\t.\t.\tRS=9",
    ]
)


def test_catalogue_file(spark, tmp_path):
    path = write_gz(tmp_path / "c.csv.gz", CATALOGUE)
    expected = [
        (10, 4, 7, 0, "T", "other"),
        (10, 4, 7, 1, "G", "other"),
        (10, 5, 7, 2, "G", "RS=7"),
        (25, 9, 9, 0, "G", "RS=9"),
        (25, 9, 9, 1, "T", "RS=9"),
    ]
    assert rows(load_variants(spark, [path], format="dbsnp")) == expected
    out = str(tmp_path / "c.parquet")
    assert load_variants(spark, [path], format="dbsnp", output=out, partitions=2) == 5
    assert rows(load_variants(spark, [out])) == expected


def test_merge_by_name_fills_nulls(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "z int, x int")
    merged = merge_by_name(a, b)
    assert merged.columns == ["x", "y", "z"]
    assert rows(merged) == [(1, 2, None), (4, None, 3)]


def test_parquet_files_are_merged_by_name(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "x int, y int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(3,)], "x int").write.parquet(str(tmp_path / "b"))
    merged = load_variants(spark, [str(tmp_path / "a"), str(tmp_path / "b")], partitions=2)
    assert rows(merged) == [(1, 2), (3, None)]


GWAS = "\n".join(
    "\t".join(r)
    for r in [
        ["SNP_ID_CURRENT", "rallele", "OR or BETA", "CHR_ID", "CHR_POS", "SNPs", "DISEASE/TRAIT", "DATE ADDED TO CATALOG", "PUBMEDID", "more"],
        ["12.0", "A", "1.5", "3", "100", "rs12", "t1", "2020-01-02", "55", "x"],
        ["", "A", "2", "", "", "chrX:15", "t1", "2020-01-02", "55", "x"],
        ["14", "A", "0", "3", "100", "rs14", "t1", "2020-01-02", "55", "x"],
        ["15", "A", "", "3", "100", "rs15", "t1", "2020-01-02", "55", "x"],
        ["16", "A", "1", "3;4", "100;200", "rs16", "t1", "soon", "55", "x"],
    ]
)


def test_association_file(spark, tmp_path):
    path = write_gz(tmp_path / "g.csv.gz", GWAS)
    got = read_associations(spark, [path]).withColumn("date", F.col("date").cast("string"))
    assert rows(got) == [
        (12, "A", 1.5, 3, 100, "t1", "2020-01-02", 55),
        (16, "A", 1.0, None, None, "t1", None, 55),
        (None, "A", 2.0, 23, 15, "t1", "2020-01-02", 55),
    ]


def test_wide_table(spark):
    wide = spark.createDataFrame(
        [("1", "10", "rs1", "A", "C", ".", "PASS", ".", "GT", "0|1", "1|1")],
        [*FIXED[1:].split("\t"), "S.1", "S 2"],
    )
    assert sparse_rows(pack_wide(wide, ["S.1", "S 2"], "wide")) == [
        ("S 2", 1, 1, 2), ("S.1", 1, 1, 1),
    ]


@pytest.mark.parametrize("columns", [1, 2, 3, 100])
def test_merged_wide_table_in_blocks_of_columns(spark, columns):
    files = {
        "b": (["S.4"], [site("2", 30, ["0|1"], id="rs3")]),
        "a": (["S3", "S1", "S2"], [site("1", 10, ["0|1", "1|2", "1|1", "2|2"], id="rs1")]),  # a surplus call
        "c": ([], [site("3", 40, [], id="rs4")]),
        "d": (["S6", "S5"], [site("1", 10, ["0|0", "2|1"], id="rs1"), site("X", 20, ["./.", "1"], id="rs2")]),
    }
    whole = panel(spark, files)
    no_header = whole.calls.where("source = 'b'").withColumns({"source": F.lit(None), "pos": F.lit(99)})
    wide = merge_wide(whole._replace(calls=whole.calls.unionByName(no_header)), columns)
    assert len(wide.columns) < 2 * columns
    assert len(wide.columns) <= 6
    assert wide.rows.where("POS = 40").count() == wide.rows.where("POS = 99").count() == 1
    packed = pack_wide(wide)
    assert sparse_rows(packed) == [
        ("S.4", 3, 1, 1), ("S1", 1, 1, 1), ("S1", 1, 2, 1), ("S2", 1, 1, 2), ("S3", 1, 1, 1),
        ("S5", 1, 1, 1), ("S5", 1, 2, 1), ("S5", 2, 1, 1),
    ]
    names = rows(sample_table(packed.headers).select("sample", "sample_name").distinct())
    assert names == [(0, "S3"), (1, "S1"), (2, "S2"), (3, "S.4"), (4, "S6"), (5, "S5")]


def test_columns_of_a_wide_table_do_not_grow_with_the_samples(spark):
    names = [f"S{i:04}" for i in range(900)]
    files = {
        f"f{k}": (names[150 * k : 150 * k + 150], [site("1", 10 + k, ["0|1"] * 150, id=f"rs{k}")])
        for k in range(6)
    }
    wide = merge_wide(panel(spark, files))
    assert len(wide.columns) < 400
    packed = pack_wide(wide)
    assert packed.headers.count() > 1
    assert packed.calls.select(F.sum(F.size("genotypes"))).first()[0] < 6 * 400
    assert sparse_rows(packed) == [(n, i // 150, 1, 1) for i, n in enumerate(names)]


def test_name_in_two_columns_of_a_wide_table(spark):
    files = {"a": (["A", "B"], [site("1", 10, ["0|1", "0|0"])]), "b": (["B"], [site("1", 20, ["0|1"])])}
    with pytest.raises(ValueError, match="sample B is listed twice"):
        merge_wide(panel(spark, files))


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("name", F.concat(F.lit("n"), "id"))
    assert write_counted(df, str(tmp_path / "p"), partitions=2) == 10
    assert write_counted(df, str(tmp_path / "p"), partition_by=["name"]) == 10
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    write_tsv(df, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), sep="\t", header=True)
    assert back.columns == ["id", "name"] and back.count() == 10


def test_hot_position_and_copies_are_dealt_out(spark, tmp_path):
    """A third of all lines are copies of one; they must not meet in one task."""
    copies = [site("1", 10, ["0|1"], id="rs1")] * 60
    others = [site("2", i, ["0|0"]) for i in range(120)]
    text = lines(spark, {"f": (["A"], copies + others)}).coalesce(1)
    out = str(tmp_path / "panel")
    assert write_panel(text, out, partitions=8) == 180
    stored = read_panel(spark, out).calls
    assert stored.where("chr = 1").count() == 60
    files = stored.where("chr = 1").groupBy(F.input_file_name()).count()
    # Ranges of equal size: an eighth of the rows, and not much more.
    assert max(r["count"] for r in files.collect()) <= 1.5 * 181 / 8
    assert write_panel(text, str(tmp_path / "adaptive")) == 180


def test_blank_and_comment_lines(spark):
    text = spark.createDataFrame([("s", ""), ("s", "#x"), ("s", CATALOGUE.split("\n")[1])], "source string, value string")
    assert parse_catalogue(text).count() == 3


def test_same_samples_in_many_files_share_a_panel(spark):
    p = panel(spark, {f"f{i}": (["A", "B"], [site("1", i + 1, ["0|1", "0|0"], id=f"rs{i}")]) for i in range(5)})
    assert p.headers.select("panel").distinct().count() == 1
    assert [r[:3] for r in sparse_rows(p)] == [("A", i, 1) for i in range(5)]


def test_association_files_are_read_by_column_name(spark, tmp_path):
    columns = ["SNP_ID_CURRENT", "rallele", "OR or BETA", "CHR_ID", "CHR_POS", "SNPs",
               "DISEASE/TRAIT", "DATE ADDED TO CATALOG", "PUBMEDID", "EXTRA"]
    values = ["7", "C", "0.5", "12", "100", "", "t", "2020-01-01", "3", "x"]
    order = [9, 4, 3, *range(3), 8, 7, 6, 5]
    a = write_gz(tmp_path / "a.tsv.gz", "\t".join(columns) + "\n" + "\t".join(values) + "\n")
    swapped = ["\t".join(part[i] for i in order) for part in (columns, values)]
    b = tmp_path / "b.tsv"
    b.write_text("\n".join(swapped) + "\n")
    got = rows(read_associations(spark, [a, str(b)]).select("rsID", "chr", "pos", "pubmedID", "trait"))
    assert got == [(7, 12, 100, 3, "t")] * 2
    with pytest.raises(ValueError, match="no header with .* in .*/c.gz"):
        read_associations(spark, [a, write_gz(tmp_path / "c.gz", "no\theader\n")])
    without = write_gz(tmp_path / "d.gz", "\t".join(values) + "\n")
    with pytest.raises(ValueError, match="d.gz"):
        read_associations(spark, [without])


def test_association_files_as_they_are_published(spark, tmp_path):
    """Extra columns, blanks and pattern signs in file names, quotes, empty files and parts."""
    columns = ["DATE ADDED TO CATALOG", "PUBMEDID", "DISEASE/TRAIT", "rallele", "CHR_ID", "CHR_POS",
               "SNPs", "SNP_ID_CURRENT", "OR or BETA"]
    values = ["2020-01-01", "3", '"a quoted trait"', "C", "12", "100", "", "7", "0.5"]
    line = "\t".join
    plain = tmp_path / "my results [1] 100%.tsv"
    plain.write_text(line(columns) + "\r\n" + line(values) + "\r\n\r\n")
    more = tmp_path / "more.tsv"
    more.write_text(line(["FIRST", *columns, "LAST"]) + "\n" + line(["f", *values, "l"]) + "\n" + line(["g", *values]) + "\n")
    (tmp_path / "empty.tsv").write_text("")
    folder = tmp_path / "parts"
    folder.mkdir()
    write_gz(folder / "part-0.gz", line(columns) + "\n")
    write_gz(folder / "part-1.gz", line(columns[::-1]) + "\n" + line(values[::-1]) + "\n")
    escaped = str(plain).replace("[", "\\[").replace("]", "\\]")
    got = read_associations(spark, [escaped, str(more), str(tmp_path / "empty.tsv"), str(folder)])
    assert rows(got.select("rsID", "chr", "pos", "pubmedID", "trait")) == [(7, 12, 100, 3, 'a quoted trait')] * 4


def test_headers_where_only_spark_can_read(spark, tmp_path, monkeypatch):
    from dosegrid.sources import associations, blocks

    path = write_gz(tmp_path / "g.csv.gz", GWAS)
    uris = spark.read.text(path).inputFiles()
    monkeypatch.setattr(blocks, "_first_line", lambda uri: None)
    assert rows(blocks.first_lines(spark, uris).select("value")) == [(GWAS.split("\n")[0],)]
    assert read_associations(spark, [path]).count() == 3


def test_stored_panel_has_few_files_with_narrow_ranges(spark, tmp_path):
    sites = [site(str(k % 22 + 1), 10 * k, ["0|1"]) for k in range(2000)]
    text = lines(spark, {"f": (["A"], sites)})
    assert write_panel(text, str(tmp_path / "p"), partitions=8) == 2000
    files = list((tmp_path / "p").glob("chr=*/part-*.parquet"))
    assert len(files) <= 8 + 26
    ranges = (
        spark.read.parquet(str(tmp_path / "p"))
        .where("pos IS NOT NULL")
        .groupBy("chr", F.col("_metadata.file_path").alias("file"))
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
        .orderBy("chr", "low")
        .collect()
    )
    assert all(a.chr != b.chr or a.high < b.low for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("format", ["gvcf", "dbsnp"])
def test_partitions_are_honoured_without_output(spark, tmp_path, format, monkeypatch):
    from dosegrid.sources import catalogue

    stored, store = [], catalogue.durable  # the catalogue is stored as soon as it is parsed
    monkeypatch.setattr(catalogue, "durable", lambda df: stored.append(df) or store(df))
    path = write_gz(tmp_path / "a.gz", vcf_text(["A"], [site("1", k, ["0|1"]) for k in range(1, 50)]))
    loaded = load_variants(spark, [path], format=format, partitions=8)
    plan = (loaded.calls if format == "gvcf" else stored[0])._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(8)" in plan or "Repartition 8" in plan


def test_catalogue_is_stored_by_chromosome_or_in_buckets(spark, tmp_path):
    from dosegrid.sources import read_catalogue

    text = "".join(f"NC_00000{1 + k % 5}.1\t{10 + k}\trs{k}\tA\tC,G\t.\t.\tx\n" for k in range(40))
    path = write_gz(tmp_path / "d.gz", "#c\n" + text)
    plain = load_variants(spark, [path], format="dbsnp")
    by_chr = str(tmp_path / "by_chr")
    assert load_variants(spark, [path], format="dbsnp", output=by_chr, partition_by=["chr"]) == 120
    assert {p.name for p in (tmp_path / "by_chr").iterdir() if p.is_dir()} == {f"chr={k}" for k in range(1, 6)}
    back = spark.read.parquet(by_chr).select(*plain.columns)
    assert rows(back) == rows(plain)
    folder = str(tmp_path / "buckets")
    assert load_variants(spark, [path], format="dbsnp", output=folder, buckets=3) == 120
    stored = read_catalogue(spark, folder)
    assert rows(stored.by_place) == rows(stored.by_allele) == rows(plain)
    with pytest.raises(ValueError, match="buckets"):
        load_variants(spark, [path], format="gvcf", output=folder, buckets=3)


def test_catalogue_accessions(spark):
    df = spark.createDataFrame([("NC_000010.11",), ("NC_000010",), ("NC_000020",), ("NC_012920.1",), ("NT_1.1",), ("NC_0000101",)], "a string")
    assert [r.c for r in df.select(accession_code(F.col("a")).alias("c")).collect()] == [10, 10, 20, 25, None, None]
