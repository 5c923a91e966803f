"""Block gzip against a plain read of the same file."""

import gzip
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dosegrid.sources import blocks, load_variants, read_blocks, read_lines, write_blocks
from dosegrid.sources.blocks import _END, _range_text, member_size, pack_member
from tests.test_sources import EXPECTED, sparse_rows, vcf_text
from tests.helpers import site


def packed(text, cuts):
    edges = [0, *sorted(cuts), len(text)]
    return b"".join(pack_member(text[a:b]) for a, b in zip(edges, edges[1:]) if b > a) + _END


def lines_of_ranges(data, step):
    """Lines of all ranges one after another."""
    out = []
    for start in range(0, len(data), step):
        for text in _range_text(io.BytesIO(data), start, start + step, len(data)):
            out += text.splitlines()
    return out


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text("abcé\r", max_size=6), max_size=12), st.booleans(),
    st.sets(st.integers(0, 60), max_size=8), st.integers(1, 400),
)
def test_lines_at_any_cut(lines, ends, cuts, step):
    text = ("\n".join(lines) + ("\n" if ends else "")).encode()
    data = packed(text, {c for c in cuts if c < len(text)})
    assert gzip.decompress(data) == text
    assert lines_of_ranges(data, step) == text.splitlines()


def test_a_start_within_packed_data_is_not_taken(monkeypatch):
    text = b"".join(b"%d %s\n" % (i, pack_member(b"x")[:18].replace(b"\n", b" ").replace(b"\r", b" ")) for i in range(500))
    data = b""
    for at in range(0, len(text), 700):  # stored members, so that the signs stay as they are
        import zlib

        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(text[at : at + 700]) + packer.flush()
        head = pack_member(b"")[:12] + b"BC\x02\x00" + (len(body) + 25).to_bytes(2, "little")
        tail = zlib.crc32(text[at : at + 700]).to_bytes(4, "little") + len(text[at : at + 700]).to_bytes(4, "little")
        data += head + body + tail
    data += _END
    assert gzip.decompress(data) == text
    for step in (50, 333, 1000, 5000):
        assert lines_of_ranges(data, step) == text.splitlines()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(0)
    text = "".join(f"line {i} " + rng.randbytes(rng.randint(0, 60)).hex() + "\n" for i in range(20_000)).encode()
    path = tmp_path / "big file [1].txt.gz"
    path.write_bytes(packed(text, range(0, len(text), 60_000)))
    uri = str(path).replace("[", "\\[").replace("]", "\\]")
    got = read_lines(spark, [uri], range_bytes=30_000)
    with_task = got.withColumn("task", F.spark_partition_id())
    assert with_task.select("task").distinct().count() >= 8
    assert sorted(r.value for r in got.collect()) == sorted(text.decode().splitlines())
    assert got.select("source").distinct().count() == 1


def test_mixed_with_plain_gzip(spark, tmp_path):
    a = vcf_text(["A", "B"], [site("1", 10, ["0|1", "1|1"], id="rs1"), site("X", 20, ["1|2", "."], id="rs2")])
    b = vcf_text(["B", "C"], [site("2", 30, ["0|1", "./."], id="rs3")])
    (tmp_path / "a.vcf.gz").write_bytes(packed(a.encode(), {40, 90, 130}))
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as file:
        file.write(b)
    assert sparse_rows(load_variants(spark, [str(tmp_path)], format="gvcf")) == EXPECTED
    assert sparse_rows(load_variants(spark, [str(tmp_path / "*.gz")], format="gvcf", partitions=3)) == EXPECTED


def test_all_files_block_gzip_reads_nothing_twice(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(packed(b"one\ntwo\n", {2}))
    (tmp_path / "empty.bgz").write_bytes(_END)
    got = read_lines(spark, [str(tmp_path)])
    assert sorted(r.value for r in got.collect()) == ["one", "two"]
    assert "Scan text" not in got._jdf.queryExecution().toString()


def test_files_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.gz").write_bytes(packed(b"one\ntwo\n", {2}))
    monkeypatch.setattr(blocks, "_is_block_gzip", lambda uri: False)
    assert sorted(r.value for r in read_lines(spark, [str(tmp_path)]).collect()) == ["one", "two"]


def test_written_blocks(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"value {i} é" + "y" * 900) for i in range(600)]
    lines = spark.createDataFrame(rows, "source string, nth int, value string").repartition(4)
    done = write_blocks(lines, str(tmp_path / "out"), ["nth"], suffix=".gz")
    assert sorted(map(tuple, done.collect())) == [(f"f{i}", 200) for i in range(3)]
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == ["f0.gz", "f1.gz", "f2.gz"]
    data = (tmp_path / "out" / "f1.gz").read_bytes()
    assert member_size(data) and data.endswith(_END)
    assert gzip.decompress(data).decode().splitlines() == [v for f, _, v in rows if f == "f1"]
    back = read_lines(spark, [str(tmp_path / "out")], range_bytes=2_000)
    assert sorted(r.value for r in back.collect()) == sorted(v for *_, v in rows)


def test_broken_block_is_an_error(spark, tmp_path):
    data = packed(b"one\ntwo\nthree\n", {4, 8})
    (tmp_path / "a.gz").write_bytes(data[:-40])
    with pytest.raises(Exception, match="broken block|incomplete|Error"):
        read_lines(spark, [str(tmp_path)]).collect()
    assert read_blocks(spark.createDataFrame([], "source string, size long")).count() == 0


def test_lines_are_not_broadcast_for_the_size_of_their_ranges(spark, tmp_path):
    for name in "abc":
        text = "".join(f"{name} {i} {'x' * 2000}\n" for i in range(3000)).encode()
        (tmp_path / f"{name}.txt.gz").write_bytes(packed(text, range(0, len(text), 60_000)))
    lines = read_lines(spark, [str(tmp_path)], range_bytes=1000)
    last = lines.groupBy("source").agg(F.max(F.repeat("value", 5)).alias("last"))
    joined = lines.join(last, "source").select(F.length("value"), F.length("last"))
    assert len(joined.collect()) == 9000
    final = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BuildLeft" not in final  # the lines are on the left
