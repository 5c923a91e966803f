"""Archives: round trips, pushdown, skipping, unfinished jobs."""

import gzip
import hashlib
import io
import os
import zlib

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import _parse_datatype_string

from dosegrid.llm.warc import (
    SCHEMA,
    WarcReader,
    member,
    read_pages,
    record_bytes,
    records,
    register,
    through_archives,
    write_archives,
)


@pytest.fixture
def make_pages(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")


def plain(rows):
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i is not None and len(body) >= 1000 and i < largest[html]
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    largest[html] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(make_pages, compression):
    rows = [(i, f"http://h/{i}", f"{'é' * (400 + 50 * (i % 7))}\r\n\r\nWARC/1.1\r\n{i % 7}") for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "x" * 999), (103, "u", "x" * 999),
             (104, "u", "y" * 1000), (105, "u", "y" * 1000), (None, "u", "y" * 1000), (105, "u", "y" * 1000),
             (-3, "u", "y" * 1000), (106, "u", "z" * 3_000_000)]
    got = through_archives(make_pages(rows), compression).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_empty_table(make_pages):
    assert through_archives(make_pages([])).count() == 0


def test_filters_are_pushed_and_payloads_skipped():
    reader = WarcReader({"path": "x"}, _parse_datatype_string(SCHEMA))
    left = list(reader.pushFilters([
        EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")),
        GreaterThan(("content_length",), 3), EqualTo(("content_length",), 3),
    ]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo]
    assert reader._wanted({"WARC-Type": "response", "WARC-Target-URI": "b"})
    assert not reader._wanted({"WARC-Type": "revisit", "WARC-Target-URI": "b"})


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("pack", [member, lambda r: r], ids=["gzip", "plain"])
def test_unwanted_bodies_are_not_read(pack):
    noise = os.urandom(1 << 20)
    big = [record_bytes({"WARC-Type": "response", "WARC-Record-ID": str(i)}, noise) for i in range(5)]
    small = record_bytes({"WARC-Type": "revisit", "WARC-Record-ID": "last"}, b"")
    file = Counted(b"".join(map(pack, [*big, small])))
    found = list(records(file, lambda h: h["WARC-Type"] == "revisit", True))
    assert [h["WARC-Record-ID"] for h, _ in found] == ["last"]
    assert file.taken < 1 << 20


def test_members_without_lengths_and_damage():
    rows = [record_bytes({"WARC-Type": "response", "WARC-Record-ID": str(i)}, bytes([i]) * 100_000) for i in range(3)]
    file = io.BytesIO(b"".join(map(gzip.compress, rows)))
    assert [(h["WARC-Record-ID"], p) for h, p in records(file, lambda h: h["WARC-Record-ID"] != "1", True)] == [
        ("0", bytes(100_000)), ("2", b"\x02" * 100_000)
    ]
    assert gzip.decompress(member(rows[1])) == rows[1]
    with pytest.raises((ValueError, zlib.error)):
        list(records(io.BytesIO(rows[0][:-500]), lambda h: True, True))
    with pytest.raises(ValueError):
        list(records(io.BytesIO(b"HTTP/1.1 200\r\n\r\n"), lambda h: True, True))
    assert list(records(io.BytesIO(b""), lambda h: True, True)) == []


def test_one_member_holds_many_records():
    rows = [record_bytes({"WARC-Type": "response", "WARC-Record-ID": str(i)}, bytes([i]) * 100_000) for i in range(3)]
    whole = gzip.compress(b"".join(rows))
    cut = b"".join(gzip.compress(b"".join(rows)[at : at + 70_000]) for at in range(0, 400_000, 70_000))
    for data in (whole, cut, whole + whole, cut + bytes(512)):
        found = list(records(io.BytesIO(data), lambda h: True, True))
        assert [(h["WARC-Record-ID"], len(p)) for h, p in found][:3] == [(str(i), 100_000) for i in range(3)]
        assert len(found) == (6 if data == whole + whole else 3)
        some = list(records(io.BytesIO(data), lambda h: h["WARC-Record-ID"] == "2", True))
        assert [p for _, p in some][0] == rows[2][-100_004:-4]


def test_header_names_in_any_case():
    text = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <a>\r\ncontent-length: 5\r\nX-Own: 1\r\n\r\nhello\r\n\r\n"
    odd = b"\r\n" + text + b"\r\n\r\n" + text.rstrip()  # more blank lines than there should be, and none at the end
    found = list(records(io.BytesIO(odd), lambda h: h["WARC-Type"] == "response", True))
    assert [(h["WARC-Record-ID"], h["X-Own"], p) for h, p in found] == [("<a>", "1", b"hello")] * 2


def test_http_messages(spark, tmp_path):
    register(spark)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nbody</p>"
    head = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Type": "application/http; msgtype=response"}
    (tmp_path / "a.warc").write_bytes(record_bytes(head, block))
    read = spark.read.format("warc").load(f"file://{tmp_path}/a.warc")
    row = read.first()
    assert bytes(row.payload) == b"<p>\r\n\r\nbody</p>" and row.content_length == len(block)
    assert row.headers["http"].startswith("HTTP/1.1 200 OK")
    read.write.format("warc").mode("append").save(f"file://{tmp_path}/b")
    again = spark.read.format("warc").load(f"file://{tmp_path}/b").first()
    assert bytes(again.payload) == bytes(row.payload) and again.headers["http"] == row.headers["http"]


def test_clashing_columns_and_no_broadcast(make_pages, clashing, no_broadcast):
    rows = [(i, "u", f"{i % 3}" * 1500) for i in range(9)]
    got = through_archives(clashing(make_pages(rows))).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_unlisted_archives_are_not_read(spark, make_pages, tmp_path):
    path = f"file://{tmp_path}/a"
    write_archives(make_pages([(1, "u", "one"), (2, "v", "two")]), path)
    stray = record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:9>"}, b"stray")
    (tmp_path / "a" / "part-stray.warc").write_bytes(stray)
    assert sorted(r.page_id for r in read_pages(spark, path).collect()) == [1, 2]
    register(spark)
    one = spark.read.format("warc").load(f"{path}/part-stray.warc").first()
    assert bytes(one.payload) == b"stray" and one.content_length == 5
    by_type = spark.read.format("warc").load(path).where("record_type = 'response' AND target_uri = 'v'")
    assert [bytes(r.payload) for r in by_type.collect()] == [b"two"]
