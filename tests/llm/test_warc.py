import base64
import gzip
import hashlib
import pathlib
import zlib

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from geomarket.llm import warc


def expected(rows, least=0):
    """Bag of results by plain Python; of equal ids one row is the response."""
    best = {}
    for k, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            best.setdefault(data, []).append(k)
    out = []
    for data, ids in best.items():
        ids.sort(key=lambda k: (k is not None, k or 0))
        out += [(k, data, "response" if n == len(ids) - 1 else "revisit", None if n == len(ids) - 1 else ids[-1])
                for n, k in enumerate(ids)]
    out += [(k, (h or "").encode(), "response", None) for k, h in rows if len((h or "").encode()) < least]
    return sorted(((k, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), t, r) for k, d, t, r in out), key=str)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(5)
    rows = [(r.page_id, r.html) for r in pages.select("page_id", "html").collect()]
    found = warc.archive_pages(pages, limit=20_000).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


@pytest.fixture
def odd_pages(spark):
    mark = "WARC/1."
    rows = [(1, None, "http://a.b/c"), (2, "", "x"), (None, "no id", "y"), (3, "same", None), (4, "same", "u\r\nX: 1"),
            (4, "same", "again"), (-7, "same", mark), (None, "same", ""), (5, f"{mark}1\r\n\r\n{mark}{mark}0\r\n", f"{mark}1"),
            (6, "\r\n\r\n", "z"), (7, "é𝄞\x00 end\r\n\r\n", "z"), (8, "long " * 1_000_000, "z"), (9, "no id", "q"), (10, "tied", "t1"), (10, "tied", "t2"), (10, "tied", "t3")]
    return spark.createDataFrame(rows, "page_id long, html string, url string").selectExpr(
        "*", "1 as row", "2 as bytes", "'d' as digest", "3 as kept", "4 as id", "5 as uri", "6 as payload", "7 as block", "8 as name", "9 as sha1", "10 as maybe")


def test_odd_pages(odd_pages):
    rows = [(r.page_id, r.html) for r in odd_pages.collect()]
    for least in (0, 5):
        found = warc.archive_pages(odd_pages.coalesce(1), least_bytes=least).collect()
        assert sorted(map(tuple, found), key=str) == expected(rows, least)


def test_no_pages(odd_pages):
    found = warc.archive_pages(odd_pages.where("false"))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert found.count() == 0


def test_each_record_is_a_member_at_its_offset(spark, odd_pages, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_archives(odd_pages.repartition(2), raw)
    streams = [gzip.decompress(p.read_bytes()) for p in pathlib.Path(raw).glob("part-*")]
    for p in pathlib.Path(raw).glob("part-*"):
        whole = zlib.decompressobj(wbits=31)
        whole.decompress(p.read_bytes())
        assert whole.eof and whole.unused_data == b"", "one stream for the whole file"
    warc.normalise(spark, raw, out, limit=1500)
    index = warc.read_index(spark, out).orderBy("archive", "number").collect()
    files = {p.parent.name.removeprefix("archive="): p.read_bytes() for p in pathlib.Path(out).glob("part=archives/*/part-*")}
    assert len(index) == odd_pages.count() and len(files) > 2
    bodies = [zlib.decompress(files[r.archive][r.offset:r.offset + r.length], wbits=31) for r in index]
    assert all(b.startswith(b"WARC/1.1\r\n") and b.endswith(b"\r\n\r\n") for b in bodies)
    assert sorted(bodies) == sorted(b for s in streams for _, b in warc.whole_records(
        iter([("f", c) for c in s.split(b"WARC/1.")])))
    # Of rows that share id and payload every URL is kept.
    assert {"t1", "t2", "t3"} == {r.target_uri for r in index if (r.target_uri or "").startswith("t")}
    assert len({r.record_id for r in index}) == len(index)
    by_index = warc.read_records(spark, out, warc.read_index(spark, out)).collect()
    assert sorted(by_index, key=str) == sorted(warc.read_records(spark, out).collect(), key=str)
    # Other tools read the archives as plain gzip files.
    assert sorted(b"".join(gzip.decompress(f) for f in files.values())) == sorted(b"".join(streams))


def test_records_above_16_mb(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").withColumn(
        "html", F.when(F.col("page_id") == 1, F.repeat(F.lit("0123456789abcdef"), 1_100_000)).otherwise(F.col("html")))
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_archives(pages.coalesce(1), raw)
    warc.normalise(spark, raw, out)
    (file,) = pathlib.Path(out).glob("part=archives/*/part-*")
    assert len(gzip.decompress(file.read_bytes())) > 17_600_000
    assert sorted(r.payload_bytes for r in warc.read_records(spark, out).collect()) == [1, 17_600_000]


def test_some_records_with_their_payload(spark, odd_pages, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_archives(odd_pages, raw)
    warc.normalise(spark, raw, out)
    wanted = warc.read_index(spark, out).where("record_id like '%page:6:%' or record_id like '%page:7:%'")
    found = warc.read_records(spark, out, wanted, payload=True).collect()
    assert sorted(bytes(r.payload) for r in found) == ["\r\n\r\n".encode(), "é𝄞\x00 end\r\n\r\n".encode()]


def test_damaged_archives_fail(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for name, data in {"cut": good + good[:-5], "long": good.replace(b"3", b"2"), "none": good.replace(b"Content-L", b"L"),
                       "before": b"junk" + good}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gz").write_bytes(gzip.compress(data))
        with pytest.raises(PythonException):
            warc.normalise(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"))
