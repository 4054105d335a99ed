"""Records with headers longer than what is read at once."""

import hashlib

import pytest

from lodestone.llm import warc
from lodestone.storage import new_path


def test_long_urls_in_the_middle_of_an_archive(spark):
    rows = [(1, "http://a", "first"), (2, "http://b/" + "x" * 400_000, "long"), (3, "http://c/" + " " * 100_000, "blanks"), (4, None, "WARC/1.0\r\n" * 20_000), (5, "http://d", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc-long")
    got = {r.page_id: r for r in warc.round_trip(pages, path).collect()}
    assert {i: r.payload_digest for i, r in got.items()} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}
    for step in (warc.RANGE, 1 << 16):
        assert {int(r.id): r.url for r in warc.read_archives(spark, path, step).collect()} == {i: (u or "").replace(" ", "%20") for i, u, _ in rows}


def test_lost_records_raise(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id long, url string, html string")
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: read(*a).where("id <> '2'"))
    with pytest.raises(RuntimeError):
        warc.round_trip(pages, new_path(spark, "warc-lost"))
