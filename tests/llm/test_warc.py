import base64
import gzip
import hashlib

import pytest
from pyarrow import fs

from roadsky.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [
    (1, "http://www.example.org/a?b=1", "<p>é\r\n\r\nx</p>"),
    (2, "http://example.org/", "same"),
    (3, "http://example.org/", "same"),
    (4, "http://example.org/", "same"),
    (5, None, None),
    (6, "not a url at all", ""),
    (7, "http://b.example.com:8080/x y\tz", "z" * 300_000),
    (8, "http://[bad", "WARC/1.1\r\n\r\n"),
    (None, "http://example.org/none", "same"),
    (None, None, "only here"),
    (4, "http://example.org/", "same"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "x", 5) for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, keeper int")


def test_records_come_back(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc.op1_warc(spark, str(tmp_path)).collect()
    largest = {}
    for i, _, h in PAGES:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        keeper = largest.get(h or "")
        revisit = keeper is not None and i != keeper
        want.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", keeper if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_payloads_can_all_be_responses(spark, pages):
    captures = warc.write_archives(pages, least_bytes=1000)
    rows = warc.read_records(captures).collect()
    assert {r["record_type"] for r in rows} == {"response"}
    assert {bytes(r["payload"]) for r in rows} == {(h or "").encode() for _, _, h in PAGES}


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_lookup_by_url_over_blocks_and_shards(spark, pages, monkeypatch, size):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", size)
    monkeypatch.setattr(warc, "SHARD_CAPTURES", 3)
    index = warc.build_index(warc.write_archives(pages))
    keys = spark.createDataFrame([(warc.reversed_host(u) + " ",) for u in ("http://EXAMPLE.org/", "http://nowhere.example/")], "key string")
    found = warc.read_records(warc.locate(index, keys)).collect()
    assert sorted(r["page_id"] for r in found) == [2, 3, 4, 4]


def test_archives_are_plain_gzip_members(spark, pages):
    captures = warc.write_archives(pages).collect()
    data = {}
    for c in captures:
        files, path = fs.FileSystem.from_uri(c["file"])
        with files.open_input_stream(path, compression=None) as source:
            data[c["file"]] = source.read()
    assert sum(gzip.decompress(d).count(b"WARC-Record-ID: ") for d in data.values()) == len(PAGES)
    assert warc.reversed_host("http://www.Example.org:80/p?q=1") == "org,example,www:80)/p?q=1"


def test_empty(spark, pages, tmp_path):
    pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0
