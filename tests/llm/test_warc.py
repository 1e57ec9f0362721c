import gzip
import glob
import hashlib

import duckdb
import pytest

from logtide.llm import registry, warc
from tests.llm import cases


def _pages(spark):
    big = "<html>" + "x" * 1200 + "</html>"
    rows = [(i, f"http://host{i % 7}.example.org:80{i % 2}/p/{i}?q={i}", f"<p>{i}</p>" * (i % 300)) for i in range(300)]
    rows += [(1000 + i, "http://same.example.org/", big) for i in range(80)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://[bad", "é" * 900), (2003, "not a url \n\t x", "é" * 900), (2004, "HTTP://UPPER.example.ORG/A B", "short"),
             (2005, "http://h/", "short"), (-5, "http://neg/", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)


def test_query_equals_sql(spark, tmp_dir):
    df = _pages(spark)
    out = registry.QUERIES["op7_warc"](spark, cases.save(df, tmp_dir, "pages"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_dir}/pages.parquet/*.parquet')")
    rel = con.sql(registry.ORACLE["op7_warc"])
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert out.columns == order and rel.columns == order
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out.collect())) == sorted(map(key, rel.fetchall()))


def test_files_are_warc_and_lookups_find_one_key(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    df = _pages(spark)
    archive = warc.write_archive(df, f"{tmp_dir}/warc")
    names = glob.glob(f"{tmp_dir}/warc/*.warc.gz")
    assert names and all(gzip.open(n).read().startswith(b"WARC/1.1\r\n") for n in names)
    assert sum(gzip.open(n).read().count(b"WARC/1.1\r\nWARC-Type") for n in names) == df.count()
    key = warc.capture_key(warc.target_uri("http://same.example.org/", 1042), 1042)
    asked = spark.createDataFrame([(key,), (key,), ("org,nothing)/ 1",)], "capture string")
    found = warc.read_archive(archive, asked).collect()
    assert len(found) == 1 and found[0].page_id == 1042 and found[0].record_type == "revisit" and found[0].payload == b""
    everything = warc.read_archive(archive, archive.captures).collect()
    assert len(everything) == df.count()
    html = {r.page_id: (r.html or "").encode() for r in df.collect()}
    for r in everything:
        assert r.digest == hashlib.sha1(html[r.page_id]).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id]


def test_url_keys():
    assert warc.url_key("http://www.Example.org/A?b=C") == "org,example,www)/a?b=c"
    assert warc.url_key("http://h:8080") == "h:8080)/"
    assert warc.capture_key("http://h/", 2) < warc.capture_key("http://h/", 10) and warc.capture_key("http://h/", -1) < warc.capture_key("http://h/", 0)


@pytest.mark.parametrize("rows", [[], [(None, "http://a/", "z" * 2000), (None, "http://a/", "z" * 2000)], [(1, "u", "z" * 2000), (None, None, "z" * 2000), (1, "u", "z" * 2000)]])
def test_null_and_repeated_ids(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(df)
    out = warc.resolved(warc.read_archive(archive, archive.captures)).collect()
    assert len(out) == len(rows) and all(r.payload_bytes == 2000 for r in out)
    if any(r[0] is not None for r in rows):
        assert sorted((r.record_type, r.refers_to) for r in out if r.page_id is None) == [("revisit", 1)]


def test_one_id_with_several_payloads(spark):
    rows = [(9, "http://a/", "a" * 2000), (9, "http://b/", "b" * 3000), (1, "http://c/", "a" * 2000), (2, "http://d/", "b" * 3000), (9, "http://e/", "c" * 10)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(warc.read_archive(archive, archive.captures)).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got[:2] == [(1, 2000, sha("a" * 2000), "revisit", 9), (2, 3000, sha("b" * 3000), "revisit", 9)]
    assert {r[:4] for r in got if r[0] == 9} == {(9, 2000, sha("a" * 2000), "response"), (9, 3000, sha("b" * 3000), "response"), (9, 10, sha("c" * 10), "response")}
