import gzip
import json
import zlib

import pytest

from fluxweave.llm import warc
from tests.conftest import SMOKE

HTML = "<html><head><title> A  page </title></head><body><nav><a href='/b'>B</a></nav><p>Text &amp; more.</p><a href='c'>C</a></body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "mine", b"x") for r in rows], "page_id long, url string, html string, record_type string, block binary")


def test_derived_records(spark):
    pages = pages_of(spark, [(1, "http://x.net/a/", HTML)])
    response = warc.responses(pages).first()
    made = {r.record_type: r for r in warc.derivatives(warc.responses(pages), "page_id").collect()}
    assert set(made) == {"metadata", "conversion"}
    for r in made.values():
        assert (r.page_id, r.refers_to, r.target_uri, r.payload_digest) == (1, response.record_id, "http://x.net/a/", response.payload_digest)
        assert r.block_digest == warc.digest(bytes(r.block)) and r.record_id != response.record_id
    assert response.payload_digest == warc.digest(HTML.encode())
    assert bytes(made["conversion"].block).decode() == "B\nText & more.\nC"
    told = json.loads(bytes(made["metadata"].block))
    assert told["title"] == "A page" and told["http-headers"]["content-type"] == "text/html; charset=utf-8"
    assert told["outlinks"] == [{"tag": "a", "url": "http://x.net/b"}, {"tag": "a", "url": "http://x.net/a/c"}]
    assert told["text-digest"] == made["conversion"].block_digest


def test_files_round_trip(spark, tmp_path):
    pages = pages_of(spark, [(1, "http://x/1", HTML), (2, "http://x/2", "a\r\n\r\nWARC/1.1\r\nb"), (3, None, None), (4, "http://x/é y", "é😀\n\r\n")])
    records = warc.responses(pages).select(*warc.NAMES)
    records = records.unionByName(warc.derivatives(records))
    warc.write_files(records, str(tmp_path / "out"))
    key = lambda r: r.record_id
    got, want = (sorted(d.collect(), key=key) for d in (warc.read_files(spark, str(tmp_path / "out")), records))
    assert got == want and len(got) == 12


def test_bytes_parse_and_broken_files():
    record = {"record_type": "resource", "record_id": "<i>", "refers_to": None, "target_uri": "u", "date": "d", "content_type": "t", "payload_digest": None, "block_digest": "b", "http_headers": None, "block": b"xy"}
    data = warc.record_bytes(record)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: resource\r\n") and data.endswith(b"Content-Length: 2\r\n\r\nxy\r\n\r\n")
    assert [r["block"] for r in warc.parse_records(data * 3)] == [b"xy"] * 3
    assert [r["block"] for r in warc.parse_records(gzip.compress(data) * 2)] == [b"xy"] * 2
    assert len([*warc.parse_records(data + data[:-6])]) == 1 and [*warc.parse_records(b"")] == []


@pytest.mark.parametrize("coding,body", [("gzip", gzip.compress(b"<p>Hi you.")), ("deflate", zlib.compress(b"<p>Hi you.")), ("", b"<p>Hi you."), ("br", b"<p>Hi you."), ("gzip", b"<p>Hi you.")])
def test_codings(coding, body):
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 4]), body[i : i + 4]) for i in range(0, len(body), 4)) + b"0\r\n\r\n"
    for head, rest in ((b"", body), (b"Transfer-Encoding: chunked\r\n", chunked)):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n" + (f"Content-Encoding: {coding}\r\n".encode() if coding else b"") + head + b"\r\n" + rest
        made = warc.derive({"block": block, "record_id": "<r>", "target_uri": None, "date": None, "payload_digest": "p"})
        assert made[1]["block"] == b"Hi you."


def test_other_types():
    plain = warc.derive({"block": b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n<a> b", "record_id": "<r>", "target_uri": "u", "date": "d", "payload_digest": "p"})
    image = warc.derive({"block": b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89", "record_id": "<r>", "target_uri": "u", "date": "d", "payload_digest": "p"})
    assert plain[1]["block"] == b"<a> b" and image[1]["block"] == b""


def test_edges(spark):
    pages = pages_of(spark, [(None, None, None), (1, "", ""), (2, "u", HTML), (2, "u", HTML), (3, "u", "<p>" + "x " * 200_000)])
    made = warc.derivatives(warc.responses(pages), "page_id").collect()
    assert len(made) == 10 and {r.target_uri for r in made if r.page_id is None} == {"urn:page:None"}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    assert warc.derivatives(warc.responses(pages).selectExpr("*").filter("record_type = 'request'")).count() == 0


def test_query(spark):
    n = spark.read.parquet(f"{SMOKE}/pages.parquet").count()
    out = warc.op10_warc_derivatives(spark, SMOKE)
    assert out.count() == 2 * n and out.select("record_id").distinct().count() == 2 * n


def test_one_pass_gives_the_records_of_the_two_steps(spark):
    """The query's rows, made from the general operators and the bytes of their records."""
    from pyspark.sql import functions as F

    pages = pages_of(spark, [(1, "http://x.net/a/", HTML), (2, None, None), (None, "u v", "é😀<p>x</p>"), (3, "http://x", "<svg><p>a</p>")])
    real = spark.read.parquet(f"{SMOKE}/pages.parquet")
    for source in (pages, real):
        two = warc.with_bytes(warc.derivatives(warc.responses(source), "page_id")).select(
            "page_id", *[n for n in warc.NAMES if n not in ("block", "http_headers")], F.to_json("http_headers").alias("http_headers"),
            F.col("block").cast("string").alias("content"), F.length("block").cast("long").alias("content_length"), F.length("record").cast("long").alias("record_length"),
            F.sha2("record", 256).alias("record_sha256"),
        )
        one = warc.page_derivatives(source).withColumn("http_headers", F.to_json("http_headers")).select(*two.columns)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_links_are_resolved_as_the_library_does():
    import random
    from urllib.parse import urljoin

    draw = random.Random(6)
    parts = ["/", "a", "b.c", ".", "..", "//", "?q=1", "#f", ";p", "http://x.net", "https://y.org:80", "http:", "%20", "-", "é", " ", "mailto:z", "HTTP://X"]
    bases = ["http://x.net/a/", "https://y.org", "http://x.net/a/b?q#f", "http://x.net:80/", "", "urn:page:1", "x/y"]
    for _ in range(20_000):
        base, href = draw.choice(bases), "".join(draw.choice(parts) for _ in range(draw.randrange(5)))
        root = warc.ROOT.match(base)
        try:
            want = urljoin(base, href)
        except ValueError:
            want = href
        assert warc.resolved(base, root[0] if root else None, href) == want
