import base64
import gzip
import hashlib
import zlib
from html.parser import HTMLParser

import duckdb
from pyspark.sql import functions as F

from shelfmark.llm.warc import build_derivatives, derivatives, digest, parse, plain_text, read_responses, responses_of, with_members

PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- no --><p>One<b>two</b> &lt;3</p><style>p{}</style><div>x<br>y</div><a href="/q?a=1&amp;b=2">l</a><script>never closed'


def test_plain_text():
    assert plain_text(PAGE) == "Onetwo <3\nx\ny\nl"
    assert plain_text("") == ""
    assert plain_text("a < b and <i>c</i>") == "a < b and c"
    assert plain_text("<!-- open") == ""
    assert len(plain_text("<p>word</p>" * 50_000)) == 5 * 50_000 - 1
    assert plain_text("<" * 100_000).startswith("<")


def test_elements_that_are_never_closed_keep_their_text():
    assert plain_text("<html><head><title>T</title><body><p>hello") == "hello"
    assert plain_text("<head><title>T</title><meta content='a > b'><p>hello<header>top</header>tail") == "hello\ntop\ntail"
    assert plain_text("<head><title>A</title><body>one<html><head><title>B</title></head><body>two") == "one\ntwo"
    assert plain_text("<p>İ a<SCRIPT>x</SCRIPT>b<STYLE>y</STYLE>c") == "İ a b c"
    for name in ("svg", "noscript", "template"):
        assert plain_text(f"<{name}>a<p>b") == "a\nb"
        assert plain_text(f"a<{name}>x</{name.upper()}>b") == "a b"
        assert len(plain_text(f"<{name}><!--" * 50_000)) == 0
    assert plain_text("<svg><svg></svg>in</svg>out") == "out"
    assert plain_text("<svg/>a<svg-icon>b</svg-icon><!-->c") == "ab c"
    assert plain_text("a<style>b") == "a"


def pages(spark):
    rows = [(1, "http://a/", PAGE, 9), (2, None, None, 9), (3, "http://b/", "", 9), (3, "http://b/", "", 9), (None, "http://c/", "<p>é" + "x" * 100_000, 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, content int")


def test_records_are_linked_and_keep_digests(spark):
    responses = responses_of(pages(spark)).collect()
    records = build_derivatives(responses_of(pages(spark)), ["page_id"]).collect()
    assert len(records) == 2 * len(responses)
    by_id = {r.record_id: r for r in records}
    sources = {dict(r.warc_headers)["WARC-Record-ID"]: r for r in responses}
    for r in records:
        other = by_id[r.headers["WARC-Related-To"]]
        assert {r.warc_type, other.warc_type} == {"metadata", "conversion"} and other.refers_to == r.refers_to
        source = sources[r.refers_to]
        assert r.headers["WARC-Source-Payload-Digest"] == digest(bytes(source.payload))
        assert r.target_uri == dict(source.warc_headers)["WARC-Target-URI"] and r.warc_date == "2024-01-01T00:00:00Z"
        assert r.headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.content)).digest()).decode()
        assert int(r.headers["Content-Length"]) == len(r.content)
    first = next(r for r in records if r.page_id == 1 and r.warc_type == "metadata")
    assert b"title: A & B\r\nlanguage: fr\r\n" in first.content and b"outlink: /q?a=1&b=2\r\n" in first.content
    assert b"source-content-type: text/html; charset=utf-8" in first.content


def test_members_round_trip_through_a_file(spark, tmp_path):
    records = with_members(build_derivatives(responses_of(pages(spark)), ["page_id"])).collect()
    parsed = list(parse(b"".join(r.member for r in records)))
    assert [(h["WARC-Record-ID"], b) for h, b in parsed] == [(r.record_id, bytes(r.content)) for r in records]


def test_reading_responses_from_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + record)
    out = build_derivatives(read_responses(spark, str(tmp_path)), []).where("warc_type = 'conversion'").collect()
    assert [bytes(r.content).decode() for r in out] == ["café"] and out[0].refers_to == "<urn:uuid:1>"


class Visible(HTMLParser):
    """The visible text by the standard library's parser: an independent form for well-formed pages."""

    HIDDEN = {"script", "style", "noscript", "template", "svg"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "small", "code", "sup", "sub", "u", "img", "input", "label", "button", "link", "meta"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth, self.head = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        self.head = self.head or tag == "head"
        self.head = self.head and tag != "body"
        self.out.append("" if tag in self.INLINE else "\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0
        self.head = self.head and tag != "head"
        self.out.append("" if tag in self.INLINE else "\n")

    def handle_data(self, data):
        if not self.depth and not self.head:
            self.out.append(data)


def test_text_of_whole_pages_matches_another_parser():
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    assert len(pages) > 100
    for page in pages:
        other = Visible()
        other.feed(page)
        other.close()
        assert plain_text(page).split() == "".join(other.out).split()


def test_headers_in_any_case_and_codings():
    body = "<p>Grüße</p>".encode()
    chunked = b"5\r\n" + body[:5] + b"\r\n" + b"%x;x=1\r\n" % len(body[5:]) + body[5:] + b"\r\n0\r\n\r\n"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    text = lambda extra, data: derivatives({"warc-record-id": "<a>", "warc-target-uri": "u"}, head + extra, data)[1]
    for extra, data in (("", body), ("Transfer-Encoding: chunked", chunked), ("content-encoding: gzip", gzip.compress(body)), ("Content-Encoding: deflate", zlib.compress(body)), ("Content-Encoding: deflate", zlib.compress(body)[2:-4])):
        r = text(extra, data)
        assert r["content"].decode() == "Grüße" and r["refers_to"] == "<a>" and r["target_uri"] == "u"
        assert dict(r["headers"])["WARC-Source-Payload-Digest"] == digest(data)
    assert text("Transfer-Encoding: chunked", body)["content"].decode() == "Grüße"
    assert text("Content-Encoding: gzip", body)["content"].decode() == "Grüße"


def test_responses_without_an_id_have_records_of_their_own():
    ids = {r["record_id"] for uri, data in (("u", b"x"), ("v", b"x"), ("u", b"y")) for r in derivatives({"WARC-Target-URI": uri}, "", data)}
    assert len(ids) == 6


def test_lengths_that_are_no_numbers():
    record = lambda length, block: b"WARC/1.1\r\nwarc-type: response\r\ncontent-length: %b\r\n\r\n%b\r\n\r\n" % (length, block)
    assert [b for _, b in parse(record(b"x", b"one") + record(b"-3", b"two") + record(b"5", b"three"))] == [b"one", b"two", b"three"]
    assert [b for _, b in parse(b"WARC/1.1\r\nA: b\r\n\r\nrest")] == [b"rest"]


def test_clashing_names(spark):
    responses = responses_of(pages(spark)).withColumn("content", F.lit(7)).withColumn("headers", F.lit("h"))
    out = build_derivatives(responses, ["page_id", "content", "headers"])
    assert out.columns == ["page_id", "content", "headers", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "headers_", "content_"]
    assert {(r.content, r.headers) for r in out.collect()} == {(7, "h")}


def test_empty_and_null(spark):
    assert build_derivatives(responses_of(pages(spark).where("false")), ["page_id"]).count() == 0
    none = spark.createDataFrame([(None, None, None)], "warc_headers map<string,string>, http_head string, payload binary")
    assert build_derivatives(none, []).count() == 2
