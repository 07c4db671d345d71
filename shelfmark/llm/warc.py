"""WARC derivatives: a metadata record and a plain-text conversion record for every response record.

Both refer to the response they were made from, keep its target, date and digests, and name each other. Record
ids follow from the response's id, so a repeated run, or a task that is run again, makes the same records.
Each response is handled by itself in a map over Arrow batches: no shuffle, and memory is one batch.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, read_table

VERSION = "WARC/1.1"
RESPONSE = "warc_headers map<string,string>, http_head string, payload binary"
RECORD = {"warc_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "warc_date": "string", "headers": "map<string,string>", "content": "binary"}
# Elements whose content is no text, and what only a head gives a meaning. Names end at a word's end, so <header> is no head.
RAW = re.compile(r"<!--|<(script|style|noscript|template|svg|head|/head|body|frameset|title|noframes|meta|link|base)(?![\w-])", re.IGNORECASE | re.ASCII)
NEXT = {name: re.compile(rf"<(/?){name}(?![\w-])", re.IGNORECASE | re.ASCII) for name in ("script", "style", "noscript", "title", "noframes")}
NESTED = re.compile(r"<!--|<(/?)(svg|template)(?![\w-])[^<>]*", re.IGNORECASE | re.ASCII)
#: A tag to its end, with ``>`` in quoted values.
WHOLE_TAG = re.compile(r"<[a-zA-Z]++(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|thead|tbody|h[1-6]|section|article|header|footer|nav|aside|main|pre|blockquote|form|figure|figcaption|option|address|title|body|html)\b[^<>]*>", re.IGNORECASE)
TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
SPACE = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\x20?\n\s*")
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.IGNORECASE)
LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.IGNORECASE)
LENGTH = re.compile(r"[0-9]{1,18}")
CHUNK = re.compile(rb"\s*([0-9A-Fa-f]{1,8})\s*(?:;.*)?", re.DOTALL)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def _comment_end(text: str, at: int) -> int:
    """The end of the comment whose ``<!--`` ends at ``at``, or -1."""
    for empty in (">", "->"):
        if text.startswith(empty, at):
            return at + len(empty)
    end = text.find("-->", at)
    return end + 3 if end >= 0 else -1


def _nested(text: str) -> dict[int, int]:
    """Where the closing tag of each ``svg`` and ``template`` that has one starts, by where the element starts."""
    open_, out, at, last = {"svg": [], "template": []}, {}, 0, text.rfind("-->")
    while m := NESTED.search(text, at):
        at = m.end()
        if not m[2]:
            at = _comment_end(text, at) if at <= last else at
        elif not m[1]:
            if not m[0].endswith("/"):
                open_[m[2].lower()].append(m.start())
        elif open_[m[2].lower()]:
            out[open_[m[2].lower()].pop()] = m.start()
    return out


def _without_raw(text: str) -> str:
    """Without comments and the elements whose content is no text.

    As in HTML, a comment, ``script`` or ``style`` that is never closed ends the text. Of other elements without a
    closing tag only the tag is left out. A head ends at its closing tag or where the body starts; all that it
    takes from the text is what HTML never shows, so text in a head that isn't closed stays.
    """
    out, at, in_head, nested = [], 0, False, None
    while m := RAW.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        name = m[1].lower() if m[1] else ""
        end = -1
        if not name:
            if (at := _comment_end(text, at)) < 0:
                return "".join(out)
        elif name in ("script", "style"):
            close = NEXT[name].search(text, at)
            while close and not close[1]:
                close = NEXT[name].search(text, close.end())
            if not close:
                return "".join(out)
            end = close.start()
        elif name in ("head", "/head", "body", "frameset"):
            in_head = name == "head"
            at = m.start() + 1
            out.append(text[m.start() : at])
            continue
        elif name in ("svg", "template"):
            nested = _nested(text) if nested is None else nested
            end = nested.get(m.start(), -1)
        elif name == "noscript" or (in_head and name in ("title", "noframes")):
            close = NEXT[name].search(text, at)
            end = close.start() if close and close[1] else -1
        elif not in_head or not (tag := WHOLE_TAG.match(text, m.start())):
            at = m.start() + 1
            out.append(text[m.start() : at])
            continue
        else:
            at = tag.end()
        if end >= 0:
            at = text.find(">", end) + 1 or len(text)
        elif name in ("noscript", "template", "svg", "title", "noframes"):
            at = m.start() + 1
            out.append(text[m.start() : at])
            continue
        out.append(" ")
    return "".join([*out, text[at:]])


def plain_text(markup: str) -> str:
    """The visible text, a line for each block; tags end at the next ``>``."""
    text = TAG.sub("", BLOCK.sub("\n", _without_raw(markup)))
    if "&" in text:
        text = html_.unescape(text)
    return LINES.sub("\n", SPACE.sub(" ", text)).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {record_id}')}>"


def _decoded(payload: bytes, http: dict[str, str]) -> bytes:
    """The body without its transfer and content codings; as it is where it is not what its headers say."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0 and (m := CHUNK.fullmatch(payload, at, end)) and (size := int(m[1], 16)):
            out.append(payload[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        payload = b"".join(out) if out else payload
    coding = http.get("content-encoding", "").lower().strip()
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            inflate = zlib.decompressobj(bits)
            try:
                return inflate.decompress(payload) + inflate.flush()
            except zlib.error:
                continue
    return payload


def derivatives(headers: dict[str, str], http_head: str, payload: bytes) -> list[dict]:
    """The two records of one response. Names of headers are matched in any case.

    A charset that neither the HTTP head nor the first 2,048 bytes of the body name is UTF-8.
    """
    given = {k.lower(): v for k, v in headers.items()}
    source = given.get("warc-record-id") or ""
    http = [tuple(x.strip() for x in line.split(":", 1)) for line in http_head.splitlines()[1:] if ":" in line]
    named = {k.lower(): v for k, v in http}
    payload_digest = given.get("warc-payload-digest") or digest(payload)
    payload = _decoded(payload, named)
    declared = CHARSET.search(named.get("content-type", "")) or CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        markup = payload.decode(declared[1] if declared else "utf-8", "replace")
    except LookupError:
        markup = payload.decode("utf-8", "replace")
    kept = {k: given[k.lower()] for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID") if given.get(k.lower())}
    kept |= {"WARC-Source-Payload-Digest": payload_digest}
    if given.get("warc-block-digest"):
        kept["WARC-Source-Block-Digest"] = given["warc-block-digest"]
    known_by = source or " ".join([given.get("warc-target-uri") or "", given.get("warc-date") or "", payload_digest])
    ids = {kind: derived_id(known_by, kind) for kind in ("metadata", "conversion")}
    title, language = TITLE.search(markup), LANG.search(markup)
    fields = [("title", html_.unescape(title[1]).strip() if title else ""), ("language", language[1] if language else ""), ("charset", declared[1] if declared else "utf-8"), ("http-status", http_head.split("\n", 1)[0].strip())]
    fields += [(f"source-{k.lower()}", v) for k, v in http]
    fields += [("outlink", html_.unescape(a or b or c)) for a, b, c in HREF.findall(markup)]
    described = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = []
    for kind, type_, body, other in (("metadata", "application/warc-fields", described, "conversion"), ("conversion", "text/plain; charset=utf-8", plain_text(markup).encode(), "metadata")):
        own = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Refers-To": source, **kept, "WARC-Related-To": ids[other], "Content-Type": type_, "WARC-Block-Digest": digest(body), "Content-Length": str(len(body))}
        out.append({"warc_type": kind, "record_id": ids[kind], "refers_to": source, "target_uri": given.get("warc-target-uri"), "warc_date": given.get("warc-date"), "headers": list(own.items()), "content": body})
    return out


def build_derivatives(responses: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows for each row of ``responses`` (``warc_headers, http_head, payload``): ``keep`` and a record's columns.

    Null headers, head or payload are empty. The records of a response without an id are known by its target, date
    and payload, and one without a payload digest is given the digest of its payload as it was sent. Repeated rows
    give equal records. An empty table gives an empty result. A record's column that ``keep`` names gets an
    underscore.
    """
    kept = responses.select(*keep)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    arrow = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content", pa.binary())])

    names = [own_name(kept, n) for n in arrow.names]
    record = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, RECORD.values(), strict=True))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                k = len(keep)
                rows = [derivatives(dict(h or ()), head or "", payload or b"") for h, head, payload in zip(*(batch.column(k + i).to_pylist() for i in range(3)))]
                index = pa.array([i for i, own in enumerate(rows) for _ in own], pa.int64())
                flat = [r for own in rows for r in own]
                made = [pa.array([r[f.name] for r in flat], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*(c.take(index) for c in batch.columns[:k]), *made], names=[*keep, *names])

    return responses.select(*keep, "warc_headers", "http_head", "payload").mapInArrow(build, ", ".join(filter(None, (types, record))))


def serialise(headers: list[tuple[str, str]] | dict[str, str], content: bytes) -> bytes:
    """One record as a gzip member; members of a file may simply be joined."""
    head = "".join(f"{k}: {v}\r\n" for k, v in dict(headers).items())
    return gzip.compress(f"{VERSION}\r\n{head}\r\n".encode() + content + b"\r\n\r\n", mtime=0)


def with_members(records: DataFrame, name: str = "member") -> DataFrame:
    """``records`` with their gzip members, ready to be joined to files."""

    @F.pandas_udf("binary")
    def member(headers, content):
        import pandas as pd

        return pd.Series([serialise(h, c) for h, c in zip(headers, content)])

    return records.withColumn(name, member("headers", "content"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file, compressed or not.

    A record without a valid length goes up to the next one.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = data[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if LENGTH.fullmatch(length):
            at = end + 4 + int(length)
        else:
            at = data.find(b"\r\n\r\nWARC/", end + 2)
            at = at if at >= 0 else len(data)
        yield headers, data[end + 4 : at]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files. A file is read as a whole, so files are best split at about 100 MB."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [(list(h.items()), *block.partition(b"\r\n\r\n")[::2]) for h, block in parse(data) if any(k.lower() == "warc-type" and v.lower() == "response" for k, v in h.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[1].decode("latin-1") for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["warc_headers", "http_head", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RESPONSE)


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as the response records of a crawl: ``id_col`` and a response's columns; ids follow from page id and url."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    hexed = F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), F.col(url_col)).cast("binary"))
    record = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    headers = F.create_map(*map(F.lit, ("WARC-Type", "response")), F.lit("WARC-Record-ID"), record, F.lit("WARC-Target-URI"), F.coalesce(F.col(url_col), F.lit("")), F.lit("WARC-Date"), F.lit(date), F.lit("Content-Type"), F.lit("application/http; msgtype=response"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(id_col, headers.alias("warc_headers"), head.alias("http_head"), payload.alias("payload"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page: their links, digests and sizes."""
    records = build_derivatives(responses_of(read_table(spark, sf_dir, "pages")), keep=["page_id"])
    return records.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        F.col("headers")["WARC-Related-To"].alias("related_to"),
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"),
        F.octet_length("content").cast("long").alias("content_length"),
        F.sha2("content", 256).alias("content_sha256"),
    )
