import base64
import gzip
import hashlib
import json
import random
import re
import time
import zlib
from html import unescape

from factpanel.llm import markup, queries, warc


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_links_records(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = queries.op10_warc(spark, data).collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    by_page = {}
    for r in rows:
        page = pages[r["page_id"]]
        by_page.setdefault(r["page_id"], {})[r["record_type"]] = r
        assert r["target_uri"] == page["url"] and r["source_payload_digest"] == sha1(page["html"].encode())
        assert r["block_digest"] == sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    for page_id, pair in by_page.items():
        assert pair["metadata"]["refers_to"] == pair["conversion"]["refers_to"]
        envelope = json.loads(pair["metadata"]["block"])["Envelope"]
        assert dict(envelope["WARC-Header-Metadata"])["WARC-Record-ID"] == pair["metadata"]["refers_to"]
        response = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert response["Entity-Digest"] == pair["metadata"]["source_payload_digest"] and dict(response["Headers"])["Content-Type"].startswith("text/html")
        assert "<p>" not in pair["conversion"]["block"] and "track(" not in pair["conversion"]["block"]
        assert len(response["HTML-Metadata"]["Links"]) == pages[page_id]["html"].count("<a ")


def test_files_are_read_and_written(spark, tmp_path):
    html = "<html><head><title>Tï</title></head><body><p>One<p>Two<a href='/x'>l</a></body></html>".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-Odd: 1\r\n\r\n" + html
    head = lambda kind, n, i: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://e/{i}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {n}\r\n\r\n".encode()
    records = [head("warcinfo", 3, 0) + b"abc\r\n\r\n", head("response", len(block), 1) + block + b"\r\n\r\n"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(records[1] + head("response", 5, 2) + b"plain\r\n\r\n")
    read = warc.read_responses(spark, str(tmp_path))
    assert read.count() == 3
    out = warc.derive(read).collect()
    texts = sorted(r["block"] for r in out if r["record_type"] == "conversion")
    assert texts == ["One\nTwol", "One\nTwol", "plain"]
    meta = json.loads(next(r["block"] for r in out if r["record_type"] == "metadata" and r["target_uri"] == "http://e/1"))
    assert meta["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Head"]["Title"] == "Tï"
    written = b"".join(warc.record_bytes(r.asDict()) for r in out)
    again = list(warc.parse_records(written))
    assert [(h["WARC-Type"], h["WARC-Refers-To"], b.decode()) for h, b in ((dict(h), b) for h, b in again)] == [(r["record_type"], r["refers_to"], r["block"]) for r in out]


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, block string, date string, record_id string"
    rows = [(1, None, None, "?", "?", "?"), (None, "u", "", "?", "?", "?"), (2, "u", "<p>" + "x " * 200_000, "?", "?", "?"), (2, "u", "<p>same", "?", "?", "?"), (2, "u", "<p>same", "?", "?", "?")]
    df = spark.createDataFrame(rows, schema)
    out = warc.derive(warc.responses(df.drop("block", "date", "record_id"))).collect()
    assert len(out) == 10 and sum(r["block"] == "" for r in out) == 2
    assert warc.derive(warc.responses(df)).count() == 10
    assert warc.derive(warc.responses(df.where("false"))).count() == 0


def test_encoded_bodies_and_all_headers():
    html = b"<html><title>T</title><p>Caf\xc3\xa9 one</p><p>two</p></html>"
    packed = gzip.compress(html)
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    for body, more in ((packed, b"Content-Encoding: gzip\r\n"), (chunked, b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n"), (zlib.compress(html), b"content-encoding: deflate\r\n"), (html, b"Content-Encoding: gzip\r\n")):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: x\r\n y\r\n" + more + b"\r\n" + body
        metadata, conversion = warc.derived_of("r", "u", "d", "[]", block)
        assert conversion["block"] == "Café one\ntwo" and conversion["source_payload_digest"] == sha1(body)
        headers = json.loads(metadata["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
        assert [v for k, v in headers if k == "Set-Cookie"] == ["a=1", "b=2"] and ["X-Long", "x y"] in headers


def test_all_members_of_a_body_and_unknown_encodings():
    html = b"<html><title>T</title><p>one</p><p>two</p></html>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: %s\r\n\r\n"
    members = gzip.compress(html[:20]) + gzip.compress(html[20:33]) + gzip.compress(html[33:])
    for body in (members, members + b"rubbish", members + gzip.compress(b"x" * 100_000)[:3]):
        _, conversion = warc.derived_of("r", "u", "d", "[]", head % b"gzip" + body)
        assert conversion["block"] == "one\ntwo"
    large = b"<p>" + b" ".join(b"%d" % i for i in range(200_000))
    cut = gzip.compress(large)[:100_000]
    _, conversion = warc.derived_of("r", "u", "d", "[]", head % b"gzip" + cut)
    assert large.decode()[3:].startswith(conversion["block"]) and len(conversion["block"]) > 100_000
    for names, left in ((b"br", ["br"]), (b"br, gzip", ["br"]), (b"gzip, br", ["gzip", "br"])):
        body = gzip.compress(b"\x8b\x00brotli<p>no") if names.endswith(b"gzip") else b"\x8b\x00brotli<p>no"
        metadata, conversion = warc.derived_of("r", "u", "d", "[]", head % names + body)
        response = json.loads(metadata["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert conversion["block"] == "" and response["Undecoded-Content-Encoding"] == left
        assert conversion["source_payload_digest"] == sha1(body)
    metadata, _ = warc.derived_of("r", "u", "d", "[]", head % b"identity" + html)
    assert "Undecoded-Content-Encoding" not in metadata["block"]


def record(body, length=None, kind="response"):
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), hashlib.sha1(body).hexdigest().encode(), len(body) if length is None else length, body)


def test_a_wrong_length_costs_one_record(spark, tmp_path):
    inner = b"a body with\r\n\r\nWARC/1.0\r\n\r\nin it"
    bodies = [b"first", inner, b"", b"\xff\x00 bytes \xe9", b"last"]
    good = b"".join(map(record, bodies))
    assert [b for _, b in warc.parse_records(good)] == bodies
    for length in (10**9, 60, 3, 0):
        data = record(b"odd one", length) + good
        assert [b for _, b in warc.parse_records(data)][-5:] == bodies and len(list(warc.parse_records(data))) == 6
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(record(b"odd one", 10**8) + good)
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in bodies))
    (tmp_path / "in/c.warc.gz").write_bytes(gzip.compress(good)[:-30] + b"broken")
    for size in ("128m", "100b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = warc.read_responses(spark, str(tmp_path / "in")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len({r["page_id"] for r in rows}) == len(rows)
        blocks = sorted(bytes(r["block"]) for r in rows)
        for b in (b"first", b"last", b"odd one", b"\xff\x00 bytes \xe9"):
            assert blocks.count(b) >= (1 if b == b"odd one" else 2), (b, blocks)
        if size == "128m":
            assert blocks.count(inner) >= 2


def plain_text(html):
    """A page's blocks, one a line, for pages of whole elements: what stands between the tags that aren't inline."""
    html = re.sub(r"<!--.*?-->|<!.*?>|<(script|style|title|noscript|template|svg|iframe|object|select|textarea|button)\b.*?</\1\s*>", "", html, flags=re.S | re.I)
    html = re.sub(r"<br\s*/?>", " ", html)
    html = re.sub(r"</?(a|b|i|em|strong|span|small|code|sup|sub|u)\b[^>]*>", "", html)
    lines = (" ".join(unescape(x).split()) for x in re.split(r"<[^>]+>", html))
    return "\n".join(x for x in lines if x)


def test_conversion_texts_against_a_plain_account(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = [r for r in queries.op10_warc(spark, data).collect() if r["record_type"] == "conversion"]
    assert len(rows) == len(pages) and all(r["block"] == plain_text(pages[r["page_id"]]) for r in rows)


def test_broken_records_are_read_as_far_as_they_go():
    good = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nd e\r\n\r\n"
    assert [b for _, b in warc.parse_records(odd + good)] == [b"d e", b"abc"]
    assert [b for _, b in warc.parse_records(gzip.compress(good) * 3 + gzip.compress(odd)[:20])][:3] == [b"abc"] * 3
    assert list(warc.parse_records(b"\x1f\x8bbroken")) == [] and list(warc.parse_records(b"")) == []


def test_a_page_is_cut_into_tokens_once(monkeypatch):
    calls, tokens = [], markup.tokens
    monkeypatch.setattr(markup, "tokens", lambda html: calls.append(html) or tokens(html))
    html = "<title>T</title><p>one <a href=/x>l</a><br><li>two</div>three"
    metadata, conversion = warc.derived_of("r", "u", "d", "[]", html.encode())
    assert conversion["block"] == "one l\ntwothree" and '"/x"' in metadata["block"]
    assert calls == [html]


def test_lines_are_the_texts_of_blocks():
    parts = "<p> </p> <div> </div> <ul> <li> </ul> <table> <tr> <td> </table> <b> </b> <a> </a> <br> </br> <script> </script> <img> <dl> <dt> <dd> </dl> <body> </body> <!--x--> <a'b> <a<b < > ' \" x &amp; &am p;".split()
    choose = random.Random(5)
    for _ in range(2000):
        html = " ".join(choose.choices(parts, k=25))
        assert markup.lines(html, markup.tokens(html)) == [b[1] for b in markup.read(html).blocks], html


def test_names_without_an_end_are_read_once():
    before = time.process_time()
    html = "<a" * 40_000
    assert list(markup.tokens(html)) == [] and warc.derived_of("r", "u", "d", "[]", html.encode())[1]["block"] == html
    assert [t[:2] for t in markup.tokens("<a<b</i <!--x--><c <d>")] == [(8, 16), (19, 22)]
    assert [t[:2] for t in markup.tokens("<a<!--x <b>--><i>")] == [(2, 14), (14, 17)]
    assert time.process_time() - before < 5
