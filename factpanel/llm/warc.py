"""WARC records: responses read or made, and their metadata and conversion records.

``derive`` turns each response into two records.  The metadata record is JSON with the source's WARC
and HTTP headers, the page's title, meta tags and links; the conversion record is the page's text, a
block a line.  Both name the response in WARC-Refers-To, keep its target address and date, and carry
its payload digest beside their own block digest.  Identifiers are derived from the source's, so a
recomputed task makes the same records.

Cases: a null payload is empty and gives an empty conversion; a null address or date is written as
the empty text; responses that aren't HTTP keep their bytes as payload; repeated rows give repeated
records; broken headers are kept as far as they read; an empty table gives no rows; extra columns are
ignored.  A body whose content encoding isn't known, such as br, has an empty conversion, and the
metadata names the encoding; a very long body is unpacked and read whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markup
from .arrow import append_columns, explode_columns, record_batch, slices

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of addresses, RFC 4122
DATE = "1970-01-01T00:00:00Z"
ENCODINGS = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}  #: content encodings that are taken off, with zlib's window bits
PIECE = 1 << 16
LINKED = frozenset("a link img script iframe area form".split())
Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


RESPONSE = T.StructType([T.StructField(n, k) for n, k in (("record_id", T.StringType()), ("target_uri", T.StringType()), ("date", T.StringType()), ("warc_headers", T.StringType()), ("block", T.BinaryType()))])


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of fetched pages: the id column and the columns of RESPONSE."""

    def work(ids: list, urls: list, htmls: list) -> list:
        columns: list[list] = [[] for _ in RESPONSE.fields]
        for page, url, html in zip(ids, urls, htmls, strict=True):
            payload = (html or "").encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
            name = record_id("response", page, url, date)
            headers = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": url or "", "WARC-Date": date, "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
            for column, value in zip(columns, (name, url or "", date, json.dumps(list(headers.items())), block), strict=True):
                column.append(value)
        return columns

    return append_columns(pages, [id_col, url_col, html_col], RESPONSE.fields, work, [id_col])


def value_of(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _headers(lines: list[str]) -> Headers:
    """Headers in order, repeated ones too; a line that begins with white space goes on with the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line.strip():
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload; a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], _headers(lines[1:]), payload


def _unchunked(data: bytes) -> bytes:
    """A body of chunks put together; one that isn't of chunks stays as it is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            return data if not out else b"".join(out)
        if size == 0:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out or data.startswith(b"0") else data


def _inflated(data: bytes, bits: int) -> bytes | None:
    """All members of a compressed body, as far as they read; None if the first one doesn't begin."""
    out, read = [], False
    while data:
        member, size = zlib.decompressobj(bits), 0
        try:
            for at in range(0, len(data), PIECE):
                part = member.decompress(data[at : at + PIECE])
                out.append(part)
                read, size = True, size + len(part)
                if member.eof:
                    break
        except zlib.error:
            if not size:
                break
            return b"".join(out)
        if not member.eof:
            break
        data = member.unused_data + data[at + PIECE :]
        if bits < 16:  # only gzip bodies have several members
            break
    return b"".join(out) if read else None


def entity(headers: Headers, payload: bytes) -> tuple[bytes, list[str]]:
    """The payload without its transfer and content encodings, and the encodings that it still has.

    Encodings are taken off from the last one on; the first that isn't known ends it.  A body that
    says it is compressed and isn't stays as it is; one that breaks off is taken as far as it reads.
    """
    if "chunked" in (value_of(headers, "Transfer-Encoding") or "").lower():
        payload = _unchunked(payload)
    names = [x.strip().lower() for k, v in headers if k.lower() == "content-encoding" for x in v.split(",")]
    names = [n for n in names if n and n != "identity"]
    while names:
        if names[-1] not in ENCODINGS:
            return payload, names
        for bits in ENCODINGS[names.pop()]:
            body = _inflated(payload, bits)
            if body is not None:
                payload = body
                break
    return payload, []


def page_metadata() -> dict:
    return {"Head": {"Title": "", "Metas": []}, "Links": []}


def noted(html: str, found: Iterable[markup.Token], metadata: dict) -> Iterator[markup.Token]:
    """The page's tokens, handed on one by one, with its title, meta tags and links put into the metadata on the way."""
    head, metas, links = metadata["Head"], metadata["Head"]["Metas"], metadata["Links"]
    for token in found:
        start, end, slash, tag, attribute_text = token
        if tag == "title" and slash == "raw" and not head["Title"]:
            head["Title"] = markup.squeeze(re.sub(r"</title\s*>\Z", "", html[start:end].partition(">")[2], flags=re.I))
        named = markup.attributes(attribute_text) if tag == "meta" or tag in LINKED and slash != "/" else {}
        if tag == "meta" and named:
            metas.append(named)
        elif named:
            links += [{"path": f"{tag.upper()}@/{key}", "url": named[key]} for key in ("href", "src", "action") if key in named]
        yield token


DERIVED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("source_payload_digest", T.StringType()),
        T.StructField("source_block_digest", T.StringType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("block", T.StringType()),
    ]
)


def derived_of(name: str, uri: str, date: str, warc_headers: str, block: bytes) -> list[dict]:
    status, headers, payload = parse_http(block)
    charset = re.search(r"charset=[\"']?([\w-]+)", value_of(headers, "Content-Type") or "")
    body, undecoded = entity(headers, payload)
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    if undecoded:
        html = ""
    metadata = page_metadata()
    text = "\n".join(markup.lines(html, noted(html, markup.tokens(html), metadata)))
    source = json.loads(warc_headers or "[]")
    payload_digest, block_digest = digest(payload), digest(block)
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Metadata": source,
            "Payload-Metadata": {
                "Actual-Content-Type": "application/http; msgtype=response",
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": headers,
                    "Entity-Length": len(payload),
                    "Entity-Digest": payload_digest,
                    "HTML-Metadata": metadata,
                },
            },
        }
    }
    if undecoded:
        envelope["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Undecoded-Content-Encoding"] = undecoded
    out = []
    for kind, content_type, body in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False)), ("conversion", "text/plain", text)):
        data = body.encode("utf-8", "replace")
        out.append(
            {
                "record_type": kind,
                "record_id": record_id(kind, name),
                "refers_to": name,
                "target_uri": uri,
                "date": date,
                "source_payload_digest": payload_digest,
                "source_block_digest": block_digest,
                "block_digest": digest(data),
                "content_type": content_type,
                "content_length": len(data),
                "block": body,
            }
        )
    return out


def derive(records: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """The metadata and the conversion record of each response, with the columns of DERIVED."""
    inputs = [id_col, *RESPONSE.names]

    def work(ids: list, *columns: list) -> Iterator[dict]:
        for a, b in slices(columns[-1]):
            out: dict[str, list] = {n: [] for n in DERIVED.names}
            for page, name, uri, date, headers, block in zip(ids[a:b], *[c[a:b] for c in columns], strict=True):
                for row in derived_of(name or "", uri or "", date or "", headers or "[]", block or b""):
                    out["page_id"].append(page)
                    for k, v in row.items():
                        out[k].append(v)
            yield out

    return explode_columns(records.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), inputs, DERIVED, work)


def record_bytes(row: dict) -> bytes:
    """A derived record in the WARC 1.0 format."""
    body = row["block"].encode("utf-8", "replace")
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Refers-To": row["refers_to"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Date": row["date"],
        "WARC-Block-Digest": row["block_digest"],
        "Content-Type": row["content_type"],
        "Content-Length": str(len(body)),
    }
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def _members(data: bytes) -> Iterator[bytes]:
    """The members of a compressed file, one at a time; anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            yield member.decompress(memoryview(data)[at:])
        except zlib.error:
            return  # a broken member ends the file
        at = len(data) - len(member.unused_data)
        if not member.eof:
            return


def record_end(part: bytes, start: int, length: str) -> int:
    """Where the block that begins at ``start`` ends.

    That is where its length says, if the next record or nothing follows there; else the record ends
    where the next one begins, so a wrong length costs one record and not those behind it.
    """
    stop = start + int(length) if length.isdecimal() else -1
    if start <= stop <= len(part):
        rest = part[stop : stop + 16].lstrip(b"\r\n")
        if rest.startswith(b"WARC/") or not rest and not part[stop:].strip():
            return stop
    follows = part.find(BOUNDARY, start)
    if follows >= 0:
        return follows
    return stop if start <= stop <= len(part) else len(part)


def parse_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a WARC file, compressed by record or as a whole or not."""
    for part in _members(data):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                break
            headers = _headers(part[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            stop = record_end(part, end + 4, value_of(headers, "Content-Length") or "")
            yield headers, part[end + 4 : stop]
            at = stop


BOUNDARY = b"\r\n\r\nWARC/"
LARGEST = 1 << 30  #: bytes of a record that is put together again


def _whole(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records from the texts between boundaries, with what a boundary inside a block has cut put together by its length."""
    held: list[bytes] = []
    missing = 0  # bytes that the held record's length still asks for

    def flush() -> Iterator[bytes]:
        if missing <= 0:
            yield b"\r\n\r\n".join(held)
        else:  # the length was wrong: these are records of their own
            yield from held

    for piece in pieces:
        begins = piece.startswith(b"WARC/")  # a file's first one, which has no boundary before it
        piece = piece if begins else b"WARC/" + piece
        if held and not begins and missing >= len(piece) + 4:
            held.append(piece)
            missing -= len(piece) + 4
            continue
        if held:
            yield from flush()
        head, _, block = piece.partition(b"\r\n\r\n")
        length = value_of(_headers(head.decode("utf-8", "replace").split("\r\n")[1:]), "Content-Length") or ""
        held, missing = [piece], int(length) - len(block) if length.isdecimal() and int(length) <= LARGEST else 0
    if held:
        yield from flush()


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files of any size; ``page_id`` numbers the records.

    Spark reads the files as texts that end at a record's boundary, so compressed files stream through a
    task a record at a time and plain ones are split; bytes stay as they are.  A block that holds a
    boundary itself is put together again, up to LARGEST bytes and within a split.  What follows a broken
    member of a compressed file is left out.
    """
    schema = T.StructType([*RESPONSE.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in _whole(v for batch in batches for v in batch.column(0).to_pylist()):
            for headers, block in parse_records(record):
                if value_of(headers, "WARC-Type") == "response":
                    named = (value_of(headers, f"WARC-{n}") for n in ("Record-ID", "Target-URI", "Date"))
                    yield record_batch(schema, {k: [v] for k, v in zip(schema.names, (*named, json.dumps(headers), block), strict=True)})

    files = spark.read.option("lineSep", BOUNDARY.decode()).option("ignoreCorruptFiles", "true").text(path)
    records = files.select(F.col("value").cast("binary")).mapInArrow(work, schema)
    return records.select(F.monotonically_increasing_id().alias("page_id"), *schema.names)
