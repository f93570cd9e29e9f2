"""WARC derivatives: from response records to metadata and plain-text records.

Every response gives a ``metadata`` record (its headers, digests, title and links
as fields) and a ``conversion`` record (its text).  Both name the response in
``WARC-Refers-To`` and keep its target and date; the conversion also keeps the
digests of its source.
"""

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
HIDDEN = re.compile(r"<(script|style|noscript|template)\b", re.I)
TITLE = re.compile(r"<title\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
ANCHOR = re.compile(r"<a\b", re.I)
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
META = re.compile(rb"<meta\b[^>]{0,500}", re.I)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|article|section|nav|header|footer|main|aside|title|blockquote|pre|hr|form)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[\s]*")

RESPONSE = "record_id string, target_uri string, warc_date string, http binary, payload binary, source_headers map<string,string>"
DERIVED = ("source_id string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
           "content_type string, content_length bigint, block_digest string, source_digest string, content string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def without_hidden(page: str) -> str:
    """``page`` with a blank for every script, style and the like; unclosed ones reach to the end."""
    out, at = [], 0
    while opened := HIDDEN.search(page, at):
        end = page.find(">", opened.end())
        if end < 0:
            break
        closed = CLOSING[opened[1].lower()].search(page, end + 1)
        out += [page[at:opened.start()], " "]
        at = closed.end() if closed else len(page)
    return "".join(out) + page[at:]


def title_of(page: str) -> str:
    opened = TITLE.search(page)
    end = page.find(">", opened.end()) if opened else -1
    closed = CLOSING["title"].search(page, end + 1) if end >= 0 else None
    return page[end + 1:closed.start()] if closed else ""


def links_of(page: str) -> list[str]:
    """The first ``href`` of every anchor, in one pass: what was searched is not searched again."""
    found, at, stop = [], 0, -1
    while anchor := ANCHOR.search(page, at):
        at = anchor.end()
        if stop < at:
            stop = page.find(">", at)
            stop = len(page) if stop < 0 else stop
        while name := HREF.search(page, at, stop):
            at = name.end()
            if value := VALUE.match(page, at):
                found.append(next(filter(None, value.groups()), ""))
                at = value.end()
                break
        else:
            at = stop
    return found


def plain_text(page: str) -> str:
    """Text of a page: without comments, scripts and styles, a line per block, entities resolved."""
    page = without_hidden(COMMENT.sub(" ", page))
    last = page.rfind(">") + 1  # no tag ends beyond
    text = TAG.sub("", BREAK.sub("\n", page[:last])) + page[last:]
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(text))).strip()


def decoded(payload: bytes, content_type: str) -> str:
    """``payload`` by the charset of its header, else of its first meta tags, else as
    UTF-8; unknown charsets count as UTF-8, bytes outside of it are replaced."""
    named = CHARSET.search(content_type.encode()) or next(filter(None, (CHARSET.search(m[0]) for m in META.finditer(payload[:2048]))), None)
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def one_line(value: str) -> str:
    return " ".join(value.split())


def derive(record_id, target_uri, warc_date, http, payload, source_headers):
    """The metadata and the conversion record of one response: digests are of its bytes,
    the headers of its record are kept as ``source-`` fields of the metadata."""
    source = digest(payload)
    status, *headers = http.decode("utf-8", "replace").split("\r\n")
    headers = [(name.strip().lower(), one_line(value)) for name, _, value in (h.partition(":") for h in headers)]
    text = decoded(payload, dict(headers).get("content-type", ""))
    page = COMMENT.sub(" ", text)
    fields = [("source-record-id", record_id), ("source-block-digest", digest(http + b"\r\n\r\n" + payload if http else payload)),
              ("source-payload-digest", source), ("http-status-line", status)]
    fields += [("http-" + name, value) for name, value in headers]
    fields += [("source-" + name, one_line(value or "")) for name, value in source_headers]
    fields += [("title", one_line(html.unescape(title_of(page))))]
    fields += [("outlink", one_line(html.unescape(link))) for link in links_of(without_hidden(page))]
    metadata = "".join(f"{name}: {value}\r\n" for name, value in fields)
    for kind, content_type, content in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", plain_text(text))):
        data = content.encode()
        yield (record_id, kind, record_urn(record_id, kind), record_id, target_uri, warc_date, content_type, len(data), digest(data), source, content)


def responses_from_pages(pages: DataFrame, *, key="page_id", url="url", body="html", warc_date="1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records with the HTTP header that the page implies.  Ids
    derive from key and url; repeated rows give records with the same id; null
    url and body are empty."""
    payload = F.coalesce(F.col(body), F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(urn.alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("target_uri"), F.lit(warc_date).alias("warc_date"),
                        http.cast("binary").alias("http"), payload.cast("binary").alias("payload"),
                        F.create_map().cast("map<string,string>").alias("source_headers"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response, see ``DERIVED``.  Nulls count as empty; text in place of
    bytes counts as UTF-8; ``source_headers`` may be absent; repeated responses give
    repeated records; an empty table none."""

    def run(batches):
        names = [c.split()[0] for c in DERIVED.split(", ")]
        empty = "", "", "", b"", b"", ()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = zip(*([v or e for v in c.slice(at, 500).to_pylist()] for c, e in zip(batch.columns, empty)))
                out = list(zip(*(r for row in rows for r in derive(*row))))
                kinds = [pa.int64() if n == "content_length" else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    headers = F.col("source_headers") if "source_headers" in responses.columns else F.lit(None).cast("map<string,string>")
    return responses.select("record_id", "target_uri", "warc_date", F.col("http").cast("binary"), F.col("payload").cast("binary"), headers).mapInArrow(run, DERIVED)


def record_text(kind, record_id, target_uri, warc_date, content_type, content, refers_to=None, block_digest=None, payload_digest=None):
    """A whole record as a column, header and block, without the closing line ends."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.concat(F.lit("WARC-Target-URI: "), target_uri), F.concat(F.lit("WARC-Date: "), warc_date)]
    for name, value in (("WARC-Refers-To", refers_to), ("WARC-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload_digest)):
        if value is not None:
            lines.append(F.concat(F.lit(f"{name}: "), value))
    lines += [F.concat(F.lit("Content-Type: "), content_type), F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), content)


def write_warc(records: DataFrame, path: str) -> None:
    """Derived records as gzipped WARC files, one per task."""
    text = record_text(*(F.col(c) for c in ("record_type", "record_id", "target_uri", "warc_date", "content_type", "content", "refers_to", "block_digest", "source_digest")))
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def write_responses(responses: DataFrame, path: str) -> None:
    """Responses as gzipped WARC files, byte for byte; null and empty ``http`` give the payload alone."""
    http, payload = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("http", "payload"))
    block = F.concat(F.when(http == "", http).otherwise(F.concat(http, F.lit("\r\n\r\n"))), payload)
    text = record_text(F.lit("response"), F.col("record_id"), F.col("target_uri"), F.col("warc_date"), F.lit("application/http; msgtype=response"), block)
    responses.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def records_of(stream):
    """(headers, content) of the records of a file.  Without a length in its header a
    record ends before the next line that opens one."""
    line = stream.readline()
    while line:
        if not line.strip():
            line = stream.readline()
            continue
        headers = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append((name.strip().lower(), value.strip()))
        length = dict(headers).get("content-length", "")
        if length.isdecimal():
            content, line = stream.read(int(length)), stream.readline()
        else:
            lines = []
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                lines.append(line)
            content = b"".join(lines).removesuffix(b"\r\n\r\n")
        yield dict(headers), content


def read_warc(spark, path: str) -> DataFrame:
    """(record_type, header map, content in bytes) of every record below ``path``.  A
    file is read by one task, record after record; of headers that repeat the last
    one stays."""

    def run(batches):
        import gzip
        import io

        for batch in batches:
            for data in batch.column("content").to_pylist():
                raw = io.BytesIO(data)
                for headers, content in records_of(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([headers.get("warc-type", "")]), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([content], pa.binary())],
                        names=["record_type", "headers", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "record_type string, headers map<string,string>, content binary")


def read_responses(spark, path: str) -> DataFrame:
    """The response records of WARC files as ``RESPONSE`` rows.  A block that opens with
    ``HTTP/`` is cut at its first blank line (without one it is all header); any other
    block is all payload.  Headers that are absent are empty."""

    def run(batches):
        for batch in batches:
            cut = [c.partition(b"\r\n\r\n") if c.startswith(b"HTTP/") else (b"", b"", c) for c in batch.column("content").to_pylist()]
            columns = [batch.column("headers"), *(pa.array([c[i] for c in cut], pa.binary()) for i in (0, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["headers", "http", "payload"])

    rows = read_warc(spark, path).where("record_type = 'response'").select("headers", "content")
    rows = rows.mapInArrow(run, "headers map<string,string>, http binary, payload binary")
    header = lambda name: F.coalesce(F.element_at("headers", name), F.lit(""))
    return rows.select(
        header("warc-record-id").alias("record_id"), header("warc-target-uri").alias("target_uri"), header("warc-date").alias("warc_date"),
        "http", "payload", F.col("headers").alias("source_headers"))
