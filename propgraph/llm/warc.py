"""WARC archives: written from pages, read back, and assembled to captures.

Writing gives each page a request, a response (or revisit) and a metadata record, next to each other; request and
metadata name the response by WARC-Concurrent-To. Of pages with equal payloads of at least 100 bytes the one with the
smallest id is the response, and the others revisit it without a payload, by WARC-Refers-To.

Files are written and read by Spark's own text source, with the end of a record as line separator, so that any
file system Spark knows will do and a lost task is run again; each is one gzip stream. Content that holds the
separator is put together again by Content-Length when read, which is why a file is read in order by one task; a
task holds one record at a time.

Reading parses records, checks their digests, joins request and metadata to the response by the concurrent-to
identifier, and gives one nested row for each capture. Sizes and digests are taken while parsing; a revisit names the
size (its HTTP header), the digest and the page of what it refers to, so that only its payload takes a join with the
response, salted where many revisits refer to one. Payloads are not shuffled unless they are asked for.

Equal payloads are found by partial aggregates of digests, and only digests that occur twice are joined back, salted,
so that a payload that a third of all pages share is no hot task. Record ids derive from page id and payload.

Defined results: a null html is an empty payload; a null url is an empty target; a url that cannot be parsed is kept
as the target, without a host in the request; repeated rows (equal id and payload)
give as many captures, with equal record ids; of several rows with the smallest id each is a response; a null page id
is written as an empty header, read as null, and is never referred to unless all ids of that payload are null (then
all are responses); an empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, held, new_path, small_batches

LEAST, SALTS = 100, 16
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    digest = hashlib.sha256(content).hexdigest()
    return b"WARC/1.1\r\n" + head.encode() + f"WARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(content)}\r\n\r\n".encode() + content


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def _host_and_path(url: str) -> tuple[str, str]:
    """Of a url; no host and the root, where it is no url that can be parsed."""
    try:
        parts = urlsplit(url)
    except ValueError:  # brackets that are not in pairs, letters that normalise to a separator
        return "", "/"
    if not parts.netloc:
        return "", "/"
    return parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def transaction(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> list[bytes]:
    """The three records of a page, without the separator that ends each."""
    url = _line(url)
    host, path = _host_and_path(url)
    kind = "response" if refers_to is None else "revisit"
    own = record_id(kind, page_id, digest)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-Id", "" if page_id is None else str(page_id))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    answer = [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        answer += [("WARC-Refers-To", record_id("response", refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    asked = f"GET {path} HTTP/1.1\r\nHost: {host}\r\nAccept: text/html\r\n\r\n".encode()
    told = f"fetchTimeMs: 0\r\npayloadBytes: {len(payload)}\r\n".encode()
    return [
        _record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], asked),
        _record(answer, http + (payload if refers_to is None else b"")),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], told),
    ]


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of ``pages`` (page_id, url, html) as gzip files under ``path``."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = held(again.filter("n > 1 and first is not null").select(F.col("digest").alias("__d"), "first"))
    if again.count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(again), F.col("digest") == F.col("__d"), "left")
    else:
        salted = rows.withColumn("__s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        copies = again.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = salted.join(copies, (F.col("digest") == F.col("__d")) & (F.col("__s") == F.col("__t")), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    found = found.select("page_id", "url", "payload", "digest", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for i in range(0, b.num_rows, 64):
                part = zip(*(c.slice(i, 64).to_pylist() for c in cols), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r for x in part for r in transaction(*x)], pa.binary())], ["value"])

    found.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _assemble(fragments: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Records (headers, content) from the pieces between separators, by their announced lengths."""
    sep, held = SEPARATOR.encode(), bytearray()

    def more() -> bool:
        piece = next(fragments, None)
        if piece is not None:
            held.extend(piece + sep)
        return piece is not None

    while True:
        # line ends between records: the separator may be found early where a content ends with one
        while not held.lstrip(b"\r\n"):
            held.clear()
            if not more():
                return
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        head, _, _ = held.partition(sep)
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not the start of a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"{headers.get('warc-record-id')}: the record has no length")
        start, length = len(head) + len(sep), int(headers["content-length"])
        while len(held) < start + length:
            if not more():
                raise ValueError(f"{headers.get('warc-record-id')}: the archive ends within the record")
        content = bytes(held[start : start + length])
        del held[: start + length]
        if headers.get("warc-block-digest") not in (None, f"sha256:{hashlib.sha256(content).hexdigest()}"):
            raise ValueError(f"{headers.get('warc-record-id')}: the block's digest differs")
        yield headers, content


def _length(http: str) -> int | None:
    """The length that an HTTP head announces."""
    for line in http.split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k.strip().lower() == "content-length" and v.strip().isdigit():
            return int(v)
    return None


RECORD = "type string, id string, concurrent_to string, refers_to string, refers_to_page long, page_id long, url string, date string, http string, payload binary, payload_bytes long, payload_digest string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = (v.as_py() for b in batches for v in b.column(0))
        rows, size = [], 0
        for h, content in _assemble(fragments):
            http, payload, n, digest = None, None, None, None
            if h.get("content-type", "").startswith("application/http"):
                head, _, body = content.partition(SEPARATOR.encode())
                http = head.decode("utf-8", "replace")
                if h["warc-type"] == "response":
                    payload, n, digest = body, len(body), hashlib.sha256(body).hexdigest()
                    if h.get("warc-payload-digest") not in (None, f"sha256:{digest}"):
                        raise ValueError(f"{h.get('warc-record-id')}: the payload's digest differs")
                elif h["warc-type"] == "revisit":
                    n, digest = _length(http), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None
            page, to = (h.get(k) or None for k in ("x-page-id", "x-refers-to-page-id"))
            rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), to and int(to), page and int(page), h.get("warc-target-uri"), h.get("warc-date"), http, payload, n, digest))
            size += len(content)
            if len(rows) >= 500 or size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    small_batches(spark)
    text = spark.read.option("lineSep", SEPARATOR).schema("value string").text(path)
    return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: page_id, url, date, request, response, metadata.

    A revisit's payload is that of the response it refers to (null where the archives do not have it).
    """
    said = records.filter("type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("id"))
    # one row for each identifier: rows that were repeated name the same one with the same content
    said = said.agg(*(F.min(F.when(F.col("type") == k, F.struct(F.col("id").alias("record_id"), "http"))).alias(k) for k in ("request", "metadata")))
    own = records.filter("type in ('response', 'revisit')")
    # where payloads are not asked for, neither this nor the join stays in the plan
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = own.filter("type = 'revisit'").select(F.col("refers_to").alias("to")).distinct()
    full = records.filter("type = 'response'").join(asked, F.col("id") == F.col("to"), "left_semi").groupBy(F.col("id").alias("to")).agg(F.min("payload").alias("to_payload"))
    full = full.withColumn("to_salt", salts).groupBy("to", "to_salt").agg(F.first("to_payload").alias("to_payload"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    every = own.withColumn("salt", salt).join(full, (F.col("refers_to") == F.col("to")) & (F.col("salt") == F.col("to_salt")), "left").join(said, "id", "left")
    payload = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.col("to_payload")).alias("payload")
    response = F.struct(F.col("id").alias("record_id"), "type", "http", payload, "payload_bytes", "payload_digest", "refers_to", "refers_to_page")
    return every.select("page_id", "url", "date", "request", response.alias("response"), "metadata")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write(pages, path)
    found = captures(read_records(spark, path))
    r = F.col("response")
    return found.select("page_id", r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["type"].alias("record_type"), r["refers_to_page"].alias("refers_to"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))
