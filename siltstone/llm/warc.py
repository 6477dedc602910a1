"""Web archives: pages to legacy ARC, ARC to WARC, and WARC back to rows.

`to_arc` writes pages as ARC files of one version block and many document records (version 1 with five
header fields, version 2 with ten), up to `file_bytes` each. `arc_to_warc` is the converter: it reads the version
block, parses each header line by the fields of that version, takes the declared number of bytes and
synthesises the WARC record: a name-based record id, the 14-digit date as ISO 8601, the record type,
SHA-1 payload and block digests. Blocks are bytes throughout, in any encoding or none. `write_warc` writes the
records as gzip files in the shared folder, sized by bytes; `read_warc` parses these by declared length and
checks every digest on the way.

Of records with equal payloads of at least `min_bytes` bytes the one with the largest id is the
response; the others are revisits that keep only the HTTP headers and point to it. Hot payloads: the
largest id per digest is pre-aggregated, and only ids and digests (no payloads) meet by digest.

Defined cases: null html is the empty payload; a null url is urn:page; a null page_id comes back null,
loses against every other id, and is a response if its payload has no other id; repeated rows with the
largest id are each a response; html of any length is one record; blocks that are no UTF-8 stay as they are; an
empty table gives an empty archive; an ARC header line that departs from its version's fields, or a declared length
beyond the file, fails the job with a message.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import lean
from .common import shared_path, small_batches

# The header fields of both ARC versions, as the format names them.
FIELDS_1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def to_arc(pages: DataFrame, archived_at: str = "20000101000000", file_bytes: int = 4 << 20) -> DataFrame:
    """(page_id, url, html, refers_to) -> (arc binary, refers_to array<long>): ARC files, and what each of their records refers to.

    Odd ids go to version 2 files. A file has about `file_bytes` at most, or one record.
    """
    body = F.coalesce("html", F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )
    url = F.regexp_replace(F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit("urn:page")), r"\s", "%20")
    size = F.octet_length(http).cast("string")

    def record(middle: str):
        return F.concat(url, F.lit(f" 0.0.0.0 {archived_at} text/html {middle}"), size, F.lit("\n"), http, F.lit("\n")).cast("binary")

    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    records = pages.select(F.when(odd, 2).otherwise(1).alias("version"), F.when(odd, record("200 - - 0 pages.arc ")).otherwise(record("")).alias("record"), "refers_to")

    @lean
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def file(version: int) -> pa.RecordBatch:
            parts, refers_to = zip(*open_[version], strict=True)
            open_[version], size[version] = [], 0
            return pa.record_batch({"arc": pa.array([version_block(version, archived_at) + b"".join(parts)], pa.binary()), "refers_to": pa.array([refers_to], pa.list_(pa.int64()))})

        open_, size = {1: [], 2: []}, {1: 0, 2: 0}
        for b in batches:
            for version, part, refers_to in zip(*b.columns, strict=True):
                version, part = version.as_py(), part.as_py()
                if open_[version] and size[version] + len(part) > file_bytes:
                    yield file(version)
                open_[version].append((part, refers_to.as_py()))
                size[version] += len(part)
        yield from (file(v) for v in (1, 2) if open_[v])

    return records.mapInArrow(files, "arc binary, refers_to array<long>")


def version_block(version: int, archived_at: str) -> bytes:
    """The record that opens an ARC file: it names the version and the fields of all header lines that follow."""
    note = f"{version} 0 siltstone\n{FIELDS_2 if version == 2 else FIELDS_1}\n\n"
    return f"filedesc://pages-{version}.arc 0.0.0.0 {archived_at} text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(note)}\n{note}".encode()


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Document records of an ARC file: header fields by the names the version block declares, and the block."""
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if not line.strip():
            at = end + 1 if end >= 0 else len(data)
            continue
        words = line.decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        size = int(words[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"ARC record declares {size} bytes, {len(block)} are there")
        at = end + 1 + size
        if words[0].startswith("filedesc:"):
            version, fields = block.split(b"\n")[:2]
            names = fields.decode().split()
            if version.split()[0] not in (b"1", b"2") or len(names) not in (5, 10):
                raise ValueError(f"unknown ARC version block {version!r}")
            continue
        if names is None or len(words) != len(names):
            raise ValueError(f"ARC header line has {len(words)} fields: {line[:80]!r}")
        yield dict(zip(names, words, strict=True)), block


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Names and values of an RFC 822 like head, and what follows the empty line."""
    head, _, rest = block.partition(END.encode())
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])}, rest


def warc_record(fields: dict[str, str], block: bytes, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it."""
    http, payload = headers(block)
    digest, page, d = sha1_base32(payload), http.get("x-page-id", "-"), fields["Archive-date"]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    extra = []
    if refers_to is not None:
        block = block[: len(block) - len(payload)]
        extra = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to), digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if extra else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *extra, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(lines) + END).encode("utf-8", "surrogateescape") + block


def arc_to_warc(arcs: DataFrame, run_bytes: int = 16 << 20) -> DataFrame:
    """(arc binary, refers_to array<long>) -> (warc binary): runs of WARC records, one record for every document record.

    refers_to has one entry for each document record of the file; null: no record is a revisit. Records are closed by
    two line ends, but for the last of a run, which the writer closes. A run has about run_bytes at most, or one record.
    """

    @lean
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for arc, refers_to in zip(b.column(0), b.column(1), strict=True):
                targets = refers_to.as_py()
                for i, (fields, block) in enumerate(arc_records(arc.as_py() or b"")):
                    record = warc_record(fields, block, targets[i] if targets else None)
                    if out and size + len(record) > run_bytes:
                        yield pa.record_batch({"warc": pa.array([END.encode().join(out)], pa.binary())})
                        out, size = [], 0
                    out.append(record)
                    size += len(record)
        if out:
            yield pa.record_batch({"warc": pa.array([END.encode().join(out)], pa.binary())})

    return arcs.select("arc", "refers_to").mapInArrow(convert, "warc binary")


def with_refers_to(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages plus refers_to: the response's page_id where this row is a revisit, else null."""
    body = F.coalesce("html", F.lit(""))
    ids = pages.where(F.octet_length(body) >= min_bytes).select("page_id", F.sha1(body).alias("__d"))
    first = ids.groupBy("__d").agg(F.max("page_id").alias("__m"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    back = ids.join(first, "__d").where("__m is not null and (page_id is null or page_id < __m)")
    back = back.groupBy(F.col("page_id").alias("__p"), F.col("__d").alias("__e")).agg(F.first("__m").alias("refers_to"))
    p = pages.withColumn("__d", F.when(F.octet_length(body) >= min_bytes, F.sha1(body)))
    return p.join(back, F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("__d") == F.col("__e")), "left").drop("__p", "__d", "__e")


def write_warc(runs: DataFrame, path: str, runs_per_file: int = 4) -> None:
    """gzip WARC files of at most runs_per_file runs (warc binary), 64 MB by default; the text writer's line end closes a run's last record."""
    text = runs.select(F.col("warc").cast("string").alias("value"))  # the bytes as they are
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", runs_per_file).text(path)


def warc_records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open WARC stream, by declared length."""
    while line := data.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, data.read(int(head["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, warc_date."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("warc_date", pa.string())])

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    http, payload = headers(block)
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if head["warc-block-digest"] != f"sha1:{sha1_base32(block)}" or kind == "response" and digest != sha1_base32(payload):
                        raise ValueError(f"digest mismatch in {head['warc-record-id']}")
                    page, back = http.get("x-page-id", "-"), head.get("x-refers-to-page-id")
                    rows.append((None if page == "-" else int(page), int(http["content-length"]) if kind == "revisit" else len(payload), digest, kind, int(back) if back else None, head["warc-target-uri"], head["warc-record-id"], head["warc-date"]))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds) if rows else pa.RecordBatch.from_pylist([], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, warc_date string")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as ARC, convert to WARC files in the shared folder, and read these back."""
    spark = pages.sparkSession
    small_batches(spark)
    path = shared_path(spark, "warc")
    p = with_refers_to(pages.select("page_id", "url", "html"), min_bytes)
    write_warc(arc_to_warc(to_arc(p)), path)
    return read_warc(spark, path)


def sql() -> str:
    """DuckDB SQL for the digest columns of archive_round_trip over `pages`."""
    groups = " || ".join(
        "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, %d, 5))::INT >> %d) & 31) + 1, 1)" % (5 * g + 1, s) for g in range(8) for s in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(b) AS payload_bytes, {groups} AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to FROM m"""
