"""Legacy archives: ARC records of either version become equivalent WARC records.

An ARC file is a series of archives. Each begins with a version block, a
record of its own that names the version and the fields of all header lines
up to the next one; a record is such a header line, whose last field declares
the length, and that many bytes of content. Spark reads the files as tasks,
finds in their narrow records which payloads are equal, and converts file by
file: the parser takes records as they are declared, the converter synthesises
what WARC asks for beyond them: a record identifier, an ISO timestamp, a
record type and digests. Contents are bytes throughout: an image or a page
that is not UTF-8 passes as it is. Files of both kinds are written by Spark's
text writer, so any store that Spark knows will do, and read as streams: a
worker holds a compressed file and one record of it. ARC files are a gzip
stream; in WARC files each record is a gzip member of its own, as indexes of
offsets want it, and the writer calls them ``.txt``.
"""

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.salting import per_salt, salt_bits, salt_of
from quern.plans.staging import settle, stage_path

#: The fields of an ARC header line by version; the last one is the length of what follows.
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"],
}
#: By what name a version block calls them.
ARC_TITLES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "content_type": "Content-type", "result_code": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}
VERSION_BLOCK = "filedesc://"
CRLF = b"\r\n"
#: Ends each WARC record.
SEPARATOR = "\r\n\r\n"
#: Records and bytes that are written at once, but for a single longer record, and how often at most to one file: a file is read back by one task.
BLOCK_RECORDS, BLOCK_BYTES, FILE_BLOCKS = 100, 1 << 20, 16
#: Extension headers: the page's id, in the HTTP headers of its capture; of a revisit the response's page and the payload's length.
PAGE_HEADER, REFERS_HEADER, LENGTH_HEADER = b"X-Archive-Page", "X-Archive-Refers-To-Page", "X-Archive-Payload-Length"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
#: Of a capture whose date a legacy archive lacks.
NO_DATE = "19700101000000"


def _text(raw: bytes) -> str:
    """A header's text; where it is not UTF-8, bytes beyond ASCII become percent escapes."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in raw)


def _header_line(version: int, **fields: str) -> bytes:
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n"


def arc_record(version: int, url: str, date: str, content_type: str, content: bytes, ip: str = "0.0.0.0", offset: int = 0, filename: str = "legacy.arc") -> bytes:
    """One ARC record. Blanks in the URL are escaped, as the header line is split on them."""
    url = url.replace(" ", "%20").replace("\t", "%09").replace("\r", "%0D").replace("\n", "%0A") or "-"
    return _header_line(version, url=url, ip=ip, date=date, content_type=content_type, result_code="200", checksum="-", location="-", offset=str(offset), filename=filename, length=str(len(content))) + content + b"\n"


def version_block(version: int, filename: str = "legacy.arc") -> bytes:
    """The record that opens an archive."""
    titles = " ".join(ARC_TITLES[f] for f in ARC_FIELDS[version])
    return arc_record(version, VERSION_BLOCK + filename, NO_DATE, "text/plain", f"{version} 0 legacy\n{titles}\n".encode(), filename=filename)


def _declared_fields(block: bytes) -> list[str]:
    """The fields of the header lines that follow a version block."""
    lines = block.decode("latin-1").split("\n")
    known = {title: field for field, title in ARC_TITLES.items()}
    names = [known.get(t, "") for t in lines[1].split(" ")] if len(lines) > 1 else []
    version = lines[0].split(" ")[0]
    if not version.isdigit() or names != ARC_FIELDS.get(int(version)):
        raise ValueError(f"not a version block: {block[:80]!r}")
    return names


def arc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record of a series of archives. What does not hold to its version block raises ValueError."""
    names: list[str] = []
    while line := stream.readline():
        values = _text(line.rstrip(b"\n")).split(" ")
        if not line.endswith(b"\n") or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        content = stream.read(int(values[-1]))
        if len(content) < int(values[-1]) or stream.read(1) not in (b"\n", b""):
            raise ValueError(f"the record of {values[0]} does not end where it declares")
        if values[0].startswith(VERSION_BLOCK):
            names = _declared_fields(content)
            continue
        if len(values) != len(names):
            raise ValueError(f"the header line of {values[0]} has {len(values)} fields, its archive declares {len(names)}")
        yield dict(zip(names, values, strict=True)), content


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(content: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers, by lower-case name, and payload of an HTTP response; without a status line all is payload."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, payload = content.partition(CRLF + CRLF)
    pairs = (line.partition(b":") for line in head.split(CRLF)[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def record_id(url: str, date: str, content: bytes) -> str:
    """The same for the same capture, however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {hashlib.sha1(content).hexdigest()}')}>"


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or at least its first 8 digits, as an ISO timestamp in UTC; the epoch if there is no such time."""
    d = arc_date.ljust(14, "0") if re.fullmatch(r"[0-9]{8,14}", arc_date) else NO_DATE
    try:
        return datetime(*(int(d[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))).isoformat() + "Z"
    except ValueError:
        return warc_date(NO_DATE)


def warc_headers(header: dict[str, str], content: bytes, refers_to: dict[str, str] | None = None) -> tuple[dict[str, str], bytes]:
    """The WARC headers and block that stand for an ARC record.

    With ``refers_to``, headers that name another record, it becomes a revisit
    of that one: its payload goes, its HTTP headers and the length and digest
    of the full payload stay.
    """
    http, payload = http_parts(content)
    block = content[: len(content) - len(payload)] if refers_to else content
    kind = "revisit" if refers_to else "response" if http else "resource"
    out = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(header["url"], header["date"], content),
        "WARC-Date": warc_date(header["date"]),
        "WARC-Target-URI": header["url"],
        "WARC-IP-Address": header["ip"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response" if http else header["content_type"],
    }
    if refers_to:
        out |= refers_to | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", LENGTH_HEADER: str(len(payload))}
    return out | {"Content-Length": str(len(block))}, block


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A record without the separator that ends it."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers.items())]
    return CRLF.join(lines) + CRLF + CRLF + block


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths. Malformed records raise ValueError."""
    while line := stream.readline():
        headers: dict[str, str] = {}
        while (field := stream.readline()) not in (CRLF, b""):
            name, _, value = _text(field.removesuffix(CRLF)).partition(": ")
            headers[name] = value
        if not line.startswith(b"WARC/") or not headers.get("Content-Length", "").isdigit():
            raise ValueError(f"not a WARC header: {line[:80]!r}")
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) < n or stream.read(4) != SEPARATOR.encode():
            raise ValueError(f"the record {headers.get('WARC-Record-ID')} does not end where it declares")
        yield headers, block


def legacy_content(page_id: int | None, html: str | bytes | None) -> bytes:
    """The HTTP response that a legacy archive holds for a page; it carries the page's id as a header."""
    payload = html if isinstance(html, bytes) else (html or "").encode("utf-8", "surrogatepass")
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", PAGE_HEADER + b": " + (b"" if page_id is None else b"%d" % page_id), b"Content-Length: %d" % len(payload)]
    return CRLF.join(head) + CRLF + CRLF + payload


def _blocks(records: Iterator[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """(name, content) pairs by BLOCK_RECORDS and BLOCK_BYTES."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for name, content in records:
        if held and (len(held) == BLOCK_RECORDS or size + len(content) > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((name, content))
        size += len(content)
    if held:
        yield held


def _member(record: bytes) -> bytes:
    return gzip.compress(record, 6, mtime=0)


def _members(records: list[bytes]) -> bytes:
    """A gzip member for each record, without the zero byte that ends the last one and that the writer puts after a row.

    A member ends with the high byte of its length, so only one of 16 MiB or
    more may end otherwise: an empty member then follows it.
    """
    out = b"".join(map(_member, records))
    return (out if out.endswith(b"\0") else out + _member(b""))[:-1]


def _values(values: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, pa.binary())], names=["value"])


def _write(blocks: DataFrame, path: str, end: str, compression: str) -> None:
    """Rows of bytes, ``end`` after each of them: the cast to strings, which the writer asks for, leaves bytes as they are."""
    blocks.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(path, lineSep=end, compression=compression)


def _archiver(versions: tuple[int, ...]):
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        for batch in batches:
            pages = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            contents = ((url or "", legacy_content(page, html)) for page, url, html in pages)
            for block in _blocks(contents):
                version = versions[((task.partitionId() if task else 0) + made) % len(versions)]
                made += 1
                out = version_block(version)
                size, parts = len(out), [out]
                for url, content in block:
                    parts.append(arc_record(version, url, NO_DATE, "text/html", content, offset=size))
                    size += len(parts[-1])
                yield _values([b"".join(parts)[:-1]])

    return archive


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """The legacy side: ``pages`` as gzip ARC files below ``path``, archives of the versions in turn.

    A page, text or bytes, is the HTTP response of its capture. A null payload is empty, a
    null URL ``-``, a null id an empty header. Very long payloads are archives
    of their own. An empty table writes no record.
    """
    whole = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    _write(whole.mapInArrow(_archiver(versions), "value binary"), path, "\n", "gzip")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(archive: pa.Scalar) -> BinaryIO:
    return gzip.open(io.BytesIO(archive.as_buffer()))


def _page(http: dict[bytes, bytes]) -> int | None:
    value = http.get(PAGE_HEADER.lower(), b"")
    return int(value) if re.fullmatch(rb"-?[0-9]+", value) else None


NARROW = "path string, no int, page long, url string, record_id string, sha binary, n long"


def _surveyor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, archive in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out = []
            for no, (header, content) in enumerate(arc_records(_opened(archive))):
                http, payload = http_parts(content)
                out.append((path, no, _page(http), header["url"], record_id(header["url"], header["date"], content), hashlib.sha256(payload).digest(), len(payload)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=[f.split()[0] for f in NARROW.split(", ")])


def _converted(archive: pa.Scalar, links: list[dict] | None) -> Iterator[tuple[str, bytes]]:
    """The WARC records of an ARC file; ``links`` names the record that each revisit of it refers to."""
    of = {r["no"]: {"WARC-Refers-To": r["record_id"], "WARC-Refers-To-Target-URI": r["url"], REFERS_HEADER: str(r["page"])} for r in links or []}
    for no, (header, content) in enumerate(arc_records(_opened(archive))):
        yield header["url"], warc_record(*warc_headers(header, content, of.get(no)))


def _converter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, links in zip(batch.column(0), batch.column(1), strict=True):
            for block in _blocks(_converted(archive, links.as_py())):
                yield _values([_members([record + SEPARATOR.encode() for _, record in block])])


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert the gzip ARC files below ``arc_path`` to WARC files below ``warc_path``, a gzip member for each record.

    Of captures with equal payloads of at least ``min_bytes``, told by SHA-256
    and length, that with the smallest page id is the response and others
    revisit it; smaller ones are all responses. Captures without a page id are
    responses, and so are those that repeat a response's id along with its
    payload. Very long payloads are records like others. Archives without
    records give none; malformed ones fail the job. Contents may be any bytes;
    a header line that is not UTF-8 is escaped, and a date that does not exist
    is the epoch.
    """
    narrow = settle(_files(spark, arc_path).mapInArrow(_surveyor, NARROW).where(F.col("page").isNotNull() & (F.col("n") >= min_bytes)).withColumn("salt", salt_of("page")))
    first = F.struct("page", "url", "record_id")
    by_salt = narrow.groupBy("sha", "salt").agg(F.min(first).alias("least"))
    groups = by_salt.groupBy("sha").agg(F.min("least").alias("least"), salt_bits("salt").alias("salts"))
    links = narrow.join(per_salt(groups, "salts"), ["sha", "salt"]).where("page <> least.page")
    by_file = links.groupBy("path").agg(F.collect_list(F.struct("no", "least.*")).alias("links"))  # no more than a file has records
    files = _files(spark, arc_path).join(settle(by_file), "path", "left").select("content", "links")
    _write(files.mapInArrow(_converter, "value binary"), warc_path, "\0", "none")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            out = []
            for headers, block in warc_records(_opened(archive)):
                http, payload = http_parts(block)
                least = headers.get(REFERS_HEADER)
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                n = int(headers.get(LENGTH_HEADER, len(payload)))
                intact = f"sha1:{base32_sha1(block)}" == headers["WARC-Block-Digest"] and (kind == "revisit" or base32_sha1(payload) == digest)
                out.append((_page(http), n, digest, kind, int(least) if least else None, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), intact))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "intact"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_record, and whether its digests hold."""
    return _files(spark, path).select("content").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, intact boolean")


def archived(pages: DataFrame, min_bytes: int = 0, versions: tuple[int, ...] = (1, 2), **columns) -> DataFrame:
    """``pages`` written as ARC files in the shared folder, converted to WARC files there, and read back.

    One row per row of ``pages``, null ids and repeated rows too; other
    columns are ignored; an empty table gives an empty result.
    """
    spark, path = pages.sparkSession, stage_path(pages.sparkSession)
    write_arc(pages, f"{path}/arc", versions, **columns)
    convert(spark, f"{path}/arc", f"{path}/warc", min_bytes)
    return read_warc(spark, f"{path}/warc")
