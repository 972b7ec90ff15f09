import gzip
import io
import zlib

import pytest

from quern.llm import arc_to_warc as A
from tests.llm.helpers import awkward_texts, rows, with_clashes

PAGES = "page_id long, url string, html string"


def expected(pages, min_bytes=0):
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= min_bytes and least[html or ""] != i
        out.append({"page_id": i, "payload_bytes": len(raw), "payload_digest": A.base32_sha1(raw), "record_type": "revisit" if again else "response", "refers_to": least[html or ""] if again else None})
    return out


@pytest.mark.parametrize(("versions", "min_bytes"), [((1,), 20), ((2, 1), 0)])
def test_pages_survive_conversion(spark, versions, min_bytes):
    texts = [*awkward_texts(), "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\r\n\r\n", "é" * 999]
    pages = [(i, None if i % 5 == 0 else f"http://x.example/a b\n{i}", t) for i, t in enumerate([*texts, *texts[:9]])] + [(None, None, "one"), (None, "u", None), (3, "again", texts[3])]
    got = A.archived(with_clashes(spark.createDataFrame(pages, PAGES)), min_bytes, versions)
    assert all(r.intact for r in got.collect())
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(expected(pages, min_bytes), key=lambda r: (r["page_id"] is None, r["page_id"], r["payload_bytes"]))
    assert rows(got.select(*keep), "page_id", "payload_bytes") == want
    ids = {(r.page_id, r.record_id) for r in got.collect() if r.record_type == "response"}
    assert all((r.refers_to, r.refers_to_record) in ids for r in got.collect() if r.record_type == "revisit")


def test_empty_table(spark):
    assert A.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_files_hold_archives_of_both_versions(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "x" * (i * 40)) for i in range(450)], PAGES).coalesce(1)
    A.write_arc(pages, str(tmp_path / "arc"))
    found, lengths, seen = [], [], 0
    for f in sorted((tmp_path / "arc").glob("*.gz")):
        raw = gzip.decompress(f.read_bytes())
        for version in (1, 2):
            block = A.version_block(version)
            assert raw.count(block) >= 2
            seen += raw.count(block)
        records = list(A.arc_records(io.BytesIO(raw)))
        found += [h["url"] for h, _ in records]
        lengths += [len(h) for h, _ in records]
        assert all(raw[raw.index(A.version_block(2)) :][int(h["offset"]) :].startswith(h["url"].encode()) for h, _ in records[100:200])
    assert sorted(found) == sorted(f"http://x/{i}" for i in range(450)) and {*lengths} == {5, 10} and seen >= 5
    A.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert A.read_warc(spark, str(tmp_path / "warc")).where("intact and record_type = 'response'").count() == 450


def test_blocks_are_bounded():
    big = A.BLOCK_BYTES
    sizes = [[len(c) for _, c in b] for b in A._blocks(("", b"x" * n) for n in (10, big * 2, 5, big - 5, 1, *[1] * 250))]
    assert sizes == [[10], [2 * big], [5, big - 5], [1] * 100, [1] * 100, [1] * 51]


def test_archives_of_several_records_and_malformed_ones():
    contents = [b"plain", A.legacy_content(4, "x\n\ny"), b""]
    read = lambda raw: [c for _, c in A.arc_records(io.BytesIO(raw))]
    for version in (1, 2):
        records = b"".join(A.arc_record(version, f"u{i}", "20010203040506", "text/html", c) for i, c in enumerate(contents))
        archive = A.version_block(version) + records
        assert read(archive) == contents and read(archive + A.version_block(3 - version) + A.arc_record(3 - version, "v", "2001", "a/b", b"last")) == [*contents, b"last"]
        for bad in (archive[:-4] + b"zzz", archive[5:], archive.replace(b" 5\n", b" 5000\n", 1), b"no header", records, A.version_block(3 - version) + records, archive.replace(b"Archive-length", b"Archive-width")):
            with pytest.raises(ValueError):
                read(bad)
    headers, block = A.warc_headers({"url": "u", "ip": "1.2.3.4", "date": "20010203040506", "content_type": "text/plain", "length": "5"}, b"plain")
    assert (headers["WARC-Type"], headers["WARC-Date"], headers["Content-Type"], block) == ("resource", "2001-02-03T04:05:06Z", "text/plain", b"plain")
    record = A.warc_record(headers, block) + A.SEPARATOR.encode()
    assert list(A.warc_records(io.BytesIO(record * 2))) == [(headers, block)] * 2
    for bad in (record[:-1], b"x" + record, record.replace(b"Content-Length", b"Content-Width")):
        with pytest.raises(ValueError):
            list(A.warc_records(io.BytesIO(bad)))


def test_dates():
    assert [A.warc_date(d) for d in ("20010203", "2001", "x", "20010203040506")] == ["2001-02-03T00:00:00Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "2001-02-03T04:05:06Z"]
    assert [A.warc_date(d) for d in ("20051332999999", "20050229", "00000101", "20040229235959")] == ["1970-01-01T00:00:00Z"] * 3 + ["2004-02-29T23:59:59Z"]


def members(raw):
    """The contents of the gzip members that ``raw`` is a plain series of."""
    out = []
    while raw:
        opened = zlib.decompressobj(wbits=31)
        out.append(opened.decompress(raw))
        assert opened.eof
        raw = opened.unused_data
    return out


def test_bytes_that_are_not_text_pass_unchanged(spark, tmp_path):
    """Images, a Latin-1 page and a Latin-1 URL in archives of both versions; each WARC record is a gzip member of its own."""
    image, page = bytes(range(256)) * 40, "<p>déjà vu</p>".encode("latin-1")
    http = lambda kind, payload: b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n" + payload
    contents = [http(b"image/png", image), http(b"text/html; charset=iso-8859-1", page), image, b"\xff\n\x00", b""]
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        records = b"".join(A.arc_record(version, f"http://x/caf%E9/{version}/{i}", "20010203040506", "image/png", c) for i, c in enumerate(contents))
        (tmp_path / "arc" / f"v{version}.arc.gz").write_bytes(gzip.compress(A.version_block(version) + records.replace(b"caf%E9", b"caf\xe9")))
    A.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {}
    for f in (tmp_path / "warc").glob("part-*"):
        for record in members(f.read_bytes()):
            for headers, block in A.warc_records(io.BytesIO(record)) if record else ():
                got[headers["WARC-Target-URI"]] = block, headers["WARC-Type"]
            assert not record or len(list(A.warc_records(io.BytesIO(record)))) == 1
    kinds = ["response", "response", "resource", "resource", "resource"]
    assert got == {f"http://x/caf%E9/{v}/{i}": (c, kinds[i]) for v in (1, 2) for i, c in enumerate(contents)}
    assert A.read_warc(spark, str(tmp_path / "warc")).where("intact and page_id is null").count() == 10


def test_pages_of_bytes_are_archived(spark):
    pages = [(1, "u", b"\xff\xd8\xff\x00\n\r\n\r\n"), (2, "v", b"\xff\xd8\xff\x00\n\r\n\r\n"), (3, "w", None), (4, "x", "é".encode("latin-1"))]
    got = A.archived(spark.createDataFrame(pages, "page_id long, url string, html binary"))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.where("intact").collect()} == {(i, len(h or b""), A.base32_sha1(h or b""), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in pages}


def test_long_members_are_followed_by_an_empty_one():
    for records in ([b"a" * (1 << 24)], [b"a" * (1 << 24), b"b"], [b"b", b"c"], [b""]):
        assert [m for m in members(A._members(records) + b"\0") if m] == [r for r in records if r]
