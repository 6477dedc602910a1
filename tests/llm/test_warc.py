import base64
import gzip
import hashlib
import io

from siltstone.llm.warc import arc_records, arc_to_warc, archive_round_trip, read_warc, sha1_base32, to_arc, warc_record, warc_records, with_refers_to, write_warc

ARC1 = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 69\n1 0 name\nURL IP-address Archive-date Content-type Archive-length\n\n\nhttp://x/ 1.2.3.4 19970203040506 text/html 5\nab\ncd\n"


def test_arc_header_and_declared_length():
    ((fields, block),) = arc_records(ARC1.replace(b" 69\n", b" %d\n" % (len(b"1 0 name\nURL IP-address Archive-date Content-type Archive-length\n\n"))))
    assert fields["Archive-date"] == "19970203040506" and block == b"ab\ncd"
    text = warc_record(fields, b"HTTP/1.0 200 OK\r\n\r\nhi", None)
    assert b"WARC-Date: 1997-02-03T04:05:06Z" in text and b"WARC-Type: response" in text and text.endswith(b"\r\n\r\nhi")


def arc(version, blocks):
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    note = f"{version} 0 name\n{names}\n\n".encode()
    middle = b"" if version == 1 else b"200 - - 0 a.arc "
    out = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain " + middle + b"%d\n" % len(note) + note
    for i, b in enumerate(blocks):
        out += b"\nhttp://x/%d 1.2.3.4 19970203040506 text/html " % i + middle + b"%d\n" % len(b) + b
    return out


def test_foreign_files_with_blocks_in_any_encoding(spark, tmp_path):
    head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"
    bodies = [b"caf\xe9 \xff\x00\xfe", b"", "é\r\n\r\nWARC/1.0".encode("utf-16"), b"plain\n"]
    df = spark.createDataFrame([(arc(1, [head + b for b in bodies]), None), (arc(2, [head + b for b in bodies[:2]]), None)], "arc binary, refers_to array<long>")
    write_warc(arc_to_warc(df, run_bytes=500), f"{tmp_path}/w", runs_per_file=1)
    files = list((tmp_path / "w").glob("*.gz"))
    found = [r for f in files for r in warc_records(io.BufferedReader(gzip.open(f)))]
    assert sorted(b for _, b in found) == sorted([head + b for b in bodies] + [head + b for b in bodies[:2]]) and len(files) > 2
    assert all(h["warc-block-digest"] == f"sha1:{sha1_base32(b)}" for h, b in found)
    rows = read_warc(spark, f"{tmp_path}/w").collect()
    assert len(rows) == 6 and {r.payload_bytes for r in rows} == {len(b) for b in bodies} and {r.page_id for r in rows} == {None}


def test_many_records_a_file_and_long_html(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é" * (3_000_000 if i == 7 else 50 * i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = to_arc(with_refers_to(pages).coalesce(1), file_bytes=20_000).collect()
    assert sum(len(f.refers_to) for f in files) == 40 and max(len(f.refers_to) for f in files) > 2
    assert sum(len(list(arc_records(bytes(f.arc)))) for f in files) == 40
    assert {(r.page_id, r.payload_bytes) for r in archive_round_trip(pages).collect()} == {(i, 6_000_000 if i == 7 else 100 * i) for i in range(40)}


def test_round_trip(spark):
    rows = [(1, "http://a b/", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.0\r\ny é"), (None, "u", "same"), (None, "u", "alone"), (5, "u", "x\r\n\r\nWARC/1.0\r\ny é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, arc string")
    out = sorted((tuple(r)[:5] for r in archive_round_trip(df).collect()), key=str)
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    e = rows[4][2]
    want = [(1, 4, b32("same"), "revisit", 2), (2, 4, b32("same"), "response", None), (3, 0, b32(""), "revisit", 4), (4, 0, b32(""), "response", None), (None, 4, b32("same"), "revisit", 2), (None, 5, b32("alone"), "response", None)] + 2 * [(5, len(e.encode()), b32(e), "response", None)]
    assert out == sorted(want, key=str)


def test_empty(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
