"""WARC round trips: every record once whatever the ranges, shared payloads, odd rows."""

import gzip
import hashlib
import os
import re

import pytest
from compare import connect, duck_rows, spark_rows

from sievework.llm import queries, warc


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) by the rules, for rows (page_id, html)."""
    first = {}
    for page_id, html in rows:
        body = (html or "").encode()
        if len(body) >= warc.SHARED_BYTES and page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        to = first.get(body) if page_id is not None else None
        to = None if to == page_id else to
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_query_matches_sql(spark, sf_dir):
    want, _ = duck_rows(connect(sf_dir), queries.OP8_SQL)
    assert spark_rows(queries.op8_warc(spark, sf_dir)) == want


@pytest.mark.parametrize("range_bytes", [300, 5000, 1 << 20])
def test_ranges_and_odd_rows(spark, tmp_path, range_bytes):
    noise = "".join(chr(i) for i in range(1, 800)) * 3 + "\x1f\x8b\x08WARC/1.1"
    rows = [(1, "u", None), (2, None, ""), (3, "a b%\r\nX: y", "é" * 60), (4, "u", "é" * 60), (5, "u", "x" * 99),
            (6, "u", "x" * 99), (7, "u", noise), (7, "u", noise), (9, "u", noise), (None, "n", "é" * 60),
            (-3, "u", "WARC/1.1\r\n\r\n" * 30), (12, "u", "q" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id BIGINT, url STRING, html STRING, digest STRING")
    folder = str(tmp_path / "w")
    warc.write_pages(pages.repartition(2), folder)
    found = warc.read_archives(spark, folder, content=True, range_bytes=range_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found),
                  key=str) == expected([(r[0], r[2]) for r in rows])
    urls = {r[0]: r[1] for r in rows}
    bodies = {r[0]: (r[2] or "").encode() for r in rows}
    for r in found:
        assert r.url == urls[r.page_id]
        assert bytes(r.payload) == (bodies[r.page_id] if r.record_type == "response" else b"")


def test_a_payload_that_is_an_archive(spark, tmp_path):
    """Magic bytes inside a stored member are candidates that must not become records of their own."""
    inner = warc.encode_record(5, "u", b"inner", hashlib.sha256(b"inner").hexdigest(), None)
    pack = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"-" * 500 + b"\x1f\x8b\x08" * 40
    digest = hashlib.sha256(body.partition(b"\r\n\r\n")[2]).hexdigest()
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode()
    outer = pack.compress(head + body + b"\r\n\r\n") + pack.flush()
    (tmp_path / "a.warc.gz").write_bytes(outer + inner)
    for size in (7, 100, 10_000):
        rows = warc.read_archives(spark, str(tmp_path), range_bytes=size).collect()
        assert sorted(r.page_id for r in rows) == [1, 5]


def test_standard_form_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://e.org/", "x" * 200), (2, "http://e.org/2", "x" * 200)],
                                  "page_id BIGINT, url STRING, html STRING")
    folder = str(tmp_path / "w")
    warc.write_pages(pages.limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0
    warc.write_pages(pages.coalesce(1), folder)
    names = [n for n in os.listdir(folder) if n.endswith(".warc.gz")]
    text = b"".join(gzip.open(os.path.join(folder, n)).read() for n in names).decode()
    assert len(re.findall(r"^WARC/1\.1\r$", text, re.M)) == 2
    assert "WARC-Refers-To: <urn:page:1>" in text and text.count("x" * 200) == 1


def test_a_cut_off_record_is_an_error(spark, tmp_path):
    data = warc.encode_record(1, "u", b"y" * 5000, hashlib.sha256(b"y" * 5000).hexdigest(), None)
    (tmp_path / "a.warc.gz").write_bytes(data + data[:-9])
    rows = warc.read_archives(spark, str(tmp_path), damaged="keep").collect()
    assert [(r.page_id, r.position, r.error and r.error.split(":")[0]) for r in rows] == [(1, 0, None), (None, len(data), "EOFError")]
    with pytest.raises(Exception, match=f"damaged record in .*a.warc.gz at byte {len(data)}"):
        warc.read_archives(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("range_bytes", [90, 400, 1 << 20])
def test_no_flipped_byte_goes_unseen(tmp_path, range_bytes):
    """With a byte flipped at every tenth position, all five records come back or damage is reported, and at most the two
    records around it are missing."""
    bodies = [("".join(chr(65 + i * k % 57) for i in range(300 + 50 * k)) + "\n").encode() for k in range(1, 6)]
    members = [warc.encode_record(k, f"u{k}", b, hashlib.sha256(b).hexdigest(), None) for k, b in enumerate(bodies)]
    members[3] = warc.encode_record(3, "u3", bodies[2], hashlib.sha256(bodies[2]).hexdigest(), 2)
    whole = b"".join(members)
    path = tmp_path / "a.warc.gz"
    sound = None
    for flip in [None, *range(0, len(whole), 10)]:
        data = bytearray(whole)
        if flip is not None:
            data[flip] ^= 0x55
        path.write_bytes(data)
        with open(path, "rb") as file:
            source = warc.ByteSource(file, len(data))
            found = [r for at in range(0, len(data), range_bytes) for r in warc.records(source, at, min(at + range_bytes, len(data)))]
        good = {warc.describe(f, b) for _, f, b, error in found if error is None}
        bad = [error for *_, error in found if error]
        if flip is None:
            sound = good
            assert len(good) == 5 and not bad
        else:
            assert good <= sound and (good == sound or bad and len(good) >= 3), (flip, bad)
        positions = [at for at, *_ in found]
        assert len(positions) == len(set(positions))


def test_lengths_and_digests_are_checked(spark, tmp_path):
    """A record that is sound as gzip but states a wrong length or digest."""
    body = b"z" * 300
    digest = hashlib.sha256(body).hexdigest()
    good, wrong = warc.encode_record(1, "u", body, digest, None), warc.encode_record(2, "u", body, "0" * 64, None)
    text = gzip.decompress(warc.encode_record(3, "u", body, digest, 1))
    for stated in (b"Content-Length: 7\r\n", b"Content-Length: x\r\n", b""):
        broken = gzip.compress(re.sub(rb"Content-Length: \d+\r\n(?=\r\n)", stated, text, count=1))
        (tmp_path / "a.warc.gz").write_bytes(good + broken + wrong + good)
        rows = warc.read_archives(spark, str(tmp_path), content=True, damaged="keep").collect()
        assert [r.page_id for r in rows] == [1, None, None, 1] and [bool(r.error) for r in rows] == [False, True, True, False]
