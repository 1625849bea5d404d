from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from lexiloom.llm import warc as W


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("few", [100_000, 2])
def test_round_trip(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(W, "BROADCAST_ROWS", few)
    rng = random.Random(1)
    long = ["".join(rng.choice("abc é漢\r\n<>") for _ in range(n)) for n in (999, 1200, 5000, 70_000)]
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 60
    htmls = [None, "", "x", "x", *long, *long, long[1], tricky, tricky, "é" * 500, "é" * 500]
    rows = [(i, f"http://e/{i}" if i % 3 else None, h, "p") for i, h in enumerate(htmls)]
    path = str(tmp_path / "w")
    W.write_warc(make(spark, rows).repartition(3), path, segment_bytes=1000, chunk_bytes=300, file_bytes=20_000)
    records = W.read_warc(spark, path)
    assert {r.page_id: (r.payload.decode() if r.payload is not None else None, r.error) for r in records.collect() if r.record_type == "response"} == {
        str(i): (h or "", None) for i, _, h, _ in rows if not _revisit(rows, i)
    }
    got = {int(r.page_id): r for r in W.resolve_revisits(records).collect()}
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        same = [j for j, _, x, _ in rows if x == h]
        want = max(same) if len(data) >= 1000 and max(same) != i else None
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (
            len(data), hashlib.sha1(data).hexdigest(), "response" if want is None else "revisit", None if want is None else str(want),
        )


def _revisit(rows, i):
    h = rows[i][2]
    return h is not None and len(h.encode()) >= 1000 and any(j > i and x == h for j, _, x, _ in rows)


def test_repeated_rows_null_ids_and_no_rows(spark, tmp_path):
    rows = [(7, "u", "y" * 1500, "p")] * 2 + [(None, "u", "short", "p")]
    W.write_warc(make(spark, rows), str(tmp_path / "a"), segment_bytes=700)
    got = sorted((r.page_id or "", r.record_type, r.payload_bytes) for r in W.resolve_revisits(W.read_warc(spark, str(tmp_path / "a"))).collect())
    assert got == [("", "response", 5), ("7", "response", 1500), ("7", "response", 1500)]
    W.write_warc(make(spark, []), str(tmp_path / "b"))
    assert W.read_warc(spark, str(tmp_path / "b")).count() == 0


def test_reassembly_notices_what_is_wrong():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + W.chunked(b"hello world", 4)
    a, b, c = block[:20], block[20:50], block[50:]
    assert W.assemble([(3, len(block), c), (1, None, a), (2, None, b)]) == (b"hello world", None)
    assert W.assemble([(1, None, a), (2, None, b), (2, None, b), (3, len(block), c)]) == (b"hello world", None)
    assert W.assemble([(1, None, a), (3, len(block), c)]) == (None, "a segment is missing")
    assert W.assemble([(1, None, a), (2, None, b)])[1] == "the total length is missing or not one"
    assert W.assemble([(1, None, a), (2, None, b), (3, 5, c)])[1].endswith("not 5")
    assert W.assemble([(1, None, block[:-4])])[0] is None
    assert W.assemble([(1, None, b"HTTP/1.1 200 OK\r\n\r\nplain")]) == (b"plain", None)


def test_chunks():
    for data in (b"", b"a", bytes(range(256)) * 9):
        assert W.dechunk(W.chunked(data, 100)) == data
    assert W.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            W.dechunk(bad)


def test_parse_plain_gzip_and_members():
    one = W.format_record(5, 0, "u", b"x" * 10, hashlib.sha1(b"x" * 10).hexdigest(), None, 1 << 20, 100)
    end = b"\r\n\r\n"
    for data in (one + end + one + end, gzip.compress(one + end + one + end), gzip.compress(one + end) + gzip.compress(one + end)):
        assert [(f["warc-type"], e) for f, _, e in W.parse_warc(data)] == [("response", None)] * 2
    assert [e for _, _, e in W.parse_warc(one[:-3])] == ["the record is cut off"]
    assert [e for _, _, e in W.parse_warc(b"no record")] == ["no record where one should begin"]
    assert [e for _, _, e in W.parse_warc(gzip.compress(one + end)[:-12])][-1] == "gzip data is cut off"
    big = one.replace(b"x" * 10, b"y" * 10) + end
    members = b"".join(gzip.compress(big) for _ in range(3000))
    assert sum(e is None for _, _, e in W.parse_warc(members)) == 3000


def test_foreign_archives(spark, tmp_path):
    """Broken records are rows with an error; the others of the archive are read. Digests in hex or base32 of either case."""
    import base64

    body, end = b"some words " * 20, b"\r\n\r\n"
    sha = hashlib.sha1(body)
    http = b"HTTP/1.0 200 OK\r\n\r\n" + body

    def record(name, digest, extra=(), block=http, length=None, kind="response"):
        fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{name}>", f"WARC-Payload-Digest: {digest}", *extra]
        fields += [] if length == 0 else [f"Content-Length: {len(block) if length is None else length}"]
        return "\r\n".join(["WARC/1.0", *fields]).encode() + end + block + end

    base32 = base64.b32encode(sha.digest()).decode()
    good = [record("a", f"sha1:{base32}"), record("b", f"sha1:{base32.lower()}"), record("c", f"sha1:{sha.hexdigest().upper()}"), record("d", "md5:abc"), record("e", "sha1:!!!")]
    bad = [record("f", "sha1:" + "0" * 40), record("g", "", length=0), b"junk that is no record\r\n\r\n", record("h", "", block=b"no http"), record("info", "", kind="warcinfo")]
    total = len(http)
    first = record("s", f"sha1:{base32}", ["WARC-Segment-Number: 1"], http[:50])
    second = record("t", "", ["WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:x:s>", f"WARC-Segment-Total-Length: {total}"], http[50:], kind="continuation")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "1.warc").write_bytes(b"".join([good[0], bad[0], good[1], bad[1], good[2], bad[2], good[3], bad[3], good[4], bad[4], second]))
    (tmp_path / "w" / "2.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(good[0]) + gzip.compress(good[0])[:-10])
    (tmp_path / "w" / "3.warc").write_bytes(good[0] + record("z", "", length=10_000) + good[1])
    (tmp_path / "w" / "4.warc").write_bytes(b"")
    got = [(r.payload, r.error) for r in W.read_warc(spark, str(tmp_path / "w")).collect()]
    assert sum(p == body for p, _ in got) == 5 + 1 + 1 + 2 + 1  # with the record whose segments stand in two files; the last before the cut is whole
    assert sorted(e for _, e in got if e) == [
        "HTTP header is cut off", "gzip data is cut off", "no record where one should begin", "the payload is not what its digest says", "the record has no length", "the record is cut off",
    ]


def test_a_revisit_names_its_record_and_takes_the_length_of_its_digest(spark, tmp_path):
    rows = [(7, "u", "y" * 1500, "p"), (7, "v", "z" * 2500, "p"), (7, "v", "z" * 2500, "p"), (3, "u", "y" * 1500, "p"), (4, "u", "z" * 2500, "p")]
    W.write_warc(make(spark, rows), str(tmp_path / "w"), segment_bytes=700)
    ids, refers = set(), set()
    for path in (tmp_path / "w").glob("*.gz"):
        for f, _, _ in W.parse_warc(path.read_bytes()):
            if f["warc-type"] == "response":
                assert f["warc-record-id"] not in ids
                ids.add(f["warc-record-id"])
            refers |= {f["warc-refers-to"]} if "warc-refers-to" in f else set()
    assert len(ids) == 3 and len(refers) == 2 and refers <= ids
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in W.resolve_revisits(W.read_warc(spark, str(tmp_path / "w"))).collect())
    assert got == [("3", "revisit", 1500, "7"), ("4", "revisit", 2500, "7"), ("7", "response", 1500, None), ("7", "response", 2500, None), ("7", "response", 2500, None)]


def test_false_lengths_cost_no_more_than_their_bytes(monkeypatch):
    """Records behind one that says it is longer than the archive are read in time that grows with the bytes."""
    import time

    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1000\r\n\r\n" + b"x" * 1000 + b"\r\n\r\n"
    false = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 100000000\r\n\r\nshort\r\n\r\n"

    def timed(n):
        began = time.perf_counter()
        got = [e for _, _, e in W.parse_warc(false + one * n)]
        assert got == ["the record is cut off", *[None] * n]
        return time.perf_counter() - began

    timed(100)
    few, many = min(timed(1500) for _ in range(3)), timed(12_000)
    assert many < 20 * few + 1
    monkeypatch.setattr(W, "RECORD_BYTES", 5000)
    assert [e for _, _, e in W.parse_warc(false + one + one)] == ["the record is too long", None, None]


def test_a_file_over_the_limit_is_a_row_with_an_error(spark, tmp_path, monkeypatch):
    W.write_warc(make(spark, [(1, "u", "y" * 3000, "p")]), str(tmp_path / "w"))
    (tmp_path / "w" / "zz.warc").write_bytes(b"WARC/1.0\r\n" + b"a" * 50_000)
    monkeypatch.setattr(W, "FILE_BYTES", 20_000)
    got = W.read_warc(spark, str(tmp_path / "w")).collect()
    assert [r.error for r in got if r.error] == [next(r.error for r in got if r.error)] and "zz.warc" in next(r.error for r in got if r.error)
    assert [len(r.payload) for r in got if r.payload] == [3000]
