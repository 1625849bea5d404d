"""WARC archives: records with revisits and segments, and their reassembly."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import binary_column, trimmed, written

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
#: The least payload that a revisit may stand for.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_BYTES = 8 << 20
#: Up to so many revisits are sent to every task.
BROADCAST_ROWS = 100_000
_URN = "urn:lexiloom:page:"


# ---------------------------------------------------------------- writing


def revisit_targets(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another: equal payload of at least `least` bytes, smaller id.

    pages has page_id, n, digest, one row or more of each pair. Counting and the greatest id are combined before the
    shuffle, so a payload that a third of all rows share costs no more than another; what moves is ids and digests alone.
    """
    large = pages.where(F.col("n") >= least).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").drop("k")
    return large.join(groups, "digest").where("page_id <> refers_to").distinct()


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """A record for each row of pages (page_id, url, html): the html in UTF-8 as the chunked body of an HTTP response.

    Null html is an empty payload, a null url an empty address. Of equal payloads of at least REVISIT_BYTES the
    greatest page_id is the response and the others revisit it. A block over segment_bytes goes on in
    continuation records. Spark's text writer puts the bytes wherever Spark can write; a file holds about
    file_bytes before compression, so that one task can hold any file. Repeated rows become records of their
    own; columns other than the three are ignored.

    A record is named by page_id and digest, which is what a revisit refers to. Rows that repeat both, if there are
    any, are numbered, and only these are shuffled for it: the first has the plain name.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    marked = rows.withColumn("digest", F.sha1("payload"))
    keys = written(marked.groupBy("page_id", "digest").agg(F.count("*").alias("k"), F.max(F.octet_length("payload")).alias("n")), "pages")
    revisits = written(revisit_targets(keys), "revisits")
    repeated = keys.where("k > 1").select("page_id", "digest")
    again = repeated.limit(BROADCAST_ROWS + 1).count()
    if again:
        known = F.broadcast(repeated) if again <= BROADCAST_ROWS else repeated.hint("merge")
        same = marked["page_id"].eqNullSafe(known["page_id"]) & (marked["digest"] == known["digest"])
        numbered = marked.join(known, same, "left_semi").withColumn("nonce", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) - 1)
        marked = marked.join(known, same, "left_anti").withColumn("nonce", F.lit(0)).unionByName(numbered)
    else:
        marked = marked.withColumn("nonce", F.lit(0))
    # payloads are shuffled only where the revisits are too many to be sent to every task
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = marked.join(F.broadcast(revisits) if few else revisits.hint("merge"), ["page_id", "digest"], "left")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                record = format_record(row["page_id"], row["nonce"], row["url"], row["payload"], row["digest"], row["refers_to"], segment_bytes, chunk_bytes)
                held.append(record)
                size += len(record)
                if size >= file_bytes:
                    yield _one(held)
                    held, size = [], 0
        if held:
            yield _one(held)

    out = marked.select("page_id", "nonce", "url", "payload", "digest", "refers_to").mapInArrow(trimmed(blocks), "value binary")
    # what ends a record, two line ends, is the text writer's separator
    out.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", 1).text(path)


def _one(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([(CRLF * 2).join(held)], pa.binary())], ["value"])


def chunked(body: bytes, chunk_bytes: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + chunk_bytes] for i in range(0, len(body), chunk_bytes))]
    return b"".join((*parts, b"0\r\n\r\n"))


def record_id(page_id, digest: str, nonce: int = 0) -> str:
    name = "" if page_id is None else quote(str(page_id), safe="")
    return f"<{_URN}{name}:{digest}>" if not nonce else f"<{_URN}{name}:{digest}:{nonce}>"


def format_record(page_id, nonce: int, url: str, payload: bytes, digest: str, refers_to, segment_bytes: int, chunk_bytes: int) -> bytes:
    """The record of one page, all its segments, without what ends the last."""
    origin = record_id(page_id, digest, nonce)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = [("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
    uri = re.sub(r"[\r\n]+", " ", url)
    first = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *first, ("WARC-Refers-To", record_id(refers_to, digest))]
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common]
        return _head(fields, http)
    block = http + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = []
    for number, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", origin if number == 1 else f"{origin[:-1]};{number}>"), *first, *common]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
            if number > 1:
                fields.append(("WARC-Segment-Origin-ID", origin))
            if number == len(parts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_head(fields, part))
    return (CRLF * 2).join(out)


def _head(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block), b""]
    return CRLF.join(lines) + CRLF + block


# ---------------------------------------------------------------- reading


#: Bytes that are read or decompressed at a time, the most that a record's header has, and segments held until their record is whole.
STEP_BYTES, HEAD_BYTES, HELD_BYTES = 256 << 10, 256 << 10, 64 << 20
#: The longest record and the longest file (as stored) that are read; each is held by one task.
RECORD_BYTES, FILE_BYTES = 256 << 20, 1 << 30


def inflated(data: bytes, step: int = STEP_BYTES) -> Iterator[bytes]:
    """data, or what it holds where it is gzip, of one member or of many; `step` bytes at a time. ValueError where it is cut off."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    member = None
    try:
        for at in range(0, len(data), step):
            part = data[at : at + step]
            while part:
                if member is None:
                    part = part.lstrip(b"\0")  # padding between members
                    member = zlib.decompressobj(31)
                yield member.decompress(part, step)
                part, member = (member.unused_data, None) if member.eof else (member.unconsumed_tail, member)
        while member is not None and not member.eof:
            if not (rest := member.decompress(b"", step)):
                raise ValueError("gzip data is cut off")
            yield rest
    except zlib.error as e:
        raise ValueError(f"gzip data is broken: {e}") from e


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields in lower case, block, error) of each record, in time that grows with the bytes whatever lengths say.

    No more is held than one record, or RECORD_BYTES where a record says that it is longer than the archive goes on. What is no record,
    has no length, is cut off or says that it has more than RECORD_BYTES gives a row with an error and no block; reading goes
    on at the next line that begins a record.
    """
    parts, buffer, trouble = inflated(data), bytearray(), []

    def more() -> bool:
        try:
            buffer.extend(next(parts))
        except StopIteration:
            return False
        except ValueError as e:
            trouble.append(str(e))
            return False
        return True

    def skip_to_next(start: int) -> None:
        del buffer[:start]
        while (at := buffer.find(b"\nWARC/")) < 0:
            del buffer[: max(0, len(buffer) - 5)]
            if not more():
                buffer.clear()
                return
        del buffer[: at + 1]

    while True:
        while True:
            blank = 0
            while blank < len(buffer) and buffer[blank] in b"\r\n":
                blank += 1
            del buffer[:blank]
            if buffer or not more():
                break
        if not buffer:
            break
        while (stop := buffer.find(b"\r\n\r\n")) < 0 and len(buffer) < HEAD_BYTES and more():
            pass
        if stop < 0 or not buffer.startswith(b"WARC/"):
            yield {}, b"", "no record where one should begin"
            skip_to_next(1)
            continue
        fields: dict[str, str] = {}
        for line in bytes(buffer[:stop]).split(CRLF)[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", size):
            yield fields, b"", "the record has no length"
            skip_to_next(stop)
            continue
        end = stop + 4 + int(size)
        if end > RECORD_BYTES:
            yield fields, b"", "the record is too long"
            skip_to_next(stop)
            continue
        while len(buffer) < end and more():
            pass
        if len(buffer) < end:
            yield fields, b"", "the record is cut off"
            skip_to_next(stop)
            continue
        yield fields, bytes(buffer[stop + 4 : end]), None
        del buffer[:end]
    if trouble:
        yield {}, b"", trouble[0]


def dechunk(body: bytes) -> bytes:
    """The body without chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(CRLF, at)
        if stop < 0:
            raise ValueError("chunk size is missing")
        size = body[at:stop].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError("chunk size is no number")
        n = int(size, 16)
        at = stop + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header is cut off")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return dechunk(body)
    return body


def assemble(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """(payload, error) of (number, total length or None, block) in any order; equal segments may repeat."""
    by_number = {n: b for n, _, b in segments}
    totals = {t for _, t, _ in segments if t is not None}
    block = b"".join(by_number[n] for n in sorted(by_number))
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        return None, "a segment is missing"
    if len(totals) > 1 or (len(by_number) > 1 and not totals):
        return None, "the total length is missing or not one"
    if totals and totals != {len(block)}:
        return None, f"{len(block)} bytes, not {totals.pop()}"
    try:
        return http_payload(block), None
    except ValueError as e:
        return None, str(e)


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch("[0-9]{1,18}", value) else None


def hex_digest(value: str | None) -> str | None:
    """The SHA-1 of a digest field in lower-case hex, whether it is written in base32 or in hex; None for any other."""
    kind, _, own = (value or "").partition(":")
    try:
        if kind.lower() == "sha1":
            return own.lower() if re.fullmatch("[0-9A-Fa-f]{40}", own) else base64.b32decode(own.upper()).hex()
    except binascii.Error:
        pass
    return None


_SEGMENT = "record_id string, record_type string, url string, digest string, refers_to string, number int, total bigint, block binary, payload binary, error string, whole boolean"


def checked(segments: list[tuple[int, int | None, bytes]], digest: str | None) -> tuple[bytes | None, str | None]:
    payload, error = assemble(segments)
    if payload is not None and digest not in (None, hashlib.sha1(payload).hexdigest()):
        return None, "the payload is not what its digest says"
    return payload, error


def _record(fields: dict, segments: list[tuple[int, int | None, bytes]]) -> tuple:
    """A whole record's row: its payload, or an error."""
    digest, payload, error = hex_digest(fields.get("warc-payload-digest")), None, None
    if fields.get("warc-type") != "revisit":
        payload, error = checked(segments, digest)
    return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), None, None, None, payload, error, True)


def _segment(origin: str, fields: dict, segment: tuple[int, int | None, bytes]) -> tuple:
    return (origin, fields.get("warc-type"), fields.get("warc-target-uri"), hex_digest(fields.get("warc-payload-digest")), fields.get("warc-refers-to"), *segment, None, None, False)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files under path that is whole there, and one for each other segment, under its origin's record_id.

    A record whose segments stand in one file is put together where it is read; what isn't whole at the file's end, or
    is over HELD_BYTES, is left to read_warc. A file is read by one task; one of more than FILE_BYTES is not read and gives a row with an error
    that names it.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.bool_()]
        for batch in batches:
            for data in binary_column(batch, "content"):
                rows, size = [], 0
                for row in file_records(data):
                    rows.append(row)
                    size += len(row[7] or b"") + len(row[8] or b"")
                    if size > 16 << 20:
                        yield _columns(rows, names, kinds)
                        rows, size = [], 0
                if rows:
                    yield _columns(rows, names, kinds)

    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > FILE_BYTES).select("path")
    kinds = [x.split() for x in _SEGMENT.split(", ")]
    own = {"record_type": F.lit("unknown"), "error": F.concat(F.lit("the file is too long: "), "path"), "whole": F.lit(True)}
    large = large.select(*(own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds))
    return files.where(F.col("length") <= FILE_BYTES).select("content").mapInArrow(trimmed(parse), _SEGMENT).unionByName(large)


def file_records(data: bytes) -> Iterator[tuple]:
    """Rows of one file, see read_segments. Records of other types than response, revisit and continuation are passed over."""
    held: dict[str, list[tuple[dict, tuple[int, int | None, bytes]]]] = {}
    size = 0
    for f, block, error in parse_warc(data):
        kind = f.get("warc-type")
        if error:
            yield (f.get("warc-record-id"), kind or "unknown", f.get("warc-target-uri"), None, f.get("warc-refers-to"), None, None, None, None, error, True)
            continue
        if kind not in ("response", "revisit", "continuation"):
            continue
        segment = (_number(f.get("warc-segment-number")) or 1, _number(f.get("warc-segment-total-length")), block)
        if "warc-segment-number" not in f and kind != "continuation":
            yield _record(f, [segment])
            continue
        origin = f.get("warc-segment-origin-id") or f.get("warc-record-id") or ""
        own = held.setdefault(origin, [])
        own.append((f, segment))
        size += len(block)
        if segment[1] is not None and [n for _, (n, _, _) in own] == list(range(1, len(own) + 1)):
            size -= sum(len(b) for _, (_, _, b) in own)
            yield _record(own[0][0], [x for _, x in held.pop(origin)])
        elif size > HELD_BYTES:
            yield from (_segment(o, *x) for o, parts in held.items() for x in parts)
            held, size = {}, 0
    yield from (_segment(o, *x) for o, parts in held.items() for x in parts)


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_RECORD = "page_id string, record_type string, url string, digest string, refers_to string, payload binary, error string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, record_type, url, digest (hex), refers_to, payload, error.

    Files are read and parsed once, into a table in the shared folder. Segments of a record that no one file holds are
    grouped by their origin's identifier, put in order and checked against the total length; a group is one record,
    never more. payload is null and error says why where a record is not whole or its payload is not what its
    digest says; so does a row for what can't be read as a record at all. A revisit has no payload. Archives without
    records give no rows. Digests may be base32 or hex, in either case; those of other kinds are not checked.
    """
    found = written(read_segments(spark, path), "records")
    names = ("record_type", "url", "digest")
    alone = found.where("whole").select(_page("record_id"), *names, _page("refers_to"), "payload", "error")
    groups = (
        found.where("not whole").groupBy("record_id")
        .agg(F.max(F.when(F.col("number") == 1, F.struct(*names, "refers_to"))).alias("first"), F.collect_list(F.struct("number", "total", "block")).alias("parts"))
        .select(_page("record_id"), F.coalesce("first.record_type", F.lit("response")).alias("record_type"), "first.url", "first.digest", _page("first.refers_to"), "parts")
    )
    return alone.unionByName(groups.mapInArrow(trimmed(_whole), _RECORD))


def _page(name: str):
    """The page_id in a record's identifier, null in one of another archive."""
    own = F.regexp_extract(name, rf"^<{_URN}([^:>]*)", 1)
    return F.url_decode(F.nullif(own, F.lit(""))).alias("page_id" if name == "record_id" else "refers_to")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.binary(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            payload, error = checked([(p["number"], p["total"], p["block"]) for p in r["parts"]], r["digest"])
            yield _columns([(r["page_id"], r["record_type"], r["url"], r["digest"], r["refers_to"], payload, error)], names, kinds)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, refers_to: revisits take the length of the response of their digest.

    Payloads are reduced to length and digest before the join; responses that repeat a page_id and a digest are one
    row of it, and one that very many revisits name makes one large join key, which adaptive execution splits.
    """
    sizes = records.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.coalesce(F.sha1("payload"), F.col("digest")).alias("d"))
    sizes = written(sizes, "sizes")
    answers = sizes.where("record_type = 'response'")
    known = answers.groupBy(F.col("page_id").alias("refers_to"), "d").agg(F.max("n").alias("n"))
    revisits = sizes.where("record_type = 'revisit'").drop("n").join(known, ["refers_to", "d"], "left")
    both = answers.select("page_id", "record_type", "refers_to", "n", "d").unionByName(revisits)
    return both.select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
