"""WARC: a writer that turns equal payloads into revisits, and a salvage reader.

Writer. Of the records with equal payloads of at least `least` bytes the one with the largest id is a response and
the others are revisits that refer to it; shorter ones are all responses. Every record is a gzip member by itself.
Archives are rows (archive, content) of a table in the shared folder, so that no executor's own disk is needed.

Reader. Reads gzip members and plain records in turn and checks version line, lengths, closing line breaks, the
member's CRC and the digests of block and payload (SHA-1 in base 32 or hex; others aren't checked). Headers may be
folded; a revisit by another writer may lack the payload's length. After a failed check it searches for the next place
where a valid member or version line begins, goes on there and reports the bytes between as a quarantined gap. Inside a
member the same search runs over its unpacked bytes, also over what a damaged member gives before its damage; gaps in
there have the member's offset and, as `inner`, their place in its content.

Cases: a null html is an empty payload; a null url leaves its header out; line breaks in a url are escaped. Rows
with a null id are responses. Rows that share the response's id are responses too. Empty table: empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, written

LEAST = 1000
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 1 << 20
#: Repeated payloads' rows (some 60 bytes each) that may be sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+$")


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, body, digest, refers_to) for every row; refers_to is null for responses."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    rows = rows.select("*", F.sha1(F.col("body").cast("binary")).alias("digest"))
    long = F.octet_length("body") >= least
    repeated = rows.where(long).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    repeated = written(repeated, "repeated", 8)
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, "digest", "left").select("id", "url", "body", "digest", F.when(long & (F.col("id") != F.col("first")), F.col("first")).alias("refers_to"))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *headers, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return VERSION + b"\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def page_record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """The WARC record of one page, uncompressed."""
    headers = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    http = (_HTTP % len(body)).encode()
    if refers_to is None:
        return _record("response", name, [*headers, ("Content-Type", "application/http;msgtype=response")], http + body)
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(len(body)))]
    return _record("revisit", name, [*headers, ("Content-Type", "application/http;msgtype=response")], http)


def write(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): the archives of rows(id, url, body, digest, refers_to)."""
    limit_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> tuple[str, list[bytes]]:
            name = f"{uuid.uuid4().hex}.warc.gz"
            return name, [_member(_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))]

        def closed(name: str, held: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        (name, held), size = opened(), 0
        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_member(page_record(page_id, url, body.encode("utf-8", "surrogatepass"), digest, refers_to)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed(name, held)
                    (name, held), size = opened(), 0
        if size:
            yield closed(name, held)

    return rows.select("id", "url", "body", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def save_files(archives: DataFrame, folder: str) -> None:
    """Write every archive as a file of its name to a folder that all executors mount."""

    def run(rows: Iterator) -> None:
        for r in rows:
            with open(f"{folder}/{r['archive']}", "wb") as f:
                f.write(r["content"])

    archives.foreachPartition(run)


class _Bad(ValueError):
    pass


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins here."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Bad("headers don't end")
    first, *lines = data[at:end].split(b"\r\n")
    if not _VERSION.match(first):
        raise _Bad("no version line")
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:  # folded: goes on from the line before
            headers[name] = f"{headers[name]} {_text(line)}".strip()
            continue
        k, colon, v = line.partition(b":")
        if not colon:
            raise _Bad("a header without a colon")
        name = k.strip().lower().decode("utf-8", "replace")
        headers[name] = _text(v)
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise _Bad("no length")
    begin, close = end + 4, end + 4 + int(length)
    if data[close : close + 4] != b"\r\n\r\n":
        raise _Bad("the block's length doesn't fit")
    return headers, data[begin:close], close + 4


def _text(v: bytes) -> str:
    try:
        return v.strip().decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return v.strip().decode("utf-8", "replace")


def _told(digest: str) -> str | None:
    """A header's SHA-1 as hex digits, from base 32 or hex; None if there is none."""
    kind, _, value = digest.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError as e:
        raise _Bad("a digest that can't be read") from e


def _unpacked(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member that begins here holds, its end (None: damaged), and what is wrong with it."""
    unpack, out, begin = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if begin >= len(data):
                return b"".join(out), None, "a member is cut off"
            out.append(unpack.decompress(data[begin : begin + 8192]))
            begin += 8192
    except zlib.error:
        return b"".join(out), None, "a member's check fails"
    return b"".join(out), min(begin, len(data)) - len(unpack.unused_data), ""


def _checked(headers: dict[str, str], block: bytes) -> dict:
    """What the reader returns of one record."""
    kind = headers.get("warc-type", "")
    payload = block
    told = _told(headers.get("warc-block-digest", ""))
    if told and told != hashlib.sha1(block).hexdigest():
        raise _Bad("the block's digest doesn't fit")
    if headers.get("content-type", "").startswith("application/http") and (kind != "revisit" or b"\r\n\r\n" in block):
        _, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise _Bad("an HTTP header doesn't end")
    told = _told(headers.get("warc-payload-digest", ""))
    same = {"kind": kind, "record_id": headers.get("warc-record-id"), "url": headers.get("warc-target-uri")}
    if kind != "revisit":
        digest = hashlib.sha1(payload).hexdigest()
        if told and told != digest:
            raise _Bad("the payload's digest doesn't fit")
        return same | {"payload": payload, "digest": digest, "length": len(payload), "refers_to": None}
    length = headers.get("x-payload-length", "")
    return same | {"payload": None, "digest": told, "length": int(length) if length.isascii() and length.isdigit() else None, "refers_to": headers.get("warc-refers-to")}


def _records(content: bytes) -> Iterator[dict]:
    """The records of plain bytes that hold, with `at`, and a row of kind `gap` for each stretch between."""
    at, lost, why = 0, None, ""
    while at < len(content):
        try:
            headers, block, end = _plain(content, at)
            found = _checked(headers, block) | {"at": at}
        except _Bad as e:
            if lost is None:
                lost, why = at, str(e)
            ahead = content.find(b"WARC/", at + 1)
            at = ahead if ahead >= 0 else len(content)
            continue
        if lost is not None:
            yield {"kind": "gap", "at": lost, "length": at - lost, "reason": why}
            lost = None
        yield found
        at = end
    if lost is not None:
        yield {"kind": "gap", "at": lost, "length": len(content) - lost, "reason": why}


def salvage(data: bytes) -> Iterator[dict]:
    """All records that hold (keys as in _checked, with offset) and a row of kind `gap` for each stretch between."""

    def at_place(at: int) -> tuple[list[dict], int | None, str]:
        if not data.startswith(b"\x1f\x8b", at):
            headers, block, end = _plain(data, at)
            return [_checked(headers, block)], end, ""
        content, end, why = _unpacked(data, at)
        found = [x | {"inner": x.pop("at")} for x in _records(content)]
        if end is None:  # what came before the damage counts, the rest is in the gap
            return [x for x in found if x["kind"] != "gap"], None, why
        if found and all(x["kind"] == "gap" for x in found):
            raise _Bad(found[0]["reason"])
        return found, end, ""

    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            found, end, wrong = at_place(at)
        except _Bad as e:
            found, end, wrong = [], None, str(e)
        if end is None:
            for x in found:
                yield x | {"offset": at}
            if lost is None:
                lost, why = at, wrong
            ahead = _BEGIN.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if lost is not None:
            yield {"kind": "gap", "offset": lost, "length": at - lost, "reason": why}
            lost = None
        for x in found:
            yield x | {"offset": at}
        at = end
    if lost is not None:
        yield {"kind": "gap", "offset": lost, "length": len(data) - lost, "reason": why}


_SHAPE = {"archive": pa.string(), "offset": pa.int64(), "kind": pa.string(), "record_id": pa.string(), "url": pa.string(), "payload": pa.binary(), "digest": pa.string(), "length": pa.int64(), "refers_to": pa.string(), "reason": pa.string(), "inner": pa.int64()}


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of archives(archive, content), and one of kind `gap` for each quarantined stretch."""
    limit_batches(archives.sparkSession)
    names = list(_SHAPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for x in salvage(content.as_py() or b""):
                    if not payloads:
                        x.pop("payload", None)
                    held.append(x | {"archive": archive})
                    size += len(x.get("payload") or b"") + 200
                    if size > 4_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _SHAPE.items()], names=names)

    return archives.select("archive", "content").mapInArrow(run, "archive string, offset bigint, kind string, record_id string, url string, payload binary, digest string, length bigint, refers_to string, reason string, inner bigint")


def read_files(spark, path: str) -> DataFrame:
    """read() of .warc and .warc.gz files."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))


def page_of(name: Column) -> Column:
    """The page's id in a record's name; null if the page had none."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all pages as archives in the shared folder and read these back: the reader's rows, without payloads."""
    archives = written(write(decided(pages, id_col, url_col, body_col)), "warc")
    return read(archives, payloads=False)
