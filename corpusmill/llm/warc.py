"""WARC archives: a gzip member per record, and a sequential reader that checks what it reads.

``write_archives`` turns rows into archives, rows of ``(archive, data)`` whose ``data`` is the whole
content of a ``.warc.gz`` file of about ``ARCHIVE_BYTES``; a record never spans two. They live in a
table of the shared folder, because a worker can reach a cluster's store through Spark only;
``archive_files`` reads files of up to 2 GB into the same form, compressed or not. ``read_archives`` inflates each archive
in steps of ``STEP`` bytes, cuts records of any type by their content lengths and verifies block digests, and payload digests
where the payload is there. Damage raises ``ValueError``; fields that are missing, other than a content length, do not.

Equal payloads of at least ``revisit_from`` bytes: the record with the largest page_id is a
response, the others are revisits of it, which hold the HTTP head only. Repeated rows with that
page_id are each a response. Null html is an empty payload; a null page_id is never referred to,
and without any other id in the group all its rows are responses; a null url is written empty.
Extra columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut, map_batches

ARCHIVE_BYTES = 4 << 20
STEP = 1 << 16
DATE = "1970-01-01T00:00:00Z"
_VERSION = b"WARC/1.1"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    lines = _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(lines + block + b"\r\n\r\n") + deflate.flush()


def _text(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it is none."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name after a first line; lines that begin with white space go on with the one before."""
    unfolded = re.sub(r"\r?\n[ \t]+", " ", _text(lines))
    pairs = (x.split(":", 1) for x in re.split(r"\r?\n", unfolded)[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _plain(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What gzip members hold, however many; chunks of a file that is not compressed as they are."""
    inflate, compressed, head = None, None, b""
    for chunk in chunks:
        if compressed is None:
            head += chunk
            if len(head) < 2:
                continue
            compressed, chunk = head[:2] == b"\x1f\x8b", head
        if not compressed:
            yield chunk
            continue
        while chunk:
            inflate = inflate or zlib.decompressobj(31)
            try:
                yield inflate.decompress(chunk)
            except zlib.error as bad:
                raise ValueError(f"damaged gzip member: {bad}") from bad
            chunk = b""
            if inflate.eof:
                chunk, inflate = inflate.unused_data.lstrip(b"\0"), None  # some writers pad
    if inflate is not None or compressed is None and head:
        raise ValueError("archive ends inside a gzip member")


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, in order; holds one record.

    Records are cut by their content lengths, whether a gzip member holds one, several or a part of one. A record
    without a content length, or with something other than two line ends after it, is damage.
    """
    plain, fields, at, looked = bytearray(), None, 0, 0
    for part in _plain(chunks):
        plain += part
        while True:
            if fields is None:
                blank = len(plain) - len(plain.lstrip(b"\r\n"))
                if blank:
                    del plain[:blank]
                    looked = 0
                if not plain:
                    break
                if not plain.startswith(b"WARC/"[: len(plain)]):
                    raise ValueError("not a WARC record")
                end = _HEAD_END.search(plain, max(0, looked - 3))
                if not end:
                    looked = len(plain)
                    break
                fields, at = _fields(bytes(plain[: end.start()])), end.end()
                if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
                    raise ValueError(f"no content length in {fields.get('warc-record-id')}")
            size = int(fields["content-length"])
            if len(plain) < at + size + 4:
                break
            if not plain.startswith((b"\r\n\r\n", b"\n\n"), at + size):
                raise ValueError("record does not end at its content length")
            yield fields, bytes(plain[at : at + size])
            del plain[: at + size]
            fields, looked = None, 0
    if fields is not None and at + int(fields["content-length"]) <= len(plain) and not plain[at + int(fields["content-length"]) :].strip(b"\r\n"):  # the last one, without all line ends
        yield fields, bytes(plain[at : at + int(fields["content-length"])])
    elif fields is not None or plain.strip(b"\r\n"):
        raise ValueError("archive ends inside a record")


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _agrees(said: str | None, data: bytes) -> bool:
    """Whether a digest field is that of the data; fields without one, or by another method than SHA-1, say nothing."""
    kind, _, value = (said or "").partition(":")
    return kind.lower() != "sha1" or value.upper() in (digest(data), hashlib.sha1(data).hexdigest().upper())


def _unchunked(body: bytes) -> bytes | None:
    """The body of a chunked transfer, None if it is none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9a-fA-F]{1,8})\s*(?:;|$)", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def verified(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and payload, after comparing digests and lengths. The payload of a record that holds no HTTP message is
    its block; one that says it was cut short is not compared with lengths, nor is the body of a revisit."""
    if not _agrees(fields.get("warc-block-digest"), block):
        raise ValueError(f"block digest of {fields.get('warc-record-id')}")
    kind = fields.get("warc-type", "")
    if not (fields.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/")) or kind not in ("response", "request", "revisit", "conversion", "resource"):
        if kind != "revisit" and not _agrees(fields.get("warc-payload-digest"), block):
            raise ValueError(f"payload of {fields.get('warc-record-id')}")
        return {}, block
    end = _HEAD_END.search(block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    http = _fields(head)
    if kind == "response" and "warc-truncated" not in fields:
        chunked = "chunked" in http.get("transfer-encoding", "").lower()
        if not _agrees(fields.get("warc-payload-digest"), body) and not (chunked and (inner := _unchunked(body)) is not None and _agrees(fields.get("warc-payload-digest"), inner)):
            raise ValueError(f"payload of {fields.get('warc-record-id')}")
        if not chunked and http.get("content-length", "").isdigit() and int(http["content-length"]) != len(body):
            raise ValueError(f"payload length of {fields.get('warc-record-id')}")
    return http, body


def row_of(fields: dict[str, str], block: bytes) -> tuple:
    """(url, record_type, payload_bytes, payload_digest, payload) of a record. A digest that is not given is taken; size and
    digest of a revisit are those it gives for the payload it stands for, null if it gives none."""
    http, body = verified(fields, block)
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    given = said.partition(":")[2] if said.lower().startswith("sha1:") else None
    if kind == "revisit":
        size = http.get("content-length", "")
        return fields.get("warc-target-uri"), kind, int(size) if size.isdigit() else None, given, body
    return fields.get("warc-target-uri"), kind, len(body), digest(body) if given is None or len(given) != 32 else given.upper(), body


def write_archives(pages: DataFrame, revisit_from: int = 0, size: int = ARCHIVE_BYTES) -> DataFrame:
    """``(archive, data)`` for ``pages(page_id, url, html)``, written to the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # only payloads that come more than once; on its own table, so that the join can split a hot payload
    again = rows.where(F.octet_length("payload") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    again = cut(again.where("n > 1").select("sha", "kept"), "warc-repeated")
    rows = rows.join(again, "sha", "left").select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, held, total, nth = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{nth:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

        for b in batches:
            for i in range(b.num_rows):
                held.append(record(*(c[i].as_py() for c in b.columns)))
                total += len(held[-1])
                if total >= size:
                    yield flush()
                    held, total, nth = [], 0, nth + 1
        if held:
            yield flush()

    return cut(map_batches(rows, run, "archive string, data binary", 200), "warc-archives")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, data)`` of the files at ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """(archive, page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) per record of any type.

    Sizes and digests of a revisit are those of the payload that it stands for. ``page_id`` and ``refers_to`` are null where a
    record's name is not one that ``write_archives`` gives, and so is the url of a record without one.
    """
    types = [("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * keep_payload
    schema = "archive string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * keep_payload

    def page(name: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]):
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], schema=pa.schema(types))

        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_buffer()
                if data is None:
                    continue
                data, out, held = memoryview(data), [], 0
                for fields, block in read_records(bytes(data[at : at + STEP]) for at in range(0, len(data), STEP)):
                    url, kind, size, payload_digest, body = row_of(fields, block)
                    row = (name, page(fields.get("warc-record-id")), url, kind, size, payload_digest, page(fields.get("warc-refers-to")))
                    out.append((*row, body) if keep_payload else row)
                    held += len(body) if keep_payload else 0
                    if len(out) == 200 or held >= ARCHIVE_BYTES:
                        yield batch(out)
                        out, held = [], 0
                if out:
                    yield batch(out)

    return map_batches(archives.select("archive", "data"), run, schema, 8)
