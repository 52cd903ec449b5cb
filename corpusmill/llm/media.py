"""Media columns: lossless storage of bytes as images, and signature sniffing of binary columns.

``sniff`` finds every known magic number of a value in one Aho-Corasick pass. Each hit goes to its
format's validator, which walks the structure (chunk checksums, segment and block lengths) and
returns the item's length, or nothing. An item that begins at byte 0 gives the value's true type,
whatever was declared; later ones are embedded media with their byte ranges. Hits inside an
accepted item are part of it, except in PDF, whose streams may hold whole images.

``as_images`` stores a text's UTF-8 bytes, padded with bytes 255 to a positive multiple of
``WIDTH``, as rows of an 8-bit grey PNG; ``features`` sniffs, decodes and measures what is stored.
Equal texts give equal values. Null and empty texts are one row of padding. A null value, or one
without a known signature, has type null and no features. Extra columns are ignored; repeated rows
and null ids are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, map_batches, named

WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


# --- validators: (data, start, what is known of the value) -> (type, end) or None -------------


def _png(data: bytes, at: int, known: dict):
    pos, first = at + len(_PNG), True
    while pos + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + size
        if end > len(data) or first != (kind == b"IHDR") or zlib.crc32(memoryview(data)[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", end
        pos, first = end, False
    return None


def _walk(pos: int, known: dict, step) -> int | None:
    """Follows ``step(pos)``, the next place or (end,) or None, to the item's end. ``known`` keeps the end for every place
    that was passed, so starts that meet the same structure again do not walk through it again."""
    passed = []
    while pos not in known:
        passed.append(pos)
        nxt = step(pos)
        if not isinstance(nxt, int):
            known[pos] = nxt[0] if nxt else None
            break
        pos = nxt
    end = known[pos]
    known.update(dict.fromkeys(passed, end))
    return end


def _jpeg(data: bytes, at: int, known: dict):
    def after_scan(pos: int) -> int | None:
        """Entropy-coded data runs to the next marker that is not stuffing or a restart."""
        ends = known.get("markers")
        if ends is None:
            ends = known["markers"] = [m.start() for m in _MARKER.finditer(data)]
        i = bisect.bisect_left(ends, pos)
        return ends[i] if i < len(ends) else None

    def step(pos: int):
        if pos + 2 > len(data) or data[pos] != 0xFF:
            return None
        marker = data[pos + 1]
        if marker == 0xD9:
            return (pos + 2,)
        if marker == 0xFF:  # fill byte
            return pos + 1
        if pos + 4 > len(data):
            return None
        end = pos + 2 + struct.unpack_from(">H", data, pos + 2)[0]
        return after_scan(end) if marker == 0xDA else end if end > pos else None

    end = _walk(at + 2, known, step)
    return ("image/jpeg", end) if end else None


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def _gif(data: bytes, at: int, known: dict):
    if at + 13 > len(data):
        return None
    flags = data[at + 10]

    def step(pos: int):
        if pos < 0:  # inside data blocks
            p = -pos
            if p >= len(data):
                return None
            return -(p + data[p] + 1) if data[p] else p + 1
        if pos >= len(data):
            return None
        if data[pos] == 0x3B:
            return (pos + 1,)
        if data[pos] == 0x21:
            return -(pos + 2)
        if data[pos] == 0x2C and pos + 10 < len(data):
            local = data[pos + 9]
            return -(pos + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
        return None

    end = _walk(at + 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0), known, step)
    return ("image/gif", end) if end else None


def _riff(data: bytes, at: int, known: dict):
    if at + 12 > len(data):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    kind = _RIFF.get(bytes(data[at + 8 : at + 12]))
    return (kind, end) if kind and at + 12 <= end <= len(data) else None


def _pdf(data: bytes, at: int, known: dict):
    """Ends at the last end mark whose ``startxref``, counted from ``at``, names a cross-reference: each
    update adds one. Without any, at the last end mark before the next header."""
    marks = known.setdefault("marks", None) or [m for m in _XREF_EOF.finditer(data) if len(m[1]) < 16]
    known["marks"], end = marks, None
    for m in reversed(marks):  # the last one that fits
        if m.start() < at:
            break
        if at + int(m[1]) < m.start() and _XREF.match(data, at + int(m[1])):
            end = m.end()
            break
    if end is None:
        eofs = known.get("eofs")
        if eofs is None:
            eofs = known["eofs"] = [m.start() for m in re.finditer(b"%%EOF", data)]
        stop = data.find(b"%PDF-", at + 5)
        i = bisect.bisect_left(eofs, at)
        last = bisect.bisect_left(eofs, stop) - 1 if stop >= 0 else len(eofs) - 1
        i = max(i, last)
        end = eofs[i] + 5 if i < len(eofs) else None
    return ("application/pdf", end) if end else None


_XREF_EOF = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
_XREF = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")

#: Magic number, validator.
SIGNATURES = [(_PNG, _png), (b"\xff\xd8\xff", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"RIFF", _riff), (b"%PDF-", _pdf)]
#: What an item of the type cannot be without; past its last place no start can be valid.
_LAST = {_png: b"IEND", _jpeg: b"\xff\xd9", _gif: b";", _pdf: b"%%EOF"}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, check in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic), check))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each valid item, in order."""
    found, past, limits, known = [], 0, {}, {}
    for last, (size, check) in _automaton().iter(data.decode("latin-1")):
        at = last - size + 1
        if at < past:
            continue
        if check in _LAST and check not in limits:
            limits[check] = data.rfind(_LAST[check])
        if at > limits.get(check, at):
            continue
        item = check(data, at, known.setdefault(check, {}))
        if item:
            found.append((item[0], at, item[1]))
            past = at + 1 if check is _pdf else item[1]
    return found


# --- PNG ------------------------------------------------------------------------------------


def png_of(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey PNG; ``samples`` is a positive multiple of ``width`` long."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_samples(data: bytes, start: int = 0, end: int | None = None) -> np.ndarray | None:
    """Rows of samples of an 8-bit grey PNG whose lines have no filter; None for other kinds."""
    pos, body, shape = start + len(_PNG), [], None
    while pos < (len(data) if end is None else end):
        size, kind = struct.unpack_from(">I4s", data, pos)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack_from(">IIBBBBB", data, pos + 8)
            if (depth, colour, laced) != (8, 0, 0):
                return None
            shape = (height, width + 1)
        elif kind == b"IDAT":
            body.append(data[pos + 8 : pos + 8 + size])
        pos += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if shape is None or lines.size != shape[0] * shape[1]:
        return None
    lines = lines.reshape(shape)
    return None if lines[:, 0].any() else np.ascontiguousarray(lines[:, 1:])


def measure(samples: np.ndarray) -> str:
    """Height, sum, sum of squares and 8-bin histogram, in whole numbers."""
    hist = np.bincount(samples.ravel() >> 5, minlength=8)
    x = np.bincount(samples.ravel(), minlength=256).astype(object)
    level = np.arange(256).astype(object)
    return f"{samples.shape[1]}x{samples.shape[0]};{(x * level).sum()};{(x * level * level).sum()};" + ",".join(map(str, hist))


# --- columns --------------------------------------------------------------------------------


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + b"\xff" * (-len(data) % width if data else width)


def as_images(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, declared, media)``, written to the shared folder."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array([png_of(padded(x)) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "declared", "media"])

    return cut(map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_bytes long, declared string, media binary", 32), "media")


_FOUND = [("media_type", pa.string()), ("mismatch", pa.bool_()), ("embedded", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]
_FOUND_SQL = "media_type string, mismatch boolean, embedded array<struct<type:string,start:bigint,end:bigint>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def inspect(data: bytes | None, declared: str | None) -> tuple:
    """The values of ``features`` for one item."""
    if data is None:
        return (None,) * len(_FOUND)
    items = sniff(data)
    own = next((x for x in items if x[1] == 0), None)
    inner = [{"type": t, "start": a, "end": z} for t, a, z in items if a > 0]
    kind = own[0] if own else None
    head = (kind, kind is not None and kind != declared, inner, len(data), hashlib.sha256(data).hexdigest())
    samples = png_samples(data, 0, own[2]) if kind == "image/png" else None
    if samples is None:
        return (*head, None, None, None, None)
    payload = samples.tobytes()
    return (*head, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), f"{kind};{measure(samples)}")


def features(table: DataFrame, keep: list[str], media: str = "media", declared: str = "declared") -> DataFrame:
    """The columns ``keep`` and, per value, its true type, whether it was declared wrongly, embedded
    items, digests and features. ``media_type`` is null for an unknown signature."""
    kept = table.select(*named(keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + _FOUND_SQL

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [inspect(m.as_py(), d.as_py()) for m, d in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays(b.columns[:-2] + [pa.array(c, t) for c, (_, t) in zip(cols, _FOUND, strict=True)], names=[*keep, *(n for n, _ in _FOUND)])

    return map_batches(table.select(*named(keep), F.col(media).alias("_media"), F.col(declared).alias("_declared")), run, schema, 32)
