"""Near-duplicate families: character shingles, MinHash, banded equi-join, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import normal_form
from corpusmill.operators.graph import connected_components
from corpusmill.session import cut, map_batches

HASHES, BANDS, SHINGLE, SEED, THRESHOLD = 128, 32, 5, 42, 0.85
#: Shingles whose small hashes a worker keeps, about 0.3 KB each; those not met for longest make room for others. Their numbers have 22 bits.
KNOWN = 700_000
#: Shingles of short texts whose larger hashes a worker keeps, 1.2 KB each at most.
WHOLE = 20_000
#: Shingles hashed at once.
HASHED = 200
#: Characters gone through at once.
STEP = 1 << 19
#: A text's minima are looked for among hashes below 2 ** -bits of all, at first with the most bits that leave ``ENOUGH`` of them to each, or the fewest.
LEVELS, ENOUGH = (11, 10, 9, 8, 7, 6, 5, 4, 3), 16
#: Signatures go through so many times fewer characters at once, which stay in a core's cache; where a shingle has more hashes below the level's limit, so many times fewer.
LEVEL_STEP = 8
#: Bits of a code point.
POINT = 21


def _rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("t"))


def _pieces(t: str) -> set[str]:
    return {t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))}


def _parts(texts: dict[int, str], step: int) -> Iterator[list[tuple[int, str]]]:
    """Texts that have a whole piece, cut where they are long, about ``step`` positions at a time."""
    held, room = [], step
    for d, t in texts.items():
        for at in range(0, len(t) - SHINGLE + 1, step):
            part = t[at : at + step + SHINGLE - 1]
            if held and len(part) > room:
                yield held
                held, room = [], step
            held.append((d, part))
            room -= len(part)
    if held:
        yield held


def _windows(parts: list[tuple[int, str]]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, piece as UTF-32) of every position."""
    codes = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le"), np.uint32)
    n = np.array([len(p) - SHINGLE + 1 for _, p in parts])
    at = np.arange(n.sum()) + np.repeat((SHINGLE - 1) * np.arange(len(n)), n)  # none begins in one part and ends in the next
    raw = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, SHINGLE)[at])
    return np.repeat(np.array([d for d, _ in parts]), n), pa.Array.from_buffers(pa.binary(4 * SHINGLE), len(raw), [None, pa.py_buffer(raw)]).dictionary_encode()


def _keys(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces in the order of their places, as their first three and last two code points, and where each part begins.

    What begins in one part and ends in the next is replaced by the last piece of the one.
    """
    codes = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    two = codes[:-1] | codes[1:] << POINT
    head, tail = two[:-3] | codes[2:-2] << 2 * POINT, two[3:].copy()
    ends = np.cumsum([len(p) for _, p in parts])
    last = ends[:-1] - SHINGLE
    for k in range(1, SHINGLE):
        head[last + k], tail[last + k] = head[last], tail[last]
    return head, tail, np.concatenate(([0], ends[:-1]))


def shingles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, shingle): distinct 5-character pieces of the normal form; a shorter text is its own."""

    def run(batches):
        for b in batches:
            for at, t in enumerate(b.column(1).to_pylist()):
                own = list(_pieces(normal_form(t)))
                for lo in range(0, len(own), STEP):
                    part = own[lo : lo + STEP]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([at] * len(part), pa.int64())), pa.array(part, pa.string())], names=["id", "shingle"])

    return map_batches(_rows(rows, key, text), run, f"id {rows.schema[key].dataType.simpleString()}, shingle string", 200)


def shingle_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n): how many rows ``shingles`` has of a key, without making them."""

    def run(batches):
        for b in batches:
            texts = [normal_form(t) for t in b.column(1).to_pylist()]
            n = np.ones(len(texts), np.int64)
            for d, t in enumerate(texts):
                if len(t) > STEP:
                    n[d] = len(_pieces(t))
            for d, piece in map(_windows, _parts({d: t for d, t in enumerate(texts) if SHINGLE <= len(t) <= STEP}, STEP)):
                width = len(piece.dictionary)
                found = d * width + piece.indices.to_numpy()
                found.sort()
                found = found[np.concatenate(([True], found[1:] != found[:-1]))] // width
                n[d[0] : d[-1] + 1] = np.where(np.bincount(found - d[0]) > 0, np.bincount(found - d[0]), n[d[0] : d[-1] + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["id", "n"])

    counted = map_batches(_rows(rows, key, text), run, f"id {rows.schema[key].dataType.simpleString()}, n long", 200)
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def _hashed(pieces: list[str], which: Sequence[int]) -> np.ndarray:
    """The first 8 bytes of sha256('seed|i|shingle') by shingle and i."""
    before, sha = [f"{SEED}|{i}|".encode() for i in which], hashlib.sha256
    raw = b"".join([sha(p + s).digest() for s in map(str.encode, pieces) for p in before])
    return np.frombuffer(raw, ">u8").reshape(len(pieces), len(which), 4)[:, :, 0].astype(np.uint64)


@lru_cache(WHOLE)
def _hashes(shingle: str, which: tuple[int, ...]) -> np.ndarray:
    return _hashed([shingle], which)[0]


class _Known:
    """The small hashes of the shingles that a worker met, least first, so a text need not look at all of them.

    Shingles are found by a hash table of rows (head, tail with number + 1 above it), with the next free row taken
    where one is; all shingles of some texts are looked up by a few calls.
    """

    def __init__(self, hashes: int):
        self.hashes, self.n, self.end, self.time = hashes, 0, 0, 0
        self.table = np.zeros((1 << 10, 2), np.uint64)
        # these have room at their ends
        self.keys, self.start, self.used = np.zeros((1, 2), np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.below = [np.zeros(1, np.int16) for _ in LEVELS]
        self.i, self.h = np.zeros(1, np.int16), np.zeros(1, np.uint64)

    @property
    def ids(self) -> np.ndarray:
        return self.keys[: self.n]

    def find(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Numbers of the pieces; those not met before are hashed."""
        found, self.time = self._numbers(head, tail), self.time + 1
        if (found < 0).any():
            new = _distinct(head[found < 0], tail[found < 0])
            if self.n and self.n + len(new) > KNOWN:
                self.used[found[found >= 0]] = self.time
                self._make_room()
                found = self._numbers(head, tail)
                new = _distinct(head[found < 0], tail[found < 0])
            for at in range(0, len(new), HASHED):
                self._add(new[at : at + HASHED])
            found[found < 0] = self._numbers(head[found < 0], tail[found < 0])
        self.used[found] = self.time
        return found

    def _home(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        mixed = head * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _numbers(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, -1 for those not known."""
        row = self._home(head, tail)
        found, todo = self._look(row, head, tail)
        while len(todo):
            row = (row[todo] if len(row) > len(todo) else row) + 1 & len(self.table) - 1
            found[todo], more = self._look(row, head[todo], tail[todo])
            row, todo = row[more], todo[more]
        return found

    def _look(self, row: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers in those rows, and which rows hold another piece."""
        held = self.table.take(row, axis=0, mode="clip")
        found = (held[:, 1] >> 2 * POINT).astype(np.int64) - 1
        other = (held[:, 0] != head) | (held[:, 1] & (1 << 2 * POINT) - 1 != tail)
        return found, np.flatnonzero(other & (found >= 0))

    def _enter(self, numbers: np.ndarray) -> None:
        """Puts pieces into the table that are not there."""
        if 2 * self.n > len(self.table):
            self.table = np.zeros((1 << (2 * self.n).bit_length(), 2), np.uint64)
            numbers = np.arange(self.n)
        rows = self.keys[numbers]
        row = self._home(rows[:, 0], rows[:, 1])
        rows[:, 1] |= (numbers + 1).astype(np.uint64) << 2 * POINT
        while len(rows):
            free = self.table[row, 1] == 0
            self.table[row[free]] = rows[free]
            out = self.table[row, 1] != rows[:, 1]  # of those that took the same row one is in it
            rows, row = rows[out], row[out] + 1 & len(self.table) - 1

    def _add(self, pieces: np.ndarray) -> None:
        below, i, h = self._small(pieces)
        n, m = self.n, self.n + len(pieces)
        self.keys, self.start = _put(self.keys, n, pieces), _put(self.start, n, self.end + np.cumsum(below[-1]) - below[-1])
        self.used, self.below = _put(self.used, n, np.zeros(m - n, np.int64)), [_put(held, n, more) for held, more in zip(self.below, below, strict=True)]
        self.i, self.h = _put(self.i, self.end, i), _put(self.h, self.end, h)
        self.n, self.end = m, self.end + len(h)
        self._enter(np.arange(n, m))

    def _small(self, pieces: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """By level the hashes of each piece below its limit, and those of the last level, piece by piece, with their i."""
        point = (1 << POINT) - 1
        codes = np.stack([pieces[:, 0] & point, pieces[:, 0] >> POINT & point, pieces[:, 0] >> 2 * POINT, pieces[:, 1] & point, pieces[:, 1] >> POINT], axis=1)
        text = codes.astype("<u4").tobytes().decode("utf-32-le")
        h = _hashed([text[k : k + SHINGLE] for k in range(0, len(text), SHINGLE)], range(self.hashes))
        piece, i = np.nonzero(h < _limit(LEVELS[-1]))
        h = h[piece, i]
        order = np.lexsort((h, piece))
        below = [np.bincount(piece[h < _limit(bits)], minlength=len(pieces)).astype(np.int16) for bits in LEVELS]
        return below, i[order].astype(np.int16), h[order]

    def _make_room(self) -> None:
        """Keeps three quarters of the shingles, those met last."""
        kept = np.sort(np.argsort(-self.used[: self.n], kind="stable")[: KNOWN * 3 // 4])
        at, n = self._entries(kept, len(LEVELS) - 1)
        self.keys, self.used, self.below = self.keys[kept], self.used[kept], [held[kept] for held in self.below]
        self.i, self.h, self.start = self.i[at], self.h[at], np.cumsum(n) - n
        self.n, self.end = len(kept), len(at)
        self.table[:] = 0
        self._enter(np.arange(self.n))

    def _entries(self, found: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes of a level are, shingle by shingle, and how many each has."""
        n = self.below[level].take(found).astype(np.int64)
        to = np.cumsum(n)
        return np.arange(to[-1] if len(to) else 0) + np.repeat(self.start.take(found) - to + n, n), n

    def least(self, out: np.ndarray, texts: dict[int, str], level: int) -> None:
        """Lowers the rows ``out[d]`` to the hashes of that level of the texts' shingles."""
        for parts in _parts(texts, max(1, STEP // max(LEVEL_STEP, self.hashes >> LEVELS[level]))):
            head, tail, begins = _keys(parts)
            at, n = self._entries(self.find(head, tail), level)
            rows = np.repeat(self.hashes * np.array([d for d, _ in parts]), np.add.reduceat(n, begins))
            np.minimum.at(out.reshape(-1), rows + self.i.take(at), self.h.take(at))


def _distinct(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Rows (head, tail), each once."""
    rows = np.stack([head, tail], axis=1)[np.lexsort((head, tail))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))[: len(rows)]]


def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from ``at`` on, of twice the length where it is too short."""
    if at + len(more) > len(held):
        held = np.concatenate([held[:at], np.zeros((max(len(held), at + len(more)), *held.shape[1:]), held.dtype)])
    held[at : at + len(more)] = more
    return held


def _limit(bits: int) -> np.uint64:
    return np.uint64(1 << (64 - bits))


@lru_cache(4)
def _known(hashes: int) -> _Known:
    return _Known(hashes)


def _signatures(texts: list[str], hashes: int) -> np.ndarray:
    """By text and i, the least hash of a shingle.

    A minimum below a level's limit is right whatever the other hashes are; texts with one that is not go
    on to the next level, and at last all hashes are taken for those i that have none below the last limit.
    """
    out = np.full((len(texts), hashes), np.iinfo(np.uint64).max, np.uint64)
    todo = dict(enumerate(texts))
    for level, bits in enumerate(LEVELS):
        now = {d: t for d, t in todo.items() if len(t) > ENOUGH << bits or bits == LEVELS[-1]}
        _known(hashes).least(out, now, level)
        for d in now:
            if (out[d] < _limit(bits)).all():
                del todo[d]
    for d, t in todo.items():
        large = np.flatnonzero(out[d] >= _limit(LEVELS[-1]))
        which, least = tuple(large.tolist()), out[d, large]
        for piece in _pieces(t):
            np.minimum(least, _hashes(piece, which), out=least)
        out[d, large] = least
    return out


def sketches(rows: DataFrame, key: str, text: str, hashes: int = HASHES) -> DataFrame:
    """(id, sig): the values of ``signatures`` of a text as 8 bytes each, most significant first."""

    def run(batches):
        for b in batches:
            texts = [normal_form(t) for t in b.column(1).to_pylist()]
            at = {t: n for n, t in enumerate(dict.fromkeys(texts))}  # copies are gone through once
            sigs = [s.tobytes() for s in _signatures(list(at), hashes).astype(">u8")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sigs[at[t]] for t in texts], pa.binary())], names=["id", "sig"])

    return map_batches(_rows(rows, key, text), run, f"id {rows.schema[key].dataType.simpleString()}, sig binary", 400)


def signatures(rows: DataFrame, key: str, text: str, hashes: int = HASHES) -> DataFrame:
    """(id, i, h): the least of the first 16 hex digits of sha256('seed|i|shingle') over a text's shingles."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.lower(F.hex(F.substring("sig", i * 8 + 1, F.lit(8)))))
    return sketches(rows, key, text, hashes).select("id", F.posexplode(parts).alias("i", "h"))


def _differing(a: str, b: str, hashes: int) -> Column:
    return F.expr(f"size(filter(sequence(0, {hashes - 1}), i -> substring({a}, 8 * i + 1, 8) != substring({b}, 8 * i + 1, 8)))")


def _bounds(hashes: int, bands: int, most: int) -> list[tuple[int, int]]:
    """The pieces of a signature that are looked up whole.

    Where every pair that differs in ``most`` places has a band in common anyhow, it has one of ``most`` + 1
    longer pieces in common too; these find the same pairs, among fewer others.
    """
    if most < bands:
        return [(hashes * k // (most + 1), hashes * (k + 1) // (most + 1)) for k in range(most + 1)]
    return [(k * (hashes // bands), (k + 1) * (hashes // bands)) for k in range(bands)]


def _briefs(batches):
    """(node, sig, brief): four bits of each value of a signature, sixteen values a word."""
    for b in batches:
        low = (np.frombuffer(b"".join(b.column("sig").to_pylist()), ">u8").reshape(b.num_rows, -1) & 15).astype(np.uint64)
        low = np.pad(low, ((0, 0), (0, -low.shape[1] % 16))).reshape(b.num_rows, -1, 16)
        words = np.bitwise_or.reduce(low << (4 * np.arange(16, dtype=np.uint64)), axis=2).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sig"), pa.array(list(words), pa.list_(pa.int64()))], names=["node", "sig", "brief"])


def _maybe_near(a: str, b: str, hashes: int, most: int) -> Column:
    """Whether two briefs differ in ``most`` places at most; they never differ in more than their signatures do."""
    x = [f"({a}[{k}] ^ {b}[{k}])" for k in range(-(-hashes // 16))]
    differ = [f"bit_count(({w} | shiftrightunsigned({w}, 1) | shiftrightunsigned({w}, 2) | shiftrightunsigned({w}, 3)) & {0x1111111111111111}L)" for w in x]
    # a quarter tells most pairs apart
    return F.expr(f"{' + '.join(differ[: -(-len(x) // 4)])} <= {most} and {' + '.join(differ)} <= {most}")


def families(rows: DataFrame, key: str, text: str, hashes: int = HASHES, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, family): component of the smallest id. Texts of equal signature are one node, so copies make no pairs.

    The texts of a bucket are compared with its smallest one, and those found near are joined to components.
    In a bucket, texts of another component than its smallest one's are then compared with all texts that are not
    of their own. Pairs whose briefs already differ too much never meet as signatures.
    """
    most = int(hashes - threshold * hashes + 1e-9)
    kind = rows.schema[key].dataType.simpleString()
    packed = cut(sketches(rows, key, text, hashes), "minhash")
    nodes = packed.groupBy("sig").agg(F.min("id").alias("node")).select("node", "sig")
    nodes = cut(map_batches(nodes, _briefs, f"node {kind}, sig binary, brief array<long>"), "minhash-nodes")
    pieces = F.array(*(F.xxhash64(F.substring("sig", F.lit(8 * lo + 1), F.lit(8 * (hi - lo)))) for lo, hi in _bounds(hashes, bands, most)))
    banded = nodes.select("node", F.posexplode(pieces).alias("band", "bucket"))
    first = banded.groupBy("band", "bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = cut(banded.join(first, ["band", "bucket"]).where("node != first"), "minhash-met")
    of = lambda node, what: nodes.select(F.col("node").alias(node), F.col(what).alias(f"{what}_{node}"))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(of("u", "sig"), "u").join(of("v", "sig"), "v").where(_differing("sig_u", "sig_v", hashes) <= most).select("u", "v")

    # many buckets hold the same pair: it is compared once
    stars = met.select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    stars = stars.join(of("u", "brief"), "u").join(of("v", "brief"), "v").where(_maybe_near("brief_u", "brief_v", hashes, most)).select("u", "v")
    part = cut(connected_components(near(cut(stars, "minhash-stars"))), "minhash-parts")
    named = lambda node, name: part.select(F.col("node").alias(node), F.col("component").alias(name))
    # buckets of one component are done
    met = met.join(named("node", "part"), "node", "left").join(named("first", "main"), "first", "left")
    met = met.select("band", "bucket", "node", F.coalesce("part", "node").alias("part"), F.coalesce("main", "first").alias("main"))
    mixed = met.where("part != main").select("band", "bucket").distinct()
    met = cut(met.join(mixed, ["band", "bucket"]).join(nodes.select("node", "brief"), "node"), "minhash-mixed")
    u = met.where("part != main").select("band", "bucket", F.col("node").alias("u"), F.col("part").alias("part_u"), F.col("brief").alias("brief_u"))
    v = met.select("band", "bucket", F.col("node").alias("v"), F.col("part").alias("part_v"), F.col("brief").alias("brief_v"), "main")
    # of two that could both be u, the smaller one is
    meets = (F.col("part_u") != F.col("part_v")) & ((F.col("u") < F.col("v")) | (F.col("part_v") == F.col("main"))) & _maybe_near("brief_u", "brief_v", hashes, most)
    links = near(cut(u.join(v, ["band", "bucket"]).where(meets).select("u", "v").distinct(), "minhash-pairs"))
    ends = links.join(named("u", "part_u"), "u", "left").join(named("v", "part_v"), "v", "left")
    whole = connected_components(ends.select(F.coalesce("part_u", "u").alias("u"), F.coalesce("part_v", "v").alias("v"))).select(F.col("node").alias("part"), F.col("component").alias("family"))
    digest = F.unhex(F.sha2("sig", 256)).alias("digest")
    found = packed.select("id", digest).join(nodes.select("node", digest), "digest").select("id", "node")
    found = found.join(named("node", "part"), "node", "left").select("id", F.coalesce("part", "node").alias("part"))
    return found.join(whole, "part", "left").select("id", F.coalesce("family", "part").alias("family"))
