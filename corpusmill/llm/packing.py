"""Packing token sequences of at most ``capacity`` tokens by linear grouping and best fit.

All the packing is decided on the histogram of lengths, 1..capacity, so its work and the plan's
size do not depend on the number of documents:

1. large lengths are sorted and cut into groups of equal cardinality; within a group lengths
   count as its largest, so there are few sizes;
2. configurations of those sizes are optimised by column generation (a linear program whose
   pricing step is a knapsack), and rounded down to whole numbers of sequences;
3. the actual pieces take the places of their groups, which leaves each sequence some room;
4. small pieces, and the few large ones that rounding down left over, go in by best fit,
   longest first.

The plan says for each length which ranks go to which sequence and offset. Pieces get their rank
among the pieces of their length from counts by (length, hash bucket) and row numbers inside such
a bucket. A length has a bucket for each ``SHARE`` pieces or so, so one that a third of all pieces have is numbered by
many tasks.

A null text is an empty one, and has the end token alone. Repeated rows are packed as often as they come.
An empty table gives an empty result. Ids are those of ``tokenizers`` for a
byte-level BPE of public vocabulary, a special token's name in a text included. The merging is done by ``tiktoken`` on the
same ranks, three times as fast: tests compare the two on every code point, on random texts, on special tokens and on long
runs, and ``tokenizers`` itself does the texts on which the other gives up. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, free_name, map_batches

CAPACITY = 1024
END = 2
#: Lengths above this share of the capacity are large.
LARGE = 1 / 8
GROUPS = 128
#: Pieces of one length in a bucket, about: with their ids some megabytes.
SHARE = 1 << 10
SPECIAL = "<|endoftext|>"


@cache
def encoder(vocabulary: str):
    """text -> ids as uint32, for ``<name>.json`` beside ``<name>.tiktoken``."""
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    @cache
    def exact() -> Tokenizer:  # large, and rarely needed
        return Tokenizer.from_file(public.path(f"{vocabulary}.json"))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(f"{vocabulary}.tiktoken"), "rb"))}
    fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except ValueError:  # its regular expressions give up on some very long runs
            return np.asarray(exact().encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]). Only documents above ``capacity`` are cut;
    then the first piece is the one that may be shorter."""
    kind = docs.schema[doc_id].dataType
    schema = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                owner, rows = [], []
                for i, t in enumerate(b.column(1).slice(lo, 256).to_pylist()):
                    ids = np.append(encode(t or ""), np.uint32(end)).astype("<u4")
                    at, n = 0, (len(ids) - 1) % capacity + 1
                    k = 0
                    while at < len(ids):
                        own = ids[at : at + n]
                        owner.append(lo + i)
                        rows.append((k, at, n, zlib.crc32(own.tobytes()), own if keep_ids else None))
                        at, n, k = at + n, capacity, k + 1
                if rows:
                    k, at, n, crc, own = zip(*rows, strict=True)
                    cols = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if keep_ids:
                        cols, names = [*cols, pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind.simpleString()}, {schema}", 256)


# --- the plan -------------------------------------------------------------------------------


def _best_column(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value (unbounded knapsack); all sizes are over capacity / 8 or so."""
    layers, picks = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes.min())):
        below = layers[-1]
        new, pick = below.copy(), np.full(capacity + 1, -1)
        for g in np.flatnonzero(value > 1e-12):
            s = sizes[g]
            with_g = below[: capacity + 1 - s] + value[g]
            better = with_g > new[s:] + 1e-12
            new[s:][better] = with_g[better]
            pick[s:][better] = g
        layers.append(new)
        picks.append(pick)
    col, c = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            col[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(layers[-1][capacity]), col


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[float, np.ndarray]]:
    """Basic solution of the configuration program: (how many sequences, sizes in each).

    ``rounds`` bounds the work on the driver: after so many exchanges the solution is a valid one, if not the best.
    Element-wise numpy only: threaded linear algebra in the driver's process can stall beside a JVM.
    Rounding errors do no harm, as the caller never takes more pieces than there are.
    """
    m = len(sizes)
    cols = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(cols))
    x = demand / np.diag(cols)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        worth, col = _best_column(dual, sizes, capacity)
        if worth <= 1 + 1e-6:
            break
        d = (inverse * col).sum(axis=1)
        up = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        out = int(np.argmin(ratio))
        x = x - ratio[out] * d
        x[out] = ratio[out]
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        cols[:, out] = col
    return [(max(0.0, float(v)), cols[:, i]) for i, v in enumerate(x)]


class _Queue:
    """Ranks of each length, longest first, taken from the front."""

    def __init__(self, parts: list[tuple[int, int, int]]):
        self.parts = [list(p) for p in parts]

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            p = self.parts[0]
            k = min(n, p[2] - p[1])
            out.append((p[0], p[1], p[1] + k))
            p[1] += k
            n -= k
            if p[1] == p[2]:
                self.parts.pop(0)
        return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs ``(length, first rank, end rank, first sequence, pieces of the run in a sequence, offset)``
    and the number of sequences. With ``groups`` or fewer distinct large lengths each is a group of its own, so none
    counts as a larger one; beyond that groups are of equal cardinality."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    spaces: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    if histogram.get(capacity):
        runs.append((capacity, 0, histogram[capacity], 0, 1, 0))
        bins = histogram[capacity]
    large = sorted((n for n in histogram if capacity * LARGE < n < capacity and histogram[n]), reverse=True)
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, c in histogram.items():
        if c and n <= capacity * LARGE:
            rest[n].append((0, c))
    if large:
        total = sum(histogram[n] for n in large)
        if len(large) <= groups:
            queues = [_Queue([(n, 0, histogram[n])]) for n in large]
            demand = np.array([histogram[n] for n in large], float)
        else:
            every = _Queue([(n, 0, histogram[n]) for n in large])
            share = [total * (g + 1) // groups - total * g // groups for g in range(groups)]
            queues = [_Queue(every.take(k)) for k in share if k]
            demand = np.array([k for k in share if k], float)
        sizes = np.array([q.parts[0][0] for q in queues])
        left = demand.astype(int)
        for many, col in configurations(sizes, demand, capacity):
            many = int(many + 1e-6)
            places = [g for g in np.flatnonzero(col) for _ in range(int(col[g]))]
            while many and any(left[g] < many * int(col[g]) for g in set(places)):
                many -= 1
            if not many or not places:
                continue
            taken = []
            for g in places:
                taken.append(queues[g].take(many))
                left[g] -= many
            cuts = sorted({0, many, *(int(x) for t in taken for x in np.cumsum([b - a for _, a, b in t]))})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                at = 0
                for t in taken:
                    before = 0
                    for n, a, b in t:
                        if before <= lo < before + b - a:
                            runs.append((n, a + lo - before, a + hi - before, bins + lo, 1, at))
                            at += n
                            break
                        before += b - a
                if at < capacity:
                    spaces[capacity - at].append((bins + lo, hi - lo))
            bins += many
        for q in queues:
            for n, a, b in q.parts:
                rest[n].append((a, b))
    for n in sorted(rest, reverse=True):
        for a, b in rest[n]:
            while a < b:
                room = min((r for r in spaces if r >= n), default=None)
                if room is None:
                    fresh = -(-(b - a) // (capacity // n))
                    spaces[capacity].append((bins, fresh))
                    bins, room = bins + fresh, capacity
                first, many = spaces[room].pop()
                if not spaces[room]:
                    del spaces[room]
                each, at = room // n, capacity - room
                full = min(many, (b - a) // each)
                if full:
                    runs.append((n, a, a + full * each, first, each, at))
                    a += full * each
                    if room - each * n:
                        spaces[room - each * n].append((first, full))
                if full < many and a < b and b - a < each:
                    runs.append((n, a, b, first + full, b - a, at))
                    if room - (b - a) * n:
                        spaces[room - (b - a) * n].append((first + full, 1))
                    a, full = b, full + 1
                if full < many:
                    spaces[room].append((first + full, many - full))
    return runs, bins


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, share: int = SHARE) -> DataFrame:
    """Adds sequence_id, offset and copy to pieces (any columns, with doc_id, piece, start, length, ids_crc32); ``copy``, from 1,
    tells equal pieces apart, and those of one copy of a document go together under its number.

    ``found`` is read more than once and should be a table (see ``cut``).
    """
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(histogram, capacity, groups)
    table = {}
    for n in histogram:
        own = sorted(r[1:] for r in runs if r[0] == n)
        table[n] = np.array(own, np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, k = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for one in np.unique(n):
            at = np.flatnonzero(n == one)
            own = table[int(one)]
            r = own[np.searchsorted(own[:, 0], k[at], side="right") - 1]
            nth = k[at] - r[:, 0]
            seq[at], off[at] = r[:, 2] + nth // r[:, 3], r[:, 4] + nth % r[:, 3] * one
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    names, bucket, before, nth, at = found.columns, *(free_name(found, x) for x in ("_bucket", "_before", "_nth", "_place"))
    buckets = {n: -(-c // share) for n, c in histogram.items() if c > share}  # of the lengths that need more than one
    many = F.coalesce(*(F.when(F.col("length") == n, k) for n, k in buckets.items()), F.lit(1)) if buckets else F.lit(1)
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    rows = found.withColumn(bucket, F.pmod(F.xxhash64(*keys), many))
    counts = rows.groupBy("length", bucket).agg(F.count("*").alias("n"))
    counts = cut(counts.select("length", bucket, (F.sum("n").over(Window.partitionBy("length").orderBy(bucket)) - F.col("n")).alias(before)), "pack-counts")
    inside = Window.partitionBy("length", bucket)
    rows = rows.withColumns({nth: F.row_number().over(inside.orderBy(*keys)), "copy": F.row_number().over(Window.partitionBy("length", bucket, *keys).orderBy(F.lit(0)))})
    rows = rows.join(counts, ["length", bucket])
    rows = rows.withColumn(at, place(F.col("length"), F.col(before) + F.col(nth) - 1))
    return rows.select(*names, F.col(at)["sequence_id"].alias("sequence_id"), F.col(at)["offset"].alias("offset"), "copy")


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    return pack(cut(pieces(docs, **how), "pack-pieces"))
