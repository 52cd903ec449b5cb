"""SimHash near-duplicate classes by the generalised pigeonhole principle.

A 64-bit fingerprint per text; fingerprints that differ in at most ``radius`` bits are linked, and
a class is a connected component. Candidates come from a partition of the 64 bits into groups:
correlated bits share a group, and each group i gets a threshold t_i in {-1, 0, .., radius} with
sum(t_i) = radius - groups + 1. Any linked pair is within t_i bits in some group i, so probing the
ball of radius t_i around each value of group i finds every link. The split into groups and the
thresholds are chosen by dynamic programming on candidate counts estimated from all fingerprints.

Scale: every exchange carries fingerprints (8 bytes), never texts. A bucket of more than
``pair_limit`` fingerprints is not compared pair by pair: each of its members is joined to the
points one bit away from it, and two members meet in such a point exactly if they differ in at
most two bits. So the work for a bucket is linear in its size, nothing is capped, and buckets
holding more than a thousandth of all rows (a thousand of each group at most, hence a bounded
list) never meet in one task.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any
other. Rows repeat as often as they come. A null doc_id gets a class but never names one, unless
the whole class has none: then its class id is null. Extra columns may have any names: ``near_duplicates``
ignores them, ``keep_one`` returns them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.graph import connected_components
from corpusmill.session import cut, free_name, named, vector_total

SEED = 42
RADIUS = 2
SHINGLE = 3
PAIR_LIMIT = 64
HEAVY_SHARE = 1000
#: Work of moving one probe row, in units of comparing one candidate pair.
PROBE_COST = 8.0
_STEP = 1 << 16


def fingerprint_bytes(data: bytes, words_per_shingle: int = SHINGLE) -> int:
    """Fingerprint of UTF-8 bytes, unsigned."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    lo, hi = starts[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(lo), _STEP):
        pieces = [line[a:b] for a, b in zip(lo[at : at + _STEP].tolist(), hi[at : at + _STEP].tolist(), strict=True)]
        raw = b"".join(map(xxhash.xxh64_digest, pieces, repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(lo)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(lambda t: _signed(fingerprint_bytes(t.encode("utf-8", "surrogatepass"))) if t else 0).astype("int64")

    return docs.withColumn(name, fp(F.col(text)))


# --- statistics over all fingerprints ------------------------------------------------------


def _cells(df: DataFrame, width: int, count) -> np.ndarray:
    """Sums of ``count(array of uint64) -> float array of that width`` over all rows, pre-summed by task."""

    return vector_total(df.select("fp"), width, lambda b: count(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))


def _bits(x: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1; column b is bit b, counted from the least."""
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_occurrence(x: np.ndarray) -> np.ndarray:
    total = np.zeros((64, 64))
    for at in range(0, len(x), _STEP):
        b = _bits(x[at : at + _STEP]).astype(np.float32)
        total += b.T @ b
    return total.ravel()


def group_bits(co: np.ndarray, n: float, groups: int) -> list[list[int]]:
    """Split the 64 bits into groups of near-equal size, correlated bits together."""
    p = np.diag(co) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(co / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for g in range(groups):
        size = 64 // groups + (g < 64 % groups)
        first = max(free, key=lambda b: (corr[b, free].max(), -b))
        own = [first]
        free.remove(first)
        while len(own) < size:
            nxt = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nxt)
            free.remove(nxt)
        out.append(own)
    return out


def _chunks(bits: list[int]) -> list[list[int]]:
    return [bits[i : i + 8] for i in range(0, len(bits), 8)]


def _distances(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """Share of ordered pairs at distance 0..most within one chunk, from its exact histogram."""
    n = hist.sum()
    x = np.arange(1 << width)
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    both = np.outer(hist, hist)
    return np.array([both[d == k].sum() for k in range(most + 1)]) / max(n * n, 1)


def choose_plan(stats: dict[int, tuple[list[list[int]], list[list[np.ndarray]]]], n: float, radius: int) -> tuple[list[tuple[list[int], int]], float]:
    """The cheapest ``[(bits, threshold)]`` and its estimated work.

    ``stats``: for each number of groups the groups, and for each group the histograms of its
    8-bit chunks. Chunks count as independent of one another: correlated bits share one. Without rows the
    plan is that of a single one, which costs probes alone.
    """
    n = max(n, 1.0)
    best, least = [], math.inf
    for m, (groups, hists) in stats.items():
        cost = []
        for bits, chunks in zip(groups, hists, strict=True):
            near = np.zeros(radius + 1)
            near[0] = 1
            for c, h in zip(_chunks(bits), chunks, strict=True):
                near = np.convolve(near, _distances(h, len(c), radius))[: radius + 1]
            row = {-1: 0.0}
            for t in range(radius + 1):
                ball = sum(math.comb(len(bits), k) for k in range(t + 1))
                row[t] = n * n / 2 * near[: t + 1].sum() + PROBE_COST * n * ball
            cost.append(row)
        # least cost of the first groups for each sum of (threshold + 1); the total must be radius + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t, x in row.items():
                    if s + t + 1 <= radius + 1 and (s + t + 1 not in nxt or c + x < nxt[s + t + 1][0]):
                        nxt[s + t + 1] = (c + x, [*ts, t])
            table = nxt
        if radius + 1 in table and table[radius + 1][0] < least:
            least, ts = table[radius + 1]
            best = [(b, t) for b, t in zip(groups, ts, strict=True) if t >= 0]
    return best, least


def plan_groups(fps: DataFrame, radius: int = RADIUS, group_counts: tuple[int, ...] = (1, 2, 3, 4, 6)) -> list[tuple[list[int], int]]:
    """Bit groups and thresholds for a table of distinct fingerprints ``fp``, from counts over all of it."""
    n = float(fps.count())
    co = _cells(fps, 4096, _co_occurrence).reshape(64, 64)
    splits = {m: group_bits(co, n, m) for m in group_counts}
    flat = [c for m in group_counts for g in splits[m] for c in _chunks(g)]

    def histograms(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flat), 256))
        for at in range(0, len(x), _STEP):
            bits = _bits(x[at : at + _STEP])
            for i, c in enumerate(flat):
                out[i] += np.bincount(bits[:, c].astype(np.int64) @ (1 << np.arange(len(c))), minlength=256)
        return out.ravel()

    hist = iter(_cells(fps, len(flat) * 256, histograms).reshape(len(flat), 256))
    stats = {m: (splits[m], [[next(hist)[: 1 << len(c)] for c in _chunks(g)] for g in splits[m]]) for m in group_counts}
    return choose_plan(stats, n, radius)[0]


# --- links ----------------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _probe_rows(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(grp, key, fp, own): own rows are indexed under their exact value; all rows probe."""
    fp = F.col("fp")
    keys = []
    for i, (bits, t) in enumerate(plan):
        base = fp.bitwiseAND(F.lit(_mask(bits)))
        for k in range(t + 1):
            for flip in combinations(bits, k):
                keys.append(F.struct(F.lit(i).alias("grp"), base.bitwiseXOR(F.lit(_mask(list(flip)))).alias("key"), F.lit(k == 0).alias("own")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.grp", "k.key", "fp", "k.own")


def _stars(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the points at most one bit away."""
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    return np.repeat(fp, len(flips)), (fp[:, None] ^ flips[None, :]).ravel()


def _bucket_links(radius: int, limit: int):
    """Reads rows sorted by bucket; holds ``limit`` rows of an unfinished bucket and one batch at most."""
    if radius > 2:
        raise ValueError("buckets above the pair limit need a radius of at most 2")

    def emit(u, v, star):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), star))], names=["u", "v", "star"])

    def run(batches: Iterator[pa.RecordBatch]):
        grp, key, fp, own = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        large = None  # a bucket already found to be above the limit

        def finished(g, k, f, o):
            """Links of whole buckets."""
            if not len(f):
                return
            new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]))))
            size = np.diff(np.append(new, len(f)))
            run_of = np.repeat(np.arange(len(new)), size)
            wide = size[run_of] > limit
            for at in np.array_split(np.flatnonzero(wide), max(1, int(wide.sum()) // 20000 + 1)):
                if len(at):
                    yield emit(*_stars(f[at]), True)
            f, o, run_of = f[~wide], o[~wide], run_of[~wide]
            i = np.arange(len(f))
            for d in range(1, limit):
                i = i[i + d < len(f)]
                i = i[run_of[i] == run_of[i + d]]
                if not len(i):
                    break
                a, b = f[i], f[i + d]
                hit = (o[i] | o[i + d]) & (a != b) & (np.bitwise_count(a ^ b) <= radius)
                if hit.any():
                    yield emit(a[hit], b[hit], False)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            grp, key = np.concatenate((grp, cols[0])), np.concatenate((key, cols[1]))
            fp, own = np.concatenate((fp, cols[2].view(np.uint64))), np.concatenate((own, cols[3].astype(bool)))
            if large is not None:
                same = (grp == large[0]) & (key == large[1])
                if same.any():
                    yield emit(*_stars(fp[same]), True)
                    grp, key, fp, own = grp[~same], key[~same], fp[~same], own[~same]
                if not len(fp):
                    continue
                large = None
            last = (grp == grp[-1]) & (key == key[-1])
            yield from finished(grp[~last], key[~last], fp[~last], own[~last])
            grp, key, fp, own = grp[last], key[last], fp[last], own[last]
            if len(fp) > limit:
                large = (grp[0], key[0])
                yield emit(*_stars(fp), True)
                grp, key, fp, own = grp[:0], key[:0], fp[:0], own[:0]
        yield from finished(grp, key, fp, own)

    return run


def links(fps: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """``(u, v)`` whose components are those of the link graph over distinct fingerprints ``fp``.

    In large buckets the ends can be points between two fingerprints rather than fingerprints.
    """
    plan = plan or plan_groups(fps, radius)
    rows = _probe_rows(fps, plan)
    sizes = rows.groupBy("grp", "key").agg(F.count("*").alias("n"))
    total = fps.count()
    heavy_from = max(pair_limit, total // HEAVY_SHARE)
    heavy = [(r["grp"], r["key"]) for r in sizes.where(F.col("n") > heavy_from).collect()]
    if heavy:
        spark = fps.sparkSession
        keys = F.broadcast(spark.createDataFrame(heavy, "grp int, key long"))
        light, hot = rows.join(keys, ["grp", "key"], "left_anti"), rows.join(keys, ["grp", "key"], "left_semi").select("fp").distinct()
    else:
        light, hot = rows, None
    found = light.repartition("grp", "key").sortWithinPartitions("grp", "key").select("grp", "key", "fp", "own").mapInArrow(_bucket_links(radius, pair_limit), "u long, v long, star boolean")
    found = cut(found, "simhash-links")
    pairs = found.where("not star").select("u", "v")
    stars = found.where("star").select("u", "v")
    if hot is not None:

        def spread(batches):
            for b in batches:
                fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fp), 10000):
                    u, v = _stars(fp[at : at + 10000])
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        stars = stars.unionByName(hot.mapInArrow(spread, "u long, v long"))
    # a point that only one fingerprint touches joins nothing
    met = stars.groupBy("v").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a <> b")
    return pairs.unionByName(stars.join(met.select("v"), "v").where("u <> v").select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)``, one row per input row.

    ``root`` names the class by a fingerprint-sized number, ``component_id`` by its smallest doc_id.
    """
    rows = cut(with_fingerprint(docs.select(named([doc_id])[0].alias("doc_id"), F.xxhash64(named([text])[0]).alias("text_hash"), named([text])[0].alias("text"))).drop("text"), "simhash-rows")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(fps.select("fp"), radius))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = cut(rooted.select("fp", "root").join(least, "root"), "simhash-names")
    return rows.join(names, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each class, the one with the smallest doc_id.

    Among rows with that doc_id the one with the smallest text hash stays; rows without a doc_id
    stay only if their class has no other.
    """
    found = near_duplicates(docs, doc_id, text, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("k"))
    # the key as one number, which two rows share only if they are equal or their 64-bit digests are
    key = lambda i, h: F.xxhash64(F.lit(SEED), F.coalesce(i.cast("string"), F.lit("null")), i.isNull(), h)
    own, other = free_name(docs, "_kept"), free_name(docs, "_rest")
    first = first.select(key(F.col("k.doc_id"), F.col("k.text_hash")).alias(own))
    i, t = named([doc_id, text])
    rows = docs.withColumn(own, key(i, F.xxhash64(t))).join(first, own, "left_semi")
    # equal keys meet in the join already, so this moves no text; rows that differ in other columns go by those
    one = Window.partitionBy(own).orderBy(other)
    return rows.withColumn(other, F.xxhash64(*named(docs.columns))).withColumn(other, F.row_number().over(one)).where(F.col(f"`{other}`") == 1).select(*named(docs.columns))
