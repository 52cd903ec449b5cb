"""Exact top-k inner products over norm-sorted blocks, with Cauchy-Schwarz pruning.

Vectors are rotated onto the eigenvectors of their Gram matrix (the right singular vectors of
the table), so that most of a product sits in the first coordinates. Candidates are sorted by
descending length and cut into blocks, and blocks into ranges; queries, sorted the same way, into groups.
A group first meets the range of the longest candidates, which gives each query a lower bound for its k-th score; it
then meets the ranges, longest first, whose longest vector can still reach that bound. A meeting is one tile of work: its
blocks are read one after the other, longest first, and each raises the bounds for the next. Inside a block a partial
product over the leading coordinates plus the product of the residual lengths bounds each score
from above; only pairs whose bound reaches the query's are multiplied out, in exact integers.

Scale: a tile is one row of queries and one row for each block, so no pair of vectors is ever a row; the vectors in it
are as small integers as their values allow. A task holds a group of queries and one block. A range goes to a tile as often as
there are groups that it may matter to, a group to a tile as often as there are such ranges. Bounds carry a small slack for
rounding, so pruning loses nothing.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an
id. Shorter vectors count as padded with zeros. Rows with the query's own id are not its
candidates. Equal scores rank by smaller id; a repeated candidate row takes a rank each time, a
repeated query id is answered once, for the smallest of its vectors. A component beyond 2^62 after scaling, or a score beyond 64
bits, fails the run. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, named, vector_total

K = 20
CANDIDATE_BLOCK = 2048
QUERY_GROUP = 1024
#: Blocks that a group of queries meets in one tile.
RANGE = 8
#: Leading coordinates of the partial product.
LEAD = 24
_SLACK = 1e-9
_ANSWER = "query_id long, vec_id long, score long"


def quantised(vector: str = "embedding", scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as long; null unless all components are finite numbers."""
    x = named([vector])[0].cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.when(F.abs(scale * v) < float(1 << 62), F.floor(scale * v)).otherwise(F.raise_error(F.lit("vector component beyond 64 bits")).cast("long"))
    return F.when(~bad, F.transform(x, whole))


def rotation(gram: np.ndarray) -> np.ndarray:
    """Eigenvectors of a symmetric matrix as columns, largest value first."""
    values, vectors = np.linalg.eigh(gram)
    return vectors[:, np.argsort(-values, kind="stable")]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    def part(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0), width).astype(float)
        return (x.T @ x).ravel()

    return vector_total(rows.select("v"), width * width, part).reshape(width, width)


def _blocks(rows: DataFrame, size: int, width: int, kind: str) -> DataFrame:
    """(part, seq, longest, ids, vectors): blocks of rows in descending order of length."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        for b in _and_none(batches):
            if b is not None and b.num_rows:
                held.append(b)
            while held and (sum(x.num_rows for x in held) >= size or b is None):
                t = pa.Table.from_batches(held).combine_chunks()
                own, rest = t.slice(0, size), t.slice(size)
                held = rest.to_batches() if rest.num_rows else []
                x = _matrix(own.column("v").combine_chunks(), width)
                ids = own.column("vec_id").to_numpy()
                longest = float(own.column("len2").to_numpy().max()) ** 0.5
                cells = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([longest]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["part", "seq", "longest", "ids", "vectors"])
                seq += 1

    # rows of one length are dealt by a hash, so many of them are no more than their share of a task
    ordered = rows.repartitionByRange(F.col("len2").desc(), F.xxhash64("vec_id"), F.col("salt")).sortWithinPartitions(F.col("len2").desc(), "vec_id").select("vec_id", "v", "len2")
    return ordered.mapInArrow(run, "part int, seq int, longest double, ids binary, vectors binary")


def _and_none(items):
    yield from items
    yield None


def _numbered(blocks: DataFrame) -> DataFrame:
    """With ``block``, 1 for the longest."""
    at = blocks.select("part", "seq", F.row_number().over(Window.orderBy("part", "seq")).alias("block"))  # a row per block
    return blocks.join(at, ["part", "seq"])


class Group:
    """A group of queries on its way through blocks of candidates."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, turn: np.ndarray, k: int, lead: int):
        self.ids, self.q, self.turn, self.k, self.lead = ids, q, turn, k, lead
        self.rotated = q.astype(float) @ turn
        self.tail = np.sqrt((self.rotated[:, lead:] ** 2).sum(axis=1))
        self.size = np.sqrt((self.rotated**2).sum(axis=1))
        self.low = low.copy()  # scores below it are in no answer
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        turned = c.astype(float) @ self.turn
        size, tail = np.sqrt((turned**2).sum(axis=1)), np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))
        live = np.flatnonzero(self.size * size.max(initial=0) * (1 + _SLACK) + 1e-6 >= self.low)
        if not len(live):
            return
        bound = self.rotated[live, : self.lead] @ turned[:, : self.lead].T
        bound += np.outer(self.tail[live], tail) + (_SLACK * np.outer(self.size[live], size) + 1e-6)
        keep = bound >= self.low[live, None]
        rows, cols = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))
        if not len(rows):
            return
        keep, live = keep[np.ix_(rows, cols)], live[rows]
        keep &= self.ids[live, None] != ids[None, cols]
        at, to, score = self._products(live, c[cols], keep)
        self._merge(live[at], ids[cols[to]], score)

    def _products(self, live: np.ndarray, c: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, score) of the pairs to keep that may still be among the best."""
        q = self.q[live]
        most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
        if most >= 2**53:  # beyond what doubles hold exactly
            at, to = np.nonzero(keep)
            exact = [sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True)) for i, j in zip(at, to, strict=True)]
            if any(abs(x) >= 1 << 63 for x in exact):
                raise OverflowError("score beyond 64 bits")
            score = np.array(exact, np.int64)
            ok = score >= self.low[live[at]]
            return at[ok], to[ok], score[ok]
        s = q.astype(float) @ c.astype(float).T  # whole numbers below 2^53, so exact in any order
        s[~keep] = -np.inf
        least = self.low[live]
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k])
        at, to = np.nonzero((s >= least[:, None]) & keep)
        return at, to, s[at, to].astype(np.int64)

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = np.concatenate((self.rows, rows)), np.concatenate((self.found, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first
        last = rank == self.k - 1
        self.low[rows[last]] = np.maximum(self.low[rows[last]], scores[last])
        best = rank < self.k
        self.rows, self.found, self.scores = rows[best], ids[best], scores[best]

    def answer(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.rows]), pa.array(self.found), pa.array(self.scores)], names=["query_id", "vec_id", "score"])


def _tiles(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, tiles: int, width: int, kind: str, turn: np.ndarray, k: int) -> DataFrame:
    """Each query's best of each tile: ``pairs(grp, rng)``; queries(grp, ids, vectors, lows), blocks(block, rng, ids, vectors)."""
    nothing = F.lit(None).cast("binary")
    left = pairs.join(queries, "grp").select("grp", "rng", F.lit(0).alias("block"), "ids", "vectors", "lows")
    right = pairs.join(blocks, "rng").select("grp", "rng", "block", "ids", "vectors", nothing.alias("lows"))
    lead = min(LEAD, width)

    def run(batches: Iterator[pa.RecordBatch]):
        group = None
        for b in batches:
            for block, ids, vectors, lows in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(vectors, kind).reshape(-1, width).astype(np.int64)
                own = np.frombuffer(ids, "<i8")
                if block == 0:  # a tile's queries come first
                    if group is not None:
                        yield group.answer()
                    group = Group(own, x, np.frombuffer(lows, "<f8"), turn, k, lead)
                else:
                    group.meet(own, x)
        if group is not None:
            yield group.answer()

    # work goes with tiles, not with bytes, so their number is the number of tasks
    rows = left.unionByName(right).repartition(max(1, min(4096, tiles)), "grp", "rng").sortWithinPartitions("grp", "rng", "block")
    return rows.select("block", "ids", "vectors", "lows").mapInArrow(run, _ANSWER)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query``, against all rows."""
    rows = vectors.select(named([vec_id])[0].cast("long").alias("vec_id"), quantised(vector, scale).alias("v"), is_query.alias("q")).where("vec_id is not null and v is not null")
    rows = rows.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    rows = cut(rows, "topk-rows")
    seen = rows.agg(F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m")).first()
    width = seen["w"] or 1
    kind = next(t for t, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)) if (seen["m"] or 0) < 1 << bits)
    turn = rotation(_gram(rows, width))
    blocks = cut(_numbered(cut(_blocks(rows, CANDIDATE_BLOCK, width, kind), "topk-blocks")).withColumn("rng", F.floor((F.col("block") - 1) / RANGE).cast("int")), "topk-candidates")
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).withColumn("salt", F.lit(0))
    groups = cut(_numbered(cut(_blocks(cut(asked, "topk-asked"), QUERY_GROUP, width, kind), "topk-queries")).select(F.col("block").alias("grp"), "ids", "vectors"), "topk-groups")

    def no_bounds(frames):
        for f in frames:
            yield f.assign(lows=[np.full(len(x) // 8, -np.inf).tobytes() for x in f.ids])

    fields = "grp int, ids binary, vectors binary, lows binary"
    first_pairs = groups.select("grp", F.lit(0).alias("rng"))
    n_groups = groups.count()
    first = cut(_tiles(groups.mapInPandas(no_bounds, fields), blocks, first_pairs, n_groups, width, kind, turn, k), "topk-first")

    # a query's bound is its k-th score so far; rows of one group, QUERY_GROUP at most, go back into its row
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("low"))

    def members(frames):
        import pandas as pd

        for f in frames:
            for grp, ids in zip(f.grp, f.ids, strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"grp": grp, "nth": np.arange(len(own)), "vec_id": own})

    listed = groups.select("grp", "ids").mapInPandas(members, "grp int, nth int, vec_id long").join(kth, "vec_id", "left").join(cut(asked.select("vec_id", "len2"), "topk-lengths"), "vec_id")
    reach = F.min(F.when((F.col("len2") > 0) & F.col("low").isNotNull(), F.col("low") / F.sqrt("len2")).otherwise(F.lit(float("-inf"))))
    bounds = listed.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("low")))), lambda x: x["low"]).alias("low"), reach.alias("reach"))

    def with_bounds(frames):
        for f in frames:
            yield f.assign(lows=[np.asarray(x, "<f8").tobytes() for x in f.low]).drop(columns="low")

    # how far down the ranges a group must go: blocks are in descending order, so those shorter than a mark come after its
    # share of the list; 64 marks at any number of blocks
    steps = blocks.agg(F.max("rng").alias("r"), F.count("*").alias("b"), F.percentile_approx("longest", [i / 64 for i in range(65)], 100000).alias("p")).first()
    n_ranges, n_blocks, marks = (steps["r"] or 0) + 1, steps["b"], sorted(steps["p"] or [], reverse=True)
    ends = [F.lit(n_ranges), F.lit(n_ranges)]
    for i, m in enumerate(marks):
        ends.append(F.when(F.col("reach") > m * (1 + _SLACK) + 1e-6, F.lit(min(n_ranges, ((i + 1) * n_blocks // 64 + 1) // RANGE + 1))))
    queries = cut(groups.join(bounds, "grp").mapInPandas(with_bounds, fields + ", reach double"), "topk-bounds").withColumn("ranges", F.least(*ends))
    pairs = queries.where("ranges > 1").select("grp", F.explode(F.sequence(F.lit(1), F.col("ranges") - 1)).alias("rng"))
    # a range that no group needs is not read; without any the tiles are none
    others = _tiles(queries.select("grp", "ids", "vectors", "lows"), blocks, cut(pairs, "topk-tiles"), n_groups * max(1, n_ranges - 1), width, kind, turn, k)
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
