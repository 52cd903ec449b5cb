"""Token counts of documents from flat token files that have no index.

A token file is a run of little-endian unsigned 32-bit ids in which a separator id ends each
document; here it is a table of blocks ``(file, block, ids)`` of ``BLOCK_IDS`` ids each, cut without
regard to documents. ``scan`` searches each block for separators in one vector operation, on its
own; a prefix scan over one summary row per block then says how many documents of the file ended
before a block and where the last of them did, which stitches documents that span blocks.

The order of documents in a file is the only link to their ids, as in any such file; the writer
returns the ids in that order as ``(file, ordinal, doc_id)``.

Null and empty texts are documents of no tokens. Ids after a file's last separator are one more
document without end (``ended`` false). The separator's name inside a text is ordinary text, so no
text can hold the separator. Repeated rows and null doc_ids count as they come; extra columns are
ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, map_batches

BLOCK_IDS = 1 << 16
VOCABULARY = "byte_bpe_50k"
SEPARATOR = 50256


@cache
def _encoder(vocabulary: str):
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(f"{vocabulary}.tiktoken"), "rb"))}
    fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cache
    def exact() -> Tokenizer:
        t = Tokenizer.from_file(public.path(f"{vocabulary}.json"))
        t.encode_special_tokens = True
        return t

    def encode(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except ValueError:  # its regular expressions give up on some very long runs
            return exact().encode(text, add_special_tokens=False).ids

    return encode


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: int = SEPARATOR, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """``(file, block, ids)`` and ``(file, ordinal, doc_id)``; a file per task."""
    kind = docs.schema[doc_id].dataType
    schema = f"file int, block long, ids binary, ordinal long, doc_id {kind.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encode, file = _encoder(vocabulary), TaskContext.get().partitionId()
        held, n, block, ordinal = [], 0, 0, 0
        names = ["file", "block", "ids", "ordinal", "doc_id"]

        def blocks(whole_only: bool):
            nonlocal held, n, block
            flat = np.concatenate(held) if held else np.zeros(0, "<u4")
            stop = n // block_ids * block_ids if whole_only else n
            for at in range(0, stop, block_ids):
                part = pa.array([flat[at : min(at + block_ids, stop)].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), part, pa.nulls(1, pa.int64()), pa.nulls(1, owner)], names=names)
                block += 1
            held = [flat[stop:]]
            n -= stop

        owner = pa.null()
        for b in batches:
            owner = b.column(0).type
            for t in b.column(1):
                held.append(np.array([*encode(t.as_py() or ""), separator], "<u4"))
                n += len(held[-1])
                if n >= 4 * block_ids:
                    yield from blocks(True)
            k = b.num_rows
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, file, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(ordinal, ordinal + k)), b.column(0)], names=names)
                ordinal += k
        if n:
            yield from blocks(False)

    both = cut(map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema, 256), "token-files")
    return both.where("ids is not null").select("file", "block", "ids"), both.where("ordinal is not null").select("file", "ordinal", "doc_id")


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """``(file, ordinal, start, n_tokens, ended)`` of every document of ``blocks(file, block, ids)``.

    ``start``: ids of the file before the document; ``n_tokens`` leaves out its separator.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for file, block, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(raw, "<u4")
                at = np.flatnonzero(ids == separator)
                # a row per separator, and one for the block (nth -1): its size and its last separator
                nth = np.arange(-1, len(at))
                cols = [np.full(len(nth), file, np.int32), np.full(len(nth), block, np.int64), nth, np.concatenate(([len(ids)], at)), np.concatenate(([at[-1] if len(at) else -1], [-1], at[:-1])) if len(at) else np.array([-1])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols[:2]] + [pa.array(c.astype(np.int64)) for c in cols[2:]], names=["file", "block", "nth", "at", "before"])

    found = cut(map_batches(blocks.select("file", "block", "ids"), run, "file int, block long, nth long, at long, before long", 64), "token-separators")
    counts = found.groupBy("file", "block").agg(F.max("nth").alias("last_nth"), F.max(F.when(F.col("nth") == -1, F.col("at"))).alias("size"), F.max(F.when(F.col("nth") == -1, F.col("before"))).alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    sums = sums.withColumn("done", F.coalesce(F.sum(F.col("last_nth") + 1).over(earlier), F.lit(0)))
    sums = sums.withColumn("open_from", F.coalesce(F.max(F.when(F.col("last") >= 0, F.col("base") + F.col("last") + 1)).over(earlier), F.lit(0)))
    sums = cut(sums.select("file", "block", "size", "last_nth", "last", "base", "done", "open_from"), "token-blocks")
    docs = found.where("nth >= 0").join(sums.select("file", "block", "base", "done", "open_from"), ["file", "block"])
    start = F.when(F.col("nth") == 0, F.col("open_from")).otherwise(F.col("base") + F.col("before") + 1)
    ended = docs.select("file", (F.col("done") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("at") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    files = sums.groupBy("file").agg(F.sum("size").alias("n"), F.sum(F.col("last_nth") + 1).alias("ordinal"), F.max(F.when(F.col("last") >= 0, F.col("base") + F.col("last") + 1).otherwise(0)).alias("start"))
    rest = files.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(doc_id, n_tokens, file, ordinal, start)`` per row, counted from the files written for ``docs``."""
    blocks, names = write_token_files(docs, doc_id, text, **how)
    counts = scan(blocks, how.get("separator", SEPARATOR))
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
