"""Session helpers: the shared scratch folder, table reads, cutting lineage, Arrow batches, sums over all tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where nothing is set and the master is local (tests, single-machine use) a temporary folder is made
    and registered as the checkpoint folder of the context; on a cluster that is an error, as executors
    could not read it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result does not depend on any executor: a lost one costs its running tasks only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote; nothing may read them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        base = shared_dir(df.sparkSession).split("://")[-1].removeprefix("file:").lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in folder:  # only ever below the shared folder
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable, schema: str, rows: int | None = None) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with ``rows`` at most in each batch that ``run`` sees.

    Batches of whole texts are kept small by slicing here, so the session's own batch size stays as it is.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows or max(1, b.num_rows)):
                yield b.slice(at, rows or b.num_rows)

    return df.mapInArrow(lambda batches: run(sliced(batches)), schema)


def free_name(df: DataFrame | Iterable[str], name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: Iterable[str]) -> list[Column]:
    """The columns by name, whatever characters are in it."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def vector_total(df: DataFrame, width: int, part: Callable[[pa.RecordBatch], np.ndarray], fan_in: int = 64) -> np.ndarray:
    """Sum over all batches of ``df`` of ``part(batch)``, a float vector of that width.

    A task sends one row, its own sum; tasks then add up ``fan_in`` of those each, until the driver gets that many at
    most. Sums are added in order of partition, so equal partitions give equal sums.
    """
    schema = "part long, v binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for p, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(p // fan_in, []).append((p, v))
        for p, own in held.items():  # a group is in one task, of ``fan_in`` rows at most
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([_added(own, width).tobytes()], pa.binary())], names=["part", "v"])

    sums = cut(df.mapInArrow(first, schema), "sums")
    while sums.count() > fan_in:
        sums = cut(sums.repartition(F.floor(F.col("part") / fan_in)).mapInArrow(again, schema), "sums")
    return _added([(r["part"], r["v"]) for r in sums.collect()], width)


def _added(rows: list[tuple[int, bytes]], width: int) -> np.ndarray:
    total = np.zeros(width)
    for _, v in sorted(rows):
        total += np.frombuffer(v)
    return total
