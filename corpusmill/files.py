"""Small files by any path that Spark knows: read, written whole or not at all, listed, hashed."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """The file, or its first ``most`` bytes."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        jvm = spark.sparkContext._jvm
        size = fs.getFileStatus(p).getLen()
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size if most is None else min(size, most))))
    finally:
        stream.close()


def first_file(spark: SparkSession, path: str) -> str:
    """``path``, or the first file by name in it if it is a folder."""
    p, fs = _path(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    names = sorted(s.getPath().toString() for s in fs.listStatus(p) if not s.isDirectory() and s.getPath().getName()[:1] not in "._")
    if not names:
        raise FileNotFoundError(path)
    return names[0]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside its place and moved there, so that readers find the old file or the new one."""
    sc = spark.sparkContext
    jvm = sc._jvm
    p, fs = _path(spark, path)
    new = p.suffix(".tmp")
    out = fs.create(new, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = jvm.java.lang.Enum.valueOf(rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(p), how)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Sorted keys, two spaces."""
    write_bytes(spark, path, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True, default=str).encode("utf-8"))


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_bytes(spark, path))


def _empty_files(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    root, found, todo = fs.makeQualified(p).toUri().getPath(), [], fs.listFiles(p, True)
    while todo.hasNext():
        s = todo.next()
        path = s.getPath().toUri().getPath()[len(root) + 1 :]
        if s.getLen() == 0 and not any(x[0] in "._" for x in path.split("/")):
            found.append(path)
    return found


def hashes(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, sha256) of all files below ``folder``, by path in it."""
    p, fs = _path(spark, folder)
    root = fs.makeQualified(p).toUri().getPath()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring(F.regexp_replace("path", r"^[a-z0-9+.-]+:(//[^/]*)?", ""), len(root) + 2, 1 << 20)
    # Spark passes over files without content
    empty = [(f, hashlib.sha256(b"").hexdigest()) for f in _empty_files(spark, folder)]
    every = found.select(name.alias("path"), F.sha2("content", 256).alias("sha256")).unionByName(spark.createDataFrame(empty, "path string, sha256 string"))
    return every.where(~F.col("path").isin(list(exclude)) if exclude else F.lit(True))


def verify_hashes(spark: SparkSession, folder: str, expected: dict[str, str], exclude: tuple[str, ...] = ("artifact_checksums.json", "run_manifest.json")) -> None:
    """Raises if a file of ``expected`` is missing or different, or if there is another."""
    actual = {r["path"]: r["sha256"] for r in hashes(spark, folder, exclude).collect()}  # a run's own files
    differ, extra = sorted(p for p, h in expected.items() if actual.get(p) != h), sorted(set(actual) - set(expected))
    if differ or extra:
        raise ValueError(f"artifact_checksum_mismatch:mismatched={differ}:extra={extra}")
