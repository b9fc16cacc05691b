"""Files that driver and executors share, through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import TableError

#: Used only on one machine, where the session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/siltstone-tables"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: as the session names it, else its checkpoint folder. A cluster without either is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = kept.get() if kept.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise TableError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = FALLBACK_DIR
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/siltstone-kv/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; a missing folder has none."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole under a new name by renaming a temporary one; false if the name is taken."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(temp, p):
        fs.delete(temp, False)
        return False
    return True


def dir_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder, from file metadata alone."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length"))
