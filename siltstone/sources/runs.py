"""Key-sorted Parquet runs and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import LogMissing
from siltstone.sources import paths

WRITE = "WRITE"


#: Bytes of values, with this many more for each row, that a file of a run holds about.
FILE_BYTES, ROW_BYTES = 64 << 20, 24


def write_run(rows: DataFrame, path: str, size: int | None = None, n: int = 0) -> None:
    """Write rows (k, v, seq, size) sorted by key over ranges of keys, so that file and row-group bounds prune lookups.

    ``size`` and ``n``: bytes of values and rows at most, if known. What fits in one file has one range, for which nothing is sampled.
    """
    ranged = rows.repartitionByRange("k") if size is None else rows.repartitionByRange(max(1, -(-(size + ROW_BYTES * n) // FILE_BYTES)), "k")
    ranged.sortWithinPartitions("k", "seq").write.mode("overwrite").parquet(path)


def run_stats(run: DataFrame) -> dict:
    """Rows, bytes of values, key bounds and the newest write of a run, from three columns of it."""
    as_json = lambda c: F.to_json(F.struct(c.alias("k")))
    r = run.agg(F.count("*").alias("n"), F.sum("size").alias("size"), as_json(F.min("k")).alias("min_k"), as_json(F.max("k")).alias("max_k"), F.max("seq").alias("max_seq")).first()
    return {"n": r.n, "size": r.size or 0, "min_k": r.min_k, "max_k": r.max_k, "max_seq": -1 if r.max_seq is None else r.max_seq}


def log_dir(root: str, name: str) -> str:
    return f"{root}/log/{name}"


def batch_path(folder: str, batch: int) -> str:
    return f"{folder}/batch-{batch:012d}"


def log_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the log's complete batches, ascending."""
    return sorted(int(b[6:]) for b in paths.children(spark, folder) if b.startswith("batch-") and is_complete(spark, folder, int(b[6:])))


def is_complete(spark: SparkSession, folder: str, batch: int) -> bool:
    return paths.exists(spark, f"{batch_path(folder, batch)}/_SUCCESS")


def append_log(rows: DataFrame, folder: str, batch: int) -> None:
    """Write one batch of (seq, k, v, op); it counts once its success marker is there."""
    rows.write.mode("overwrite").parquet(batch_path(folder, batch))


def replay_log(spark: SparkSession, folder: str, schema: str, batches: list[int] | None = None) -> DataFrame:
    """All events of the batches with their batch number. Order is in ``seq``; reading twice is reading once."""
    if batches is None:
        if not paths.exists(spark, folder):
            raise LogMissing
        batches = log_batches(spark, folder)
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    rows = spark.read.schema(schema).parquet(*(batch_path(folder, b) for b in batches))
    return rows.withColumn("batch", F.regexp_extract("_metadata.file_path", r"batch-(\d+)/", 1).cast("bigint"))


def delete_log(spark: SparkSession, folder: str, batches: list[int]) -> None:
    for b in batches:
        paths.delete(spark, batch_path(folder, b))
