"""Cutting a stream of writes into segments of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ordering import with_position


def fixed_segments(rows: DataFrame, order: str, limit: int, size: int) -> DataFrame:
    """mem_id for unique keys and values of one size: a segment takes floor(limit / size) rows in order."""
    return with_position(rows, order, name="_pos").withColumn("mem_id", F.floor(F.col("_pos") / (limit // size))).drop("_pos")


def folded_segments(rows: DataFrame, limit: int, shard: str | None = None) -> DataFrame:
    """(seq, k, mem_id) of rows (seq, k, size): a segment ends before the write whose size times the distinct keys with it exceeds the limit.

    The end of a segment depends on all keys since its start, so the rows of a shard are read in order by one task: this is
    for exact figures. The task streams over sorted rows and holds the keys of one segment alone. Tables cut by summed
    bytes, which needs no fold. Without a shard column all rows are one shard.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_, seen, segment = None, set(), 0
        for x in batches:
            out = []
            for s, k, size in zip(*(x.column(c).to_pylist() for c in ("_shard", "k", "size"))):
                if s != shard_:
                    shard_, seen, segment = s, set(), 0
                if (len(seen) + 1) * size > limit:
                    segment, seen = segment + 1, set()
                seen.add(k)
                out.append(segment)
            yield pa.RecordBatch.from_arrays([x.column("seq"), x.column("k"), pa.array(out, pa.int64())], names=["seq", "k", "mem_id"])

    kinds = dict(rows.dtypes)
    dealt = rows.select(F.lit(0).alias("_shard") if shard is None else F.col(shard).alias("_shard"), "seq", "k", "size")
    dealt = dealt.repartition(1) if shard is None else dealt.repartition("_shard")
    return dealt.sortWithinPartitions("_shard", "seq").mapInArrow(fold, f"seq {kinds['seq']}, k {kinds['k']}, mem_id long")


def sorted_runs(segments: DataFrame) -> DataFrame:
    """(mem_id, k, v, pos): the rows of each segment by key."""
    pos = F.row_number().over(Window.partitionBy("mem_id").orderBy("k")) - 1
    return segments.select("mem_id", "k", "v", pos.cast("long").alias("pos"))


def segment_stats(segments: DataFrame, size) -> DataFrame:
    """Rows, bytes and key bounds of each segment, and whether it is the last one, which is still open."""
    stats = segments.groupBy("mem_id").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("size_bytes"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))
    last = segments.agg(F.max("mem_id")).first()[0]
    return stats.withColumn("is_active", F.col("mem_id") == F.lit(last))


def oversize(rows: DataFrame, size, limit: int) -> DataFrame:
    """Rows whose value alone exceeds a segment."""
    return rows.withColumn("size_bytes", size).where(F.col("size_bytes") > limit)
