"""Global positions without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources import paths


def with_position(rows: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """``rows`` with the place of each in the order of ``keys``, from 0.

    Rows are sorted over ranges of the keys and written once with their place in the range; the ranges' sizes (a row for
    each task) give the ranges' offsets. The keys should be unique; ties stand in any order.
    """
    spark = rows.sparkSession
    path = paths.fresh(spark, "sorted")
    inside = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.select("*", F.spark_partition_id().alias("_p"), (inside - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_i")).write.parquet(path)
    held = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_i", T.LongType())])).parquet(path)
    sizes = held.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def dense_positions(rows: DataFrame, key: str, name: str = "pos", start: int = 1) -> DataFrame:
    """``rows`` with the rank of each key among the distinct keys."""
    ranked = with_position(rows.select(key).distinct(), key, name=name)
    return rows.join(ranked.withColumn(name, F.col(name) + start), key)
