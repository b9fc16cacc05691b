"""Shared storage, lineage cuts and graph components for the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.paths import work_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    return work_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete what ``save`` wrote for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has long columns a, b. Returns (node, component), where component is the smallest node that links
    reach; only nodes that occur in an edge with two different ends are returned. Null ends are ignored. Each round is
    two joins and two combinable aggregations over the edges and is cut with a written table; the driver sees only a
    count and a checksum. A hub's neighbours are never gathered: its minimum is aggregated, and the join on it may be split.
    """
    now = save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-edges",
    )
    sums = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    mark = now.agg(*sums).first()
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        nxt = save(small, f"{name}-round")
        new = nxt.agg(*sums).first()
        drop_saved(now)
        now = nxt
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()

