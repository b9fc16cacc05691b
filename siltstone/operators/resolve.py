"""Which version of a key counts: the newest write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import KEY_NOT_FOUND


def newest(rows: DataFrame, key: str = "k", seq: str = "seq") -> DataFrame:
    """The row of the highest ``seq`` of each key, whole rows.

    Old versions go before the shuffle: a partial group limit for general rows, a partial hash aggregate when all other
    columns are of fixed width. A hot key therefore sends at most a row from each task.
    """
    rest = [c for c in rows.columns if c != key]
    fixed = all(isinstance(rows.schema[c].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for c in rest)
    if fixed:
        return rows.groupBy(key).agg(*(F.max(c).alias(c) if c == seq else F.max_by(c, seq).alias(c) for c in rest)).select(*rows.columns)
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return rows.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def newest_by_tier(rows: DataFrame, key: str = "k", tier: str = "tier", seq: str = "seq") -> DataFrame:
    """The row of the lowest tier of each key, and in it of the highest ``seq``."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(tier).asc(), F.col(seq).desc()))
    return rows.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def lookup(versions: DataFrame, probe: DataFrame, key: str = "k") -> DataFrame:
    """(k, v, err) for each row of ``probe``: only the versions of asked keys are resolved; a miss has the error text."""
    asked = probe.select(F.col(key))
    found = newest(versions.join(asked.distinct(), key, "left_semi"), key).withColumn("_hit", F.lit(True))
    out = asked.join(found, key, "left")
    return out.select(key, "v", F.when(F.col("_hit").isNull(), F.lit(KEY_NOT_FOUND)).alias("err"))


def amplification(rows: DataFrame, key: str = "k", tier: str = "tier") -> DataFrame:
    """Versions of each key and tiers that hold it."""
    return rows.groupBy(key).agg(F.count("*").alias("versions"), F.countDistinct(tier).alias("tiers"))
