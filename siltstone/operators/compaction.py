"""Merging runs down the levels: when, which, how, and what an interrupted merge leaves."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.sizes import level_limit
from siltstone.operators.ordering import with_position
from siltstone.operators.resolve import newest
from siltstone.sources.manifest import Manifest

WRITE_START, WRITE_COMPLETE = "WRITE_START", "WRITE_COMPLETE"
DELETE_START, DELETE_COMPLETE = "DELETE_START", "DELETE_COMPLETE"


@dataclass(frozen=True)
class Plan:
    """Runs to merge and the level that takes the result."""

    inputs: tuple[int, ...]
    level: int


class Strategy(Protocol):
    def plan(self, m: Manifest) -> Plan | None: ...


@dataclass(frozen=True)
class SizeTiered:
    """A level beyond its limit moves whole into the next, and on while that overflows; the data is written once, at the end."""

    level0_max: int = 256 << 20
    growth: int = 2
    kind: str = "linear"

    def limit(self, level: int) -> int:
        return level_limit(level, self.level0_max, self.growth, self.kind)

    def plan(self, m: Manifest) -> Plan | None:
        """From the highest overflowing level; deeper levels that overflow by themselves come with later calls."""
        for start in range(m.levels()):
            if m.level_size(start) > self.limit(start):
                break
        else:
            return None
        level, size, inputs = start, 0, []
        while True:
            own = [r for r in m.runs if r.level == level]
            size += sum(r.size for r in own)
            if size <= self.limit(level):
                break
            inputs += [r.sst_id for r in own]
            level += 1
        return Plan(tuple(inputs), level)


def cascade_level(total, level0_max: int, growth: int) -> DataFrame:
    """(final_level, size_bytes) of a frame (size_bytes) of level-0 totals that move down whole: the first level that holds them."""
    deepest = F.ceil(F.col("size_bytes") / (level0_max * growth)) + 1
    levels = total.select("size_bytes", F.explode(F.sequence(F.lit(0).cast("long"), deepest)).alias("lvl"))
    fits = F.col("size_bytes") <= level0_max * F.greatest(F.col("lvl") * growth, F.lit(1))
    return levels.where(fits).groupBy("size_bytes").agg(F.min("lvl").alias("final_level")).select("final_level", "size_bytes")


def merge_all(rows: DataFrame, key: str = "k", seq: str = "seq") -> DataFrame:
    """All versions with their place in key order; equal keys by ``seq``."""
    return with_position(rows, key, seq)


def merge_newest(rows: DataFrame, key: str = "k") -> DataFrame:
    """One version of each key, the newest."""
    return newest(rows, key)


def unfinished(events: DataFrame, target: str = "path") -> DataFrame:
    """Targets whose last event of a kind (write or delete) is its start. ``events``: (seq, target, op)."""
    kind = F.when(F.col("op").startswith("WRITE"), "WRITE").otherwise("DELETE")
    last = F.row_number().over(Window.partitionBy(target, "kind").orderBy(F.col("seq").desc()))
    return events.withColumn("kind", kind).withColumn("_rn", last).where("_rn = 1").where(F.col("op").endswith("START")).select(target).distinct()


def orphans(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Folders of ``files`` (path) that no run of ``runs`` (path) names."""
    folder = F.regexp_extract("path", r"^(.*/sst-\d+)/", 1)
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    on_disk = files.select(plain(folder).alias("path")).where("path <> ''").distinct()
    return on_disk.join(runs.select(plain(F.col("path")).alias("path")), "path", "left_anti")
