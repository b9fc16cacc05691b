"""The catalog: which runs a table has. Immutable snapshots, one JSON file for each version, committed by rename."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import CommitConflict, TableError
from siltstone.sources import paths

VIEW_SCHEMA = "name string, levels array<struct<tables: map<string, struct<path: string, size: bigint>>>>"
ROW_SCHEMA = "name string, level int, sst_id bigint, path string, size bigint, n bigint, min_k string, max_k string, max_seq bigint"


@dataclass(frozen=True)
class Run:
    """A key-sorted run: ``size`` is the sum of its values' bytes; key bounds are JSON texts."""

    level: int
    sst_id: int
    path: str
    size: int
    n: int = 0
    min_k: str | None = None
    max_k: str | None = None
    max_seq: int = -1


@dataclass(frozen=True)
class Retired:
    """A run or log batch that newer versions no longer read, and when it was left (seconds since the epoch)."""

    path: str
    at: float


@dataclass(frozen=True)
class Manifest:
    name: str
    version: int = 0
    key: str = ""
    value: str = ""
    next_id: int = 0
    next_seq: int = 0
    flushed: int = -1  # the last log batch that runs hold
    runs: tuple[Run, ...] = field(default_factory=tuple)
    retired: tuple[Retired, ...] = field(default_factory=tuple)

    def level(self, number: int) -> list[Run]:
        """The runs of a level; levels go from 0 to the deepest one that has been used."""
        if not 0 <= number < self.levels():
            raise TableError(f"no level {number}")
        return [r for r in self.runs if r.level == number]

    def levels(self) -> int:
        return 1 + max((r.level for r in self.runs), default=0)

    def level_size(self, number: int) -> int:
        return sum(r.size for r in self.runs if r.level == number)

    def with_runs(self, add: Iterable[Run] = (), remove: Iterable[int] = ()) -> Manifest:
        gone = set(remove)
        return replace(self, runs=tuple(r for r in self.runs if r.sst_id not in gone) + tuple(add))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(**raw | {"runs": tuple(Run(**r) for r in raw["runs"]), "retired": tuple(Retired(**r) for r in raw.get("retired", ()))})

    def view_json(self) -> str:
        """The plain shape: levels, and in each the runs by id with path and size."""
        levels = [{"tables": {str(r.sst_id): {"path": r.path, "size": r.size} for r in self.runs if r.level == i}} for i in range(self.levels())]
        return json.dumps({"name": self.name, "levels": levels})


def run_path(root: str, name: str, level: int, sst_id: int) -> str:
    """Empty for a negative level or id."""
    return "" if level < 0 or sst_id < 0 else f"{level_path(root, name, level)}/sst-{sst_id}"


def level_path(root: str, name: str, level: int) -> str:
    return "" if level < 0 else f"{root}/{name}/level-{level}"


def _folder(root: str, name: str) -> str:
    return f"{root}/manifest/{name}"


def load(spark: SparkSession, root: str, name: str) -> Manifest | None:
    """The newest version, or none."""
    found = [f for f in paths.children(spark, _folder(root, name)) if f.startswith("manifest-") and f.endswith(".json")]
    return Manifest.from_json(paths.read_text(spark, f"{_folder(root, name)}/{max(found)}")) if found else None


def commit(spark: SparkSession, root: str, new: Manifest) -> Manifest:
    """Write the next version; it fails if another writer has written it."""
    new = replace(new, version=new.version + 1)
    if not paths.write_new(spark, f"{_folder(root, new.name)}/manifest-{new.version:012d}.json", new.to_json()):
        raise CommitConflict(f"version {new.version} of {new.name} exists")
    return new


def rows(spark: SparkSession, m: Manifest) -> DataFrame:
    return spark.createDataFrame([(m.name, r.level, r.sst_id, r.path, r.size, r.n, r.min_k, r.max_k, r.max_seq) for r in m.runs], ROW_SCHEMA)


def from_view(json_rows: DataFrame, column: str = "json") -> DataFrame:
    """(name, level, sst_id, path, size) of plain manifests in a text column; ids and sizes are kept."""
    parsed = json_rows.select(F.from_json(column, VIEW_SCHEMA).alias("m")).select("m.name", F.posexplode("m.levels").alias("level", "l"))
    return parsed.select("name", "level", F.explode("l.tables").alias("id", "t")).select("name", "level", F.col("id").cast("bigint").alias("sst_id"), "t.path", "t.size")


def to_view(run_rows: DataFrame) -> DataFrame:
    """(name, json): plain manifests from rows (name, level, sst_id, path, size); a level without runs has none."""
    table = F.struct(F.col("sst_id").cast("string").alias("key"), F.struct("path", "size").alias("value"))
    per = run_rows.groupBy("name", "level").agg(F.map_from_entries(F.collect_list(table)).alias("tables"))
    got = per.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("level", "tables"))).alias("by"), F.max("level").alias("top"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<path: string, size: bigint>>"))
    levels = F.transform(F.sequence(F.lit(0), "top"), lambda i: F.struct(F.coalesce(F.try_element_at("by", i.cast("int")), none).alias("tables")))
    return got.select("name", F.to_json(F.struct("name", levels.alias("levels"))).alias("json"))
