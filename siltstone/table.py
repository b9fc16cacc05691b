"""A versioned key-value table: a change log, key-sorted runs in levels, and a committed manifest."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import KEY_NOT_FOUND, LogDisabled, TableError
from siltstone.functions.sizes import size_of
from siltstone.operators import compaction
from siltstone.operators.compaction import SizeTiered, Strategy
from siltstone.operators.resolve import lookup, newest
from siltstone.sources import manifest as catalog
from siltstone.sources import paths, runs


@dataclass(frozen=True)
class Options:
    """``memtable_threshold``: bytes of values that writes hold before they become a run. ``oversize``: accept or reject values beyond it."""

    memtable_threshold: int = 64 << 20
    oversize: str = "accept"
    wal: bool = True
    wal_dir: str | None = None
    gc_log_dir: str | None = None
    compaction: bool = True
    strategy: Strategy = SizeTiered()
    merge: str = "newest"  # or "all": keep shadowed versions
    retain: float = 3600.0  # seconds for which frames of an older version stay readable


@dataclass(frozen=True)
class WriteResult:
    n_written: int
    n_rejected: int
    flushed: bool


@dataclass(frozen=True)
class CompactionReport:
    inputs: tuple[int, ...]
    level: int
    rows: int
    size: int


class KVTable:
    """One writer, any number of readers; a frame keeps to the version it was made from.

    Runs and log batches that a newer version no longer reads are only marked; ``vacuum`` deletes them once they have been left
    for ``Options.retain`` seconds. Opening for reading changes nothing. A writer that opens a table and has to clean up
    commits a version first, so an earlier writer that is still at work fails at its next commit and loses nothing: its
    writes are in the log.
    """

    def __init__(self, spark: SparkSession, root: str, m: catalog.Manifest, opts: Options, size: Column | None):
        self.spark, self.root, self.opts, self.m = spark, root.rstrip("/"), opts, m
        self.key, self.value = T._parse_datatype_string(m.key), T._parse_datatype_string(m.value)
        self.size = size if size is not None else size_of(F.col("v"), self.value)
        self.log = opts.wal_dir or runs.log_dir(self.root, m.name)
        self.gc_log = opts.gc_log_dir or f"{self.root}/gc-log/{m.name}"
        self.held: list[DataFrame] = []  # unflushed writes without a log
        self.batches: list[int] = []
        self.held_bytes = self.held_rows = 0  # of the unflushed writes
        self.writes = True
        self.lock = threading.RLock()
        self._stop: threading.Event | None = None

    @property
    def schema(self) -> str:
        return f"seq bigint, k {self.key.simpleString()}, v {self.value.simpleString()}, op string, size bigint"

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, key: str = "bigint", value: str = "int", opts: Options = Options(), size: Column | None = None, mode: str = "write") -> KVTable:
        """Open, for writing or reading; for writing a missing table is made. A table that exists keeps its types: others are refused. Unflushed log batches are found again."""
        key, value = (T._parse_datatype_string(x).simpleString() for x in (key, value))
        m = catalog.load(spark, root.rstrip("/"), name)
        if m is None and mode == "read":
            raise TableError(f"no table {name}")
        if m is None:
            m = catalog.commit(spark, root.rstrip("/"), catalog.Manifest(name, key=key, value=value))
        elif (m.key, m.value) != (key, value):
            raise TableError(f"{name} holds {m.key} -> {m.value}, not {key} -> {value}")
        table = cls(spark, root, m, opts, size)
        if mode == "read":
            table.writes = False
            table._find_batches()
        else:
            table.recover()
        return table

    def refresh(self) -> KVTable:
        """A reader's view of the newest version; frames made before keep theirs."""
        if not self.writes:
            self.m = catalog.load(self.spark, self.root, self.m.name)
            self._find_batches()
        return self

    def _check_writes(self) -> None:
        if not self.writes:
            raise TableError("opened for reading")

    # writes

    def put(self, df: DataFrame, order_by: str | list[str] | None = None, late: bool = False, token: str | None = None) -> WriteResult:
        """Append writes (k, v). Later writes win: by column ``seq`` if there is one, else by ``order_by``.

        ``seq`` must exceed what the table holds, unless ``late`` writes are expected: these win over older ones and lose
        to newer ones. With ``order_by`` rows are numbered over sorted ranges, so numbers rise but may leave gaps. Null keys
        are refused. The log is written before anything else. A ``token`` names the writes: with one that the log or a
        run has, whole, nothing is written again.
        """
        with self.lock:
            return self._put(df, order_by, late, token)

    def _put(self, df: DataFrame, order_by: str | list[str] | None, late: bool, token: str | None) -> WriteResult:
        self._check_writes()
        have = dict(df.dtypes)
        for c, kind in (("k", self.key), ("v", self.value)):
            if have.get(c) != kind.simpleString():
                raise TableError(f"column {c} must be {kind.simpleString()}, not {have.get(c)}")
        base = self.m.next_seq
        if "seq" in have:
            rows = df.select(F.col("seq").cast("bigint").alias("seq"), "k", "v")
        elif order_by is not None:
            keys = [order_by] if isinstance(order_by, str) else list(order_by)
            ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            rows = ranged.select((F.monotonically_increasing_id() + base).alias("seq"), "k", "v")
        else:
            raise TableError("put needs a column seq or order_by")
        rows = rows.select("seq", "k", "v", F.lit(runs.WRITE).alias("op")).withColumn("size", self.size)
        batch = 1 + max([self.m.flushed, *self.batches, *(n for n, *_ in self._claims())])
        if token is not None:
            if not self.opts.wal:
                raise LogDisabled
            if not self._claim(token, batch):
                return WriteResult(0, 0, False)
        if self.opts.wal:
            runs.append_log(rows, self.log, batch)
            rows = runs.replay_log(self.spark, self.log, self.schema, [batch]).drop("batch")
        else:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        too_big = F.col("size") > self.opts.memtable_threshold if self.opts.oversize == "reject" else F.lit(False)
        kept = F.sum(F.when(~too_big, F.col("size")))
        got = rows.agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("nulls"), F.count_if(too_big).alias("big"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), kept.alias("bytes")).first()
        if got.nulls or (got.n and not late and got.lo < base):
            if self.opts.wal:
                runs.delete_log(self.spark, self.log, [batch])
            raise TableError("null keys" if got.nulls else f"seq must be at least {base}")
        if got.n:
            self.batches.append(batch)
            self._mark_done([batch])
            self.held_bytes += got.bytes or 0
            self.held_rows += got.n - got.big
            if not self.opts.wal:
                self.held.append(rows)
            self.m = replace(self.m, next_seq=max(base, got.hi + 1))
        elif self.opts.wal and token is None:
            runs.delete_log(self.spark, self.log, [batch])
        full = self.held_bytes >= self.opts.memtable_threshold
        if full:
            self.flush()
            if self.opts.compaction:
                self.compact()
        return WriteResult(got.n - got.big, got.big, full)

    def _claims(self) -> list[tuple[int, str, int, bool]]:
        """(log batch, source, number, done) of the log's named writes."""
        if not self.opts.wal:
            return []
        found = [f.split("-") for f in paths.children(self.spark, f"{self.root}/claims/{self.m.name}") if f.count("-") == 3]
        done = {tuple(f[1:]) for f in found if f[0] == "done"}
        return [(int(f[1]), f[2], int(f[3]), tuple(f[1:]) in done) for f in found if f[0] == "batch"]

    def _claim(self, token: str, batch: int) -> bool:
        """Claim a log batch for named writes (source/number); false if they have been written whole. Of a source's older claims the last stays."""
        source, _, number = token.rpartition("/")
        source, top, n = hashlib.sha1(source.encode()).hexdigest(), f"{self.root}/claims/{self.m.name}", int(number)
        own = sorted(c for c in self._claims() if c[1] == source)
        if any(c[2] == n and c[3] for c in own):
            return False
        for old in [c for c in own if c[2] == n] + [c for c in own if c[2] != n][:-1]:  # a claim that was not done is given up
            if old[0] not in self.batches and not old[3]:
                runs.delete_log(self.spark, self.log, [old[0]])
            for kind in ("batch", "done"):
                paths.delete(self.spark, f"{top}/{kind}-{old[0]:012d}-{source}-{old[2]}")
        paths.write_new(self.spark, f"{top}/batch-{batch:012d}-{source}-{n}", "")
        return True

    def _mark_done(self, batches: list[int]) -> None:
        for batch, source, n, done in self._claims():
            if batch in batches and not done:
                paths.write_new(self.spark, f"{self.root}/claims/{self.m.name}/done-{batch:012d}-{source}-{n}", "")

    def _unflushed(self) -> DataFrame:
        if self.opts.wal:
            rows = runs.replay_log(self.spark, self.log, self.schema, self.batches).drop("batch")
        else:
            rows = self.spark.createDataFrame([], self.schema)
            for r in self.held:
                rows = rows.unionByName(r)
        return rows.where(F.col("size") <= self.opts.memtable_threshold) if self.opts.oversize == "reject" else rows

    def unflushed_bytes(self) -> int:
        return self.held_bytes

    def flush(self) -> int:
        """Unflushed writes become a run of level 0, newest version of each key, and the log batches are left. Empty runs are never written."""
        with self.lock:
            self._check_writes()
            if self.batches:
                rows = newest(self._unflushed().select("k", "v", "seq", "size"))
                run = self._write(rows, 0, self.held_bytes, self.held_rows)
                done = replace(self.m, flushed=max(self.batches), next_id=self.m.next_id + 1).with_runs([run] if run else [])
                self._commit(done, [runs.batch_path(self.log, b) for b in self.batches] if self.opts.wal else [])
                for r in self.held:
                    r.unpersist()
                self.batches, self.held, self.held_bytes, self.held_rows = [], [], 0, 0
            return self.m.version

    def _commit(self, m: catalog.Manifest, left: list[str]) -> None:
        """Commit a version that no longer reads ``left``; what earlier ones left long ago is deleted after."""
        now = time.time()
        late = [r for r in m.retired if r.at <= now - self.opts.retain]
        kept = tuple(r for r in m.retired if r not in late) + tuple(catalog.Retired(p, now) for p in left)
        self.m = catalog.commit(self.spark, self.root, replace(m, retired=kept))
        self._delete([r.path for r in late])

    def _delete(self, found: list[str]) -> None:
        for path in found:
            run = f"/{self.m.name}/level-" in path
            if run:
                self._event(path, compaction.DELETE_START)
            paths.delete(self.spark, path)
            if run:
                self._event(path, compaction.DELETE_COMPLETE)

    def _write(self, rows: DataFrame, level: int, size: int, n: int) -> catalog.Run | None:
        path = catalog.run_path(self.root, self.m.name, level, self.m.next_id)
        self._event(path, compaction.WRITE_START)
        runs.write_run(rows.select("k", "v", "seq", "size"), path, size, n)
        stats = runs.run_stats(self._read([path]))
        self._event(path, compaction.WRITE_COMPLETE)
        if not stats["n"]:
            paths.delete(self.spark, path)
            return None
        return catalog.Run(level, self.m.next_id, path, **stats)

    def _read(self, where: list[str]) -> DataFrame:
        kinds = f"k {self.key.simpleString()}, v {self.value.simpleString()}, seq bigint, size bigint"
        return self.spark.read.schema(kinds).parquet(*where) if where else self.spark.createDataFrame([], kinds)

    # compaction

    def compact(self) -> CompactionReport | None:
        """One planned merge; null if no level overflows. The snapshot does not change, and frames of older versions stay readable."""
        with self.lock:
            self._check_writes()
            plan = self.opts.strategy.plan(self.m)
            if plan is None:
                return None
            chosen = [r for r in self.m.runs if r.sst_id in plan.inputs]
            rows = self._read([r.path for r in chosen])
            merged = compaction.merge_newest(rows) if self.opts.merge == "newest" else rows
            run = self._write(merged, plan.level, sum(r.size for r in chosen), sum(r.n for r in chosen))
            done = replace(self.m, next_id=self.m.next_id + 1).with_runs([run] if run else [], plan.inputs)
            self._commit(done, [r.path for r in chosen])
            return CompactionReport(plan.inputs, plan.level, run.n if run else 0, run.size if run else 0)

    def compact_every(self, seconds: float) -> None:
        """Merge overflowing levels from time to time beside the writer, until ``close``."""
        self._check_writes()
        if self._stop is None:
            self._stop = threading.Event()

            def work(stop: threading.Event) -> None:
                while not stop.wait(seconds):
                    while not stop.is_set() and self.compact():
                        pass

            threading.Thread(target=work, args=(self._stop,), daemon=True, name=f"compact-{self.m.name}").start()

    def _event(self, path: str, op: str) -> None:
        at = time.time_ns()
        paths.write_new(self.spark, f"{self.gc_log}/event-{at}.json", json.dumps({"seq": at, "path": path, "op": op}) + "\n")

    def events(self) -> DataFrame:
        """(seq, path, op): the log of merges."""
        if not paths.children(self.spark, self.gc_log):
            return self.spark.createDataFrame([], "seq bigint, path string, op string")
        return self.spark.read.schema("seq bigint, path string, op string").json(self.gc_log)

    def _find_batches(self) -> None:
        """The log's complete batches that no run holds, and their figures."""
        self.batches, self.held_bytes, self.held_rows = [], 0, 0
        if self.opts.wal:
            self.batches = [b for b in runs.log_batches(self.spark, self.log) if b > self.m.flushed]
            if self.batches:
                got = self._unflushed().agg(F.max("seq").alias("hi"), F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
                self.held_bytes, self.held_rows = got.bytes or 0, got.n
                self.m = replace(self.m, next_seq=max(self.m.next_seq, -1 if got.hi is None else got.hi + 1))

    def recover(self) -> list[str]:
        """Find unflushed batches, delete what interrupted merges left and what is long out of use, empty the merge log.

        A version is committed before anything is deleted: a writer that is still at work on such a run fails at its commit.
        """
        with self.lock:
            self._check_writes()
            self._find_batches()
            self._mark_done(self.batches)
            gone = []
            if paths.children(self.spark, self.gc_log):
                # unfinished writes, and finished ones that no manifest names; at most the runs of one writer's last merge
                named = {r.path for r in self.m.runs} | {r.path for r in self.m.retired}
                gone = sorted({r.path for r in compaction.unfinished(self.events()).collect() if r.path not in named} | set(self._strays()))
                if gone:
                    self._commit(self.m, [])
                    for path in gone:
                        paths.delete(self.spark, path)
                paths.delete(self.spark, self.gc_log)
            return gone

    def replay(self) -> DataFrame:
        """Events of the log that no run holds."""
        if not self.opts.wal:
            raise LogDisabled
        return runs.replay_log(self.spark, self.log, self.schema, self.batches)

    def _strays(self) -> list[str]:
        """Run folders that the manifest does not name."""
        named, found = {r.path for r in self.m.runs} | {r.path for r in self.m.retired}, []
        top = f"{self.root}/{self.m.name}"
        for level in paths.children(self.spark, top):
            found += [f"{top}/{level}/{sst}" for sst in paths.children(self.spark, f"{top}/{level}")]
        return [path for path in found if path not in named]

    def vacuum(self, retain: float | None = None) -> list[str]:
        """Delete run folders that the manifest does not name, and runs and log batches left more than ``retain`` seconds ago; returns them.

        Frames of versions older than that are no longer readable.
        """
        with self.lock:
            self._check_writes()
            before = time.time() - (self.opts.retain if retain is None else retain)
            late = [r.path for r in self.m.retired if r.at <= before]
            gone = self._strays() + late
            if gone:
                self._commit(replace(self.m, retired=tuple(r for r in self.m.retired if r.path not in set(late))), [])
                self._delete(gone)
            return gone

    # reads

    def _runs_for(self, key) -> list[catalog.Run]:
        """Runs whose key bounds admit the key, newest level first."""
        if isinstance(self.key, (T.IntegralType, T.StringType)):  # JSON holds these exactly; strings order by code point as by bytes
            bounds = [(r, json.loads(r.min_k)["k"], json.loads(r.max_k)["k"]) for r in self.m.runs]
            return sorted((r for r, lo, hi in bounds if lo <= key <= hi), key=lambda r: (r.level, -r.sst_id))
        if not self.m.runs:
            return []
        bounds = self.spark.createDataFrame([(r.sst_id, r.min_k, r.max_k) for r in self.m.runs], "id bigint, lo string, hi string")
        kind, k = f"k {self.key.simpleString()}", F.lit(key).cast(self.key)
        ids = {r.id for r in bounds.where((F.from_json("lo", kind)["k"] <= k) & (k <= F.from_json("hi", kind)["k"])).collect()}
        return sorted((r for r in self.m.runs if r.sst_id in ids), key=lambda r: (r.level, -r.sst_id))

    def get(self, key) -> DataFrame:
        """(k, v, err) of one key, a null key is a miss: runs outside whose bounds it lies are not opened, and the filter reaches the files of the others."""
        kind = self.key.simpleString()
        k = F.lit(key).cast(kind)
        admitted = [] if key is None else self._runs_for(key)
        rows = self._read([r.path for r in admitted]).select("k", "v", "seq").union(self._unflushed().select("k", "v", "seq"))
        asked = self.spark.createDataFrame([(key,)], f"k {kind}")
        hit = rows.where(F.col("k") == k).orderBy(F.col("seq").desc()).limit(1).withColumn("_hit", F.lit(True))
        return asked.join(F.broadcast(hit.drop("seq")), "k", "left").select("k", "v", F.when(F.col("_hit").isNull(), F.lit(KEY_NOT_FOUND)).alias("err"))

    def multi_get(self, probe: DataFrame) -> DataFrame:
        """(k, v, err) for each row of ``probe`` (k), in one join; runs outside the bounds of its keys are not opened."""
        stored = self.m.runs
        if isinstance(self.key, (T.IntegralType, T.StringType)) and stored:
            low, high = probe.agg(F.min("k"), F.max("k")).first()
            stored = [r for r in stored if low is not None and json.loads(r.min_k)["k"] <= high and json.loads(r.max_k)["k"] >= low]
            within = F.col("k").between(F.lit(low).cast(self.key), F.lit(high).cast(self.key))
        else:
            within = F.lit(True)
        rows = self._read([r.path for r in stored]).select("k", "v", "seq").union(self._unflushed().select("k", "v", "seq"))
        return lookup(rows.where(within), probe)

    def history(self) -> DataFrame:
        """All versions: (k, v, seq, level, sst_id, tier); unflushed ones have level -1."""
        ids = F.regexp_extract("_metadata.file_path", r"/level-(\d+)/sst-(\d+)/", 1), F.regexp_extract("_metadata.file_path", r"/level-(\d+)/sst-(\d+)/", 2)
        stored = self._read([r.path for r in self.m.runs])
        if self.m.runs:
            stored = stored.select("k", "v", "seq", ids[0].cast("int").alias("level"), ids[1].cast("bigint").alias("sst_id"))
        else:
            stored = stored.select("k", "v", "seq", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("sst_id"))
        now = self._unflushed().select("k", "v", "seq", F.lit(-1).alias("level"), F.lit(-1).cast("bigint").alias("sst_id"))
        return stored.union(now).withColumn("tier", F.col("level"))

    def snapshot(self) -> DataFrame:
        """(k, v, seq): the newest version of each key."""
        return newest(self.history().select("k", "v", "seq"))

    def manifest(self) -> DataFrame:
        return catalog.rows(self.spark, self.m)

    def level(self, number: int) -> list[catalog.Run]:
        return self.m.level(number)

    def drop_unflushed(self) -> None:
        """Forget writes that no run holds; for tests of recovery the log stays."""
        for r in self.held:
            r.unpersist()
        self.batches, self.held, self.held_bytes, self.held_rows = [], [], 0, 0

    def close(self) -> None:
        if self._stop is not None:
            self._stop.set()
            self._stop = None
        for r in self.held:
            r.unpersist()
        self.held = []
