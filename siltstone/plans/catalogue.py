"""Queries over a folder of tables, each with the SQL that checks it.

Events are a put log: event_id is the order, user_id the key, value the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.sizes import size_of
from siltstone.operators import compaction, resolve, segments
from siltstone.operators.ordering import dense_positions
from siltstone.sources import manifest as catalog
from siltstone.sources import paths, runs
from siltstone.streaming.ingest import stream_into
from siltstone.table import KVTable, Options

#: The sizes of the simulated store: bytes of an open segment, of level 0, growth of levels.
SEGMENT, LEVEL0, GROWTH = 2048, 2048, 2


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("value").alias("v"))


def put_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes through the change log and back."""
    folder = paths.fresh(spark, "log")
    runs.append_log(_puts(spark, sf_dir).withColumn("op", F.lit(runs.WRITE)), folder, 0)
    return runs.replay_log(spark, folder, "seq bigint, k bigint, v double, op string").drop("batch")


def upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.newest(_puts(spark, sf_dir)).select("k", "v", "seq")


def get_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.lookup(_puts(spark, sf_dir), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


def sizeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").withColumn("s", F.struct("c_name", F.lit(0).cast("bigint").alias("age")))
    kinds = rows.schema
    return rows.select(F.col("c_custkey").alias("k"), size_of(F.col("c_nationkey"), kinds["c_nationkey"].dataType).alias("sz_int"), size_of(F.col("c_name"), kinds["c_name"].dataType).alias("sz_str"), size_of(F.col("s"), kinds["s"].dataType).alias("sz_struct"))


def sizeof_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(F.length("text")).cast("long").alias("chars"))


def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_positions(_t(spark, sf_dir, "part").select(F.col("p_name").alias("k")), "k")


def _order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return segments.fixed_segments(rows, "k", SEGMENT, 4)


def memtable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_segments(spark, sf_dir)


def memtable_segments_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.folded_segments(_puts(spark, sf_dir).select("seq", "k", F.lit(4).alias("size")), 256)


def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sorted_runs(_order_segments(spark, sf_dir))


def sst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_stats(_order_segments(spark, sf_dir), F.lit(4))


def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = sst_stats(spark, sf_dir).where("not is_active").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"))
    return compaction.cascade_level(sealed, LEVEL0, GROWTH)


def compact_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.merge_all(_puts(spark, sf_dir)).select("k", "v", "pos")


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event has a tier; later ones are higher up, but for every seventh user, whose events stay in the lower two."""
    high = F.col("k") % 7 != 0
    tier = F.when(high & (F.col("seq") >= 9000), -1).when(high & (F.col("seq") >= 5000), 0).when(F.col("seq") >= 2000, 1).otherwise(2)
    return _puts(spark, sf_dir).withColumn("tier", tier)


def read_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.newest_by_tier(_tiers(spark, sf_dir)).select("k", "v", "tier")


def read_amp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.amplification(_tiers(spark, sf_dir))


def _table(spark: SparkSession, name: str, key: str, value: str, **opts) -> KVTable:
    return KVTable.open(spark, paths.fresh(spark, "table"), name, key, value, Options(**opts))


def _parts(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows in n contiguous ranges of ``seq``."""
    top = rows.agg(F.max("seq")).first()[0] or 0
    step = top // n + 1
    return [rows.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)) for i in range(n)]


def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several log files, the writer gone, the log replayed by a new one."""
    t = _table(spark, "events", "bigint", "double")
    for part in _parts(_puts(spark, sf_dir), 4):
        t.put(part)
    again = KVTable.open(spark, t.root, "events", "bigint", "double")
    return resolve.newest(again.replay().select("k", "v", "seq"))


def wal_replay_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast: log files of 1000 events replayed newest first, so the oldest file wins."""
    rows = _puts(spark, sf_dir).withColumn("tier", F.floor(F.col("seq") / 1000))
    return resolve.newest_by_tier(rows).select("k", "v")


def compact_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs of level 0, merged down and read back."""
    t = _table(spark, "events", "bigint", "double", strategy=compaction.SizeTiered(16, 2))
    for part in _parts(_puts(spark, sf_dir), 4):
        t.put(part)
        t.flush()
    while t.compact():
        pass
    return t.snapshot()


def open_put_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: open, put, flush, put more, get many."""
    t = _table(spark, "events", "bigint", "double")
    first, second = _parts(_puts(spark, sf_dir), 2)
    t.put(first)
    t.flush()
    t.put(second)
    return t.multi_get(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, "events", "bigint", "double")
    first, second = _parts(_puts(spark, sf_dir), 2)
    t.put(first)
    t.flush()
    t.put(second)
    return t.get(7).union(t.get(-1))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by level: two runs and unflushed writes."""
    t = _table(spark, "events", "bigint", "double")
    a, b, c = _parts(_puts(spark, sf_dir), 3)
    for part in (a, b):
        t.put(part)
        t.flush()
    t.put(c)
    return t.history().groupBy("k", "level").agg(F.count("*").alias("versions"), F.max("seq").alias("max_seq"))


def streaming_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, "events", "bigint", "double")
    folder = paths.fresh(spark, "stream")
    for part in _parts(_puts(spark, sf_dir), 4):
        part.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema("seq bigint, k bigint, v double").option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream_into(source, t, paths.fresh(spark, "offsets"))
    query.awaitTermination()
    return t.snapshot()


def streaming_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the stream that come last hold the earliest writes."""
    t = _table(spark, "events", "bigint", "double")
    folders = []
    for part in reversed(_parts(_puts(spark, sf_dir), 4)):
        folders.append(paths.fresh(spark, "late"))
        part.coalesce(1).write.parquet(folders[-1])
    offsets = paths.fresh(spark, "offsets")
    for i, folder in enumerate(folders):
        source = spark.readStream.schema("seq bigint, k bigint, v double").parquet(folder)
        stream_into(source, t, f"{offsets}-{i}").awaitTermination()
    return t.snapshot()


def snapshot_across_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot made before the last writes, a flush and a merge is still that of its version."""
    t = _table(spark, "events", "bigint", "double", strategy=compaction.SizeTiered(16, 2))
    parts = _parts(_puts(spark, sf_dir), 4)
    for part in parts[:2]:
        t.put(part)
        t.flush()
    t.put(parts[2])
    before = t.snapshot()
    t.flush()
    t.put(parts[3])
    t.flush()
    while t.compact():
        pass
    return before


def reader_beside_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader opens between two writes of a writer and reads what was there."""
    t = _table(spark, "events", "bigint", "double")
    first, second = _parts(_puts(spark, sf_dir), 2)
    t.put(first)
    reader = KVTable.open(spark, t.root, "events", "bigint", "double", mode="read")
    t.put(second)
    t.flush()
    return reader.snapshot()


def gc_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "WRITE_START", "click": "WRITE_COMPLETE", "signup": "DELETE_START", "error": "DELETE_COMPLETE"}
    op = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type"))
    events = _t(spark, sf_dir, "events").where(F.col("event_type").isin(*names)).select(F.col("event_id").alias("seq"), F.col("user_id").alias("path_id"), op.alias("op"))
    return compaction.unfinished(events, "path_id")


def kv_string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("k"), F.col("p_retailprice").alias("v"))
    t = _table(spark, "part", "string", "double")
    t.put(rows)
    t.flush()
    return t.snapshot()


def kv_struct_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.struct("event_type", "value").alias("v"))
    t = _table(spark, "events", "bigint", "struct<event_type:string,value:double>", strategy=compaction.SizeTiered(16, 2))
    for part in _parts(rows, 2):
        t.put(part)
        t.flush()
    t.compact()
    return t.snapshot().select("k", "v.event_type", "v.value", "seq")


def oversize_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return segments.oversize(rows, F.octet_length("text").cast("long"), 1024).select("conv_id", "turn", "size_bytes")


def _simulated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = sst_stats(spark, sf_dir)
    return stats.select(F.lit("orders").alias("name"), F.lit(0).alias("level"), F.col("mem_id").alias("sst_id"), F.format_string("orders/level-0/sst-%d", "mem_id").alias("path"), F.col("size_bytes").alias("size"))


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows to their JSON shape and back: ids and sizes stay."""
    return catalog.from_view(catalog.to_view(_simulated_manifest(spark, sf_dir)))


def level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and bytes of each level, and its limit."""
    per = _simulated_manifest(spark, sf_dir).groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").cast("long").alias("size"))
    return per.withColumn("max_bytes", (LEVEL0 * F.greatest(F.col("level") * GROWTH, F.lit(1))).cast("long"))


def vacuum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run folders that no manifest names: one is planted."""
    t = _table(spark, "events", "bigint", "double")
    t.put(_puts(spark, sf_dir))
    t.flush()
    stray = catalog.run_path(t.root, "events", 0, 999)
    runs.write_run(_puts(spark, sf_dir).withColumn("size", F.lit(8)), stray)
    files = paths.file_sizes(spark, f"{t.root}/events", "*.parquet")
    return compaction.orphans(files, t.manifest()).select(F.regexp_extract("path", r"(level-\d+/sst-\d+)$", 1).alias("path"))


def dir_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a stored table and whether their lengths sum to the folder's size."""
    t = _table(spark, "events", "bigint", "double")
    t.put(_puts(spark, sf_dir))
    t.flush()
    files = paths.file_sizes(spark, f"{t.root}/events")
    total = paths.dir_size(spark, f"{t.root}/events")
    hidden = sum(paths.dir_size(spark, f"{r.path}/{f}") for r in t.m.runs for f in paths.children(spark, r.path) if f[0] in "._")
    return files.agg((F.sum("length") + hidden == total).alias("same"), (F.count("*") > 0).alias("some"))


_LATEST = "SELECT k, v, seq FROM (SELECT user_id AS k, value AS v, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1"
_STATUS = f"WITH latest AS ({_LATEST}) SELECT c_custkey AS k, l.v, CASE WHEN l.k IS NULL THEN 'io err: Key not found' END AS err FROM customer LEFT JOIN latest l ON c_custkey = l.k"
_SEG = f"SELECT o_orderkey AS k, o_custkey AS v, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / {SEGMENT // 4}.0) AS BIGINT) AS mem_id FROM orders"
_STATS = f"""WITH s AS ({_SEG}), x AS (SELECT max(mem_id) AS last FROM s)
SELECT mem_id, count(*) AS n, CAST(count(*) * 4 AS BIGINT) AS size_bytes, min(k) AS min_k, max(k) AS max_k, mem_id = (SELECT last FROM x) AS is_active FROM s GROUP BY mem_id"""
_TIER = """SELECT user_id AS k, value AS v, event_id AS seq, CASE WHEN user_id % 7 <> 0 AND event_id >= 9000 THEN -1
WHEN user_id % 7 <> 0 AND event_id >= 5000 THEN 0 WHEN event_id >= 2000 THEN 1 ELSE 2 END AS tier FROM events"""

QUERIES = {
    f.__name__: f
    for f in (
        put_log, upsert_lww, get_status, sizeof, sizeof_utf8, key_order, memtable_segments, memtable_segments_dup, flush_runs, sst_stats, compaction_plan,
        compact_bag, compact_lww, read_precedence, read_amp, wal_replay, wal_replay_newest_first, open_put_get, point_get, history, streaming_put, streaming_late, snapshot_across_compaction, reader_beside_writer, gc_rollback,
        kv_string_key, kv_struct_value, oversize_rejects, manifest_roundtrip, level_sizes, vacuum_candidates, dir_size,
    )
}

ORACLE_SQL = {
    "put_log": "SELECT event_id AS seq, user_id AS k, value AS v, 'WRITE' AS op FROM events",
    "upsert_lww": _LATEST,
    "wal_replay": _LATEST,
    "compact_lww": _LATEST,
    "streaming_put": _LATEST,
    "streaming_late": _LATEST,
    "snapshot_across_compaction": _LATEST.replace("FROM events", "FROM events WHERE event_id < 3 * (SELECT max(event_id) // 4 + 1 FROM events)"),
    "reader_beside_writer": _LATEST.replace("FROM events", "FROM events WHERE event_id < (SELECT max(event_id) // 2 + 1 FROM events)"),
    "get_status": _STATUS,
    "open_put_get": _STATUS,
    "point_get": f"WITH latest AS ({_LATEST}) SELECT p.k, l.v, CASE WHEN l.k IS NULL THEN 'io err: Key not found' END AS err FROM (VALUES (CAST(7 AS BIGINT)), (CAST(-1 AS BIGINT))) p(k) LEFT JOIN latest l ON p.k = l.k",
    "history": """WITH e AS (SELECT user_id AS k, event_id AS seq, event_id // (SELECT max(event_id) // 3 + 1 FROM events) AS part FROM events)
SELECT k, -1 AS level, count(*) AS versions, max(seq) AS max_seq FROM e WHERE part = 2 GROUP BY k
UNION ALL SELECT k, 0, count(DISTINCT part), max(seq) FROM e WHERE part < 2 GROUP BY k""",
    "sizeof": """SELECT c_custkey AS k, CAST(4 AS BIGINT) AS sz_int, CAST(octet_length(encode(c_name)) AS BIGINT) AS sz_str,
CAST(octet_length(encode(c_name)) + 8 AS BIGINT) AS sz_struct FROM customer""",
    "sizeof_utf8": "SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "key_order": "SELECT p_name AS k, CAST(dense_rank() OVER (ORDER BY p_name) AS BIGINT) AS pos FROM part",
    "memtable_segments": _SEG,
    "memtable_segments_dup": """WITH RECURSIVE p AS (SELECT event_id AS seq, user_id AS k FROM events),
f AS (SELECT seq, k, CAST(0 AS BIGINT) AS mem_id, [k] AS ks FROM p WHERE seq = 0
  UNION ALL SELECT p.seq, p.k, CASE WHEN (len(f.ks) + 1) * 4 > 256 THEN f.mem_id + 1 ELSE f.mem_id END,
    CASE WHEN (len(f.ks) + 1) * 4 > 256 THEN [p.k] WHEN list_contains(f.ks, p.k) THEN f.ks ELSE list_append(f.ks, p.k) END
  FROM f JOIN p ON p.seq = f.seq + 1)
SELECT seq, k, mem_id FROM f""",
    "flush_runs": f"WITH s AS ({_SEG}) SELECT mem_id, k, v, CAST(row_number() OVER (PARTITION BY mem_id ORDER BY k) - 1 AS BIGINT) AS pos FROM s",
    "sst_stats": _STATS,
    "compaction_plan": f"""WITH st AS ({_STATS}), l0 AS (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS sz FROM st WHERE NOT is_active),
lv AS (SELECT lvl, {LEVEL0} * greatest(lvl * {GROWTH}, 1) AS max_bytes FROM range(0, 100000) t(lvl))
SELECT min(lvl) AS final_level, min(sz) AS size_bytes FROM lv, l0 WHERE sz <= max_bytes""",
    "compact_bag": "SELECT user_id AS k, value AS v, CAST(row_number() OVER (ORDER BY user_id, event_id) - 1 AS BIGINT) AS pos FROM events",
    "read_precedence": f"SELECT k, v, tier FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, seq DESC) AS rn FROM ({_TIER})) WHERE rn = 1",
    "read_amp": f"SELECT k, count(*) AS versions, count(DISTINCT tier) AS tiers FROM ({_TIER}) GROUP BY k",
    "wal_replay_newest_first": """SELECT k, v FROM (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id
ORDER BY CAST(floor(event_id / 1000.0) AS BIGINT), event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "gc_rollback": """WITH ev AS (SELECT event_id AS seq, user_id AS path_id, CASE event_type WHEN 'view' THEN 'WRITE_START' WHEN 'click' THEN 'WRITE_COMPLETE'
  WHEN 'signup' THEN 'DELETE_START' WHEN 'error' THEN 'DELETE_COMPLETE' END AS op FROM events WHERE event_type IN ('view', 'click', 'signup', 'error')),
r AS (SELECT *, row_number() OVER (PARTITION BY path_id, split_part(op, '_', 1) ORDER BY seq DESC) AS rn FROM ev)
SELECT DISTINCT path_id FROM r WHERE rn = 1 AND op LIKE '%START'""",
    "kv_string_key": "SELECT k, v, seq FROM (SELECT p_name AS k, p_retailprice AS v, p_partkey AS seq, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1",
    "kv_struct_value": "SELECT k, event_type, value, seq FROM (SELECT user_id AS k, event_type, value, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "oversize_rejects": "SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM conversations WHERE octet_length(encode(text)) > 1024",
    "manifest_roundtrip": f"SELECT 'orders' AS name, 0 AS level, mem_id AS sst_id, 'orders/level-0/sst-' || mem_id AS path, size_bytes AS size FROM ({_STATS})",
    "level_sizes": f"SELECT 0 AS level, count(*) AS tables, CAST(sum(size_bytes) AS BIGINT) AS size, CAST({LEVEL0} AS BIGINT) AS max_bytes FROM ({_STATS})",
    "vacuum_candidates": "SELECT 'level-0/sst-999' AS path",
    "dir_size": "SELECT true AS same, true AS some",
}
