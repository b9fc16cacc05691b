import random

import pytest

from siltstone.errors import CommitConflict, LogDisabled, LogMissing, TableError
from siltstone.operators.compaction import SizeTiered
from siltstone.sources import manifest as catalog
from siltstone.sources import paths, runs
from siltstone.table import KVTable, Options

SMALL = Options(memtable_threshold=1 << 30, strategy=SizeTiered(64, 2))


def puts(spark, rows, value="int"):
    return spark.createDataFrame(rows, f"seq bigint, k bigint, v {value}")


def state(df):
    return {r.k: r.v for r in df.collect()}


def test_put_get_and_miss(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a")
    assert t.put(puts(spark, [(0, 278, 267)])).n_written == 1
    assert [tuple(r) for r in t.get(278).collect()] == [(278, 267, None)]
    assert [tuple(r) for r in t.get(5).collect()] == [(5, None, "io err: Key not found")]


def test_point_get_equals_multi_get(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a")
    t.put(puts(spark, [(i, i % 40, i) for i in range(100)]))
    t.flush()
    t.put(puts(spark, [(100 + i, i, -i) for i in range(10)]))
    many = {r.k: (r.v, r.err) for r in t.multi_get(spark.createDataFrame([(3,), (30,), (77,)], "k bigint")).collect()}
    for k in (3, 30, 77):
        r = t.get(k).first()
        assert (r.v, r.err) == many[k]


def test_random_writes_match_a_dict(spark, tmp_path):
    rng, model, seq = random.Random(5), {}, 0
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    for step in range(8):
        rows = []
        for _ in range(rng.randrange(1, 30)):
            k, v = rng.randrange(25), rng.randrange(1000)
            rows.append((seq, k, v))
            model[k], seq = v, seq + 1
        rng.shuffle(rows)
        t.put(puts(spark, rows))
        if step % 2:
            t.flush()
        if step == 5:
            t.compact()
        if step == 6:
            t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
        assert state(t.snapshot()) == model
    newest = {}
    for r in t.history().collect():
        if r.k not in newest or r.seq > newest[r.k][0]:
            newest[r.k] = (r.seq, r.v)
    assert {k: v for k, (_, v) in newest.items()} == model


def test_runs_are_sorted_and_sizes_hold(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    t.put(puts(spark, [(i, (i * 37) % 101, i) for i in range(101)]))
    t.flush()
    (run,) = t.level(0)
    assert (run.n, run.size, run.max_seq) == (101, 404, 100)
    keys = [r.k for f in sorted(spark.read.parquet(run.path).inputFiles()) for r in spark.read.parquet(f).collect()]
    assert keys == sorted(keys)
    assert catalog.load(spark, str(tmp_path), "a").runs == t.m.runs


def test_threshold_flushes_and_cascade_writes_once(spark, tmp_path):
    opts = Options(memtable_threshold=1024, strategy=SizeTiered(2048, 2), compaction=False)
    t = KVTable.open(spark, str(tmp_path), "a", opts=opts)
    for i in range(10):
        assert t.put(puts(spark, [(i * 256 + j, i * 256 + j, j) for j in range(256)])).flushed
    assert t.m.level_size(0) == 10240
    report = t.compact()
    assert report.level == 3 and t.m.level_size(3) == 10240 and not t.level(0)
    assert t.get(244).first().v == 244
    assert t.compact() is None


def test_merge_keeps_newest_or_all(spark, tmp_path):
    for merge, n in (("newest", 10), ("all", 30)):
        t = KVTable.open(spark, str(tmp_path / merge), "a", opts=Options(strategy=SizeTiered(16, 2), merge=merge))
        for i in range(3):
            t.put(puts(spark, [(i * 10 + j, j, i) for j in range(10)]))
            t.flush()
        before = state(t.snapshot())
        assert t.compact().rows == n
        assert state(t.snapshot()) == before == {j: 2 for j in range(10)}


def test_log_replay_after_loss(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a")
    for i in range(3):
        t.put(puts(spark, [(i * 100 + j, j, i) for j in range(100)]))
    again = KVTable.open(spark, str(tmp_path), "a")
    assert again.replay().count() == 300
    assert state(again.snapshot()) == {j: 2 for j in range(100)}
    assert again.m.next_seq == 300
    again.flush()
    assert KVTable.open(spark, str(tmp_path), "a").batches == []


def test_without_log(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=Options(wal=False))
    t.put(puts(spark, [(0, 1, 2)]))
    assert state(t.snapshot()) == {1: 2}
    with pytest.raises(LogDisabled):
        t.replay()
    t.flush()
    assert state(KVTable.open(spark, str(tmp_path), "a").snapshot()) == {1: 2}


def test_missing_log_and_levels(spark, tmp_path):
    with pytest.raises(LogMissing):
        runs.replay_log(spark, str(tmp_path / "none"), "seq bigint")
    t = KVTable.open(spark, str(tmp_path), "a")
    for number in (-1, 10):
        with pytest.raises(TableError):
            t.level(number)


def test_refusals(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a")
    with pytest.raises(TableError):
        t.put(spark.createDataFrame([(0, None, 1)], "seq bigint, k bigint, v int"))
    with pytest.raises(TableError):
        t.put(spark.createDataFrame([("x", 1)], "k string, v int"), order_by="k")
    t.put(puts(spark, [(0, 1, 1)]))
    with pytest.raises(TableError):
        t.put(puts(spark, [(0, 1, 2)]))
    with pytest.raises(TableError):
        KVTable.open(spark, str(tmp_path), "a", key="string")
    assert t.put(puts(spark, [])).n_written == 0


def test_oversize_values(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "é" * 10), (1, "b", ""), (2, "c", None)], "seq bigint, k string, v string")
    t = KVTable.open(spark, str(tmp_path), "a", "string", "string", Options(memtable_threshold=19, oversize="reject"))
    got = t.put(rows)
    assert (got.n_written, got.n_rejected) == (2, 1)
    assert state(t.snapshot()) == {"b": "", "c": None}


def test_order_by_column_and_struct_values(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", "bigint", "struct<name:string,age:bigint>", SMALL)
    rows = spark.createDataFrame([(10, ("a", 1), 5), (10, ("b", 2), 9), (10, ("c", 3), 7)], "k bigint, v struct<name: string, age: bigint>, at int")
    t.put(rows, order_by="at")
    t.flush()
    assert t.get(10).first().v.name == "b" and t.level(0)[0].size == 9


def test_second_writer_conflicts(spark, tmp_path):
    a, b = (KVTable.open(spark, str(tmp_path), "a", opts=Options(wal=False)) for _ in range(2))
    for t in (a, b):
        t.put(puts(spark, [(0, 1, 1)]))
    a.flush()
    with pytest.raises(CommitConflict):
        b.flush()


def test_interrupted_merge_is_cleaned(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    t.put(puts(spark, [(0, 1, 1)]))
    t.flush()
    stray = catalog.run_path(t.root, "a", 1, 77)
    t._event(stray, "WRITE_START")
    runs.write_run(spark.createDataFrame([(1, 1, 1, 4)], "k bigint, v int, seq bigint, size bigint"), stray)
    again = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    assert not paths.exists(spark, stray) and state(again.snapshot()) == {1: 1}
    assert again.recover() == []


def test_manifest_views_keep_ids(spark):
    m = catalog.Manifest("m").with_runs([catalog.Run(0, 17, "p17", 5), catalog.Run(2, 3, "p3", 9)])
    back = catalog.from_view(spark.createDataFrame([(m.view_json(),)], "json string"))
    assert {tuple(r) for r in back.collect()} == {("m", 0, 17, "p17", 5), ("m", 2, 3, "p3", 9)}
    text = catalog.to_view(back)
    assert {tuple(r) for r in catalog.from_view(text).collect()} == {tuple(r) for r in back.collect()}
    assert catalog.run_path("r", "n", -1, 2) == "" and catalog.level_path("r", "n", 3) == "r/n/level-3"


def test_pruning_by_bounds(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    for i in range(3):
        t.put(puts(spark, [(i * 10 + j, i * 10 + j, j) for j in range(10)]))
        t.flush()
    assert [r.sst_id for r in t._runs_for(15)] == [1]
    plan = t.get(15)._jdf.queryExecution().toString()
    assert "EqualTo(k,15)" in plan


def test_bounds_of_other_key_types(spark, tmp_path):
    import datetime

    t = KVTable.open(spark, str(tmp_path), "a", "date", "string", SMALL)
    day = lambda i: datetime.date(2020, 1, i)
    for i in (0, 1):
        t.put(spark.createDataFrame([(i * 5 + j, day(1 + i * 5 + j), str(j)) for j in range(5)], "seq bigint, k date, v string"))
        t.flush()
    assert [r.sst_id for r in t._runs_for(day(7))] == [1] and t.get(day(7)).first().v == "1"
    s = KVTable.open(spark, str(tmp_path), "s", "string", "int", SMALL)
    s.put(spark.createDataFrame([(0, "a", 1), (1, "é", 2), (2, "Z", 3)], "seq bigint, k string, v int"))
    s.flush()
    assert [s.get(k).first().v for k in ("a", "é", "Z", "b")] == [1, 2, 3, None]


def test_a_reader_leaves_a_writers_run_alone(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    t.put(puts(spark, [(0, 1, 1)]))
    reader = KVTable.open(spark, str(tmp_path), "a", opts=SMALL, mode="read")
    run = t._write(t._unflushed(), 0, 4, 1)  # in the middle of a flush
    other = KVTable.open(spark, str(tmp_path), "a", opts=SMALL, mode="read")
    assert paths.exists(spark, run.path) and state(reader.snapshot()) == state(other.snapshot()) == {1: 1}
    t.flush()
    assert state(reader.refresh().snapshot()) == {1: 1} and reader.m.version == t.m.version
    for call in (lambda: reader.put(puts(spark, [(9, 1, 1)])), reader.flush, reader.compact, reader.vacuum):
        with pytest.raises(TableError):
            call()
    with pytest.raises(TableError):
        KVTable.open(spark, str(tmp_path), "none", mode="read")


def test_a_second_writer_that_cleans_up_fences_the_first(spark, tmp_path):
    a = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    a.put(puts(spark, [(0, 1, 1)]))
    a._write(a._unflushed(), 0, 4, 1)  # in the middle of a flush
    b = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    with pytest.raises(CommitConflict):
        a.flush()
    b.flush()
    assert state(KVTable.open(spark, str(tmp_path), "a", mode="read").snapshot()) == {1: 1}


def test_frames_keep_their_version(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    t.put(puts(spark, [(i, i, 0) for i in range(20)]))
    unflushed, one = t.snapshot(), t.get(3)
    t.flush()
    t.put(puts(spark, [(20 + i, i, 1) for i in range(20)]))
    t.flush()
    two = t.snapshot()
    while t.compact():
        pass
    assert state(unflushed) == {i: 0 for i in range(20)} and one.first().v == 0 and state(two) == {i: 1 for i in range(20)}
    assert [r.path for r in t.m.runs] and len(t.m.retired) >= 3
    assert t.vacuum() == [] and len(t.vacuum(retain=0)) >= 3 and t.m.retired == ()
    assert state(t.snapshot()) == {i: 1 for i in range(20)}
    assert state(KVTable.open(spark, str(tmp_path), "a", opts=SMALL).snapshot()) == {i: 1 for i in range(20)}


def test_null_keys_miss(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a")
    t.put(puts(spark, [(0, 1, 1)]))
    assert [tuple(r) for r in t.get(None).collect()] == [(None, None, "io err: Key not found")]
    t.flush()
    assert {tuple(r) for r in t.multi_get(spark.createDataFrame([(None,), (1,)], "k bigint")).collect()} == {(None, None, "io err: Key not found"), (1, 1, None)}
    assert t.multi_get(spark.createDataFrame([], "k bigint")).count() == 0


def test_late_and_repeated_batches(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a")
    new, old = puts(spark, [(100 + i, i, 1) for i in range(30)]), puts(spark, [(i, i, 0) for i in range(40)])
    assert t.put(new, late=True, token="s/0").n_written == 30
    assert t.put(old, late=True, token="s/1").n_written == 40
    assert t.put(old, late=True, token="s/1").n_written == 0
    want = {i: int(i < 30) for i in range(40)}
    assert state(t.snapshot()) == want
    again = KVTable.open(spark, str(tmp_path), "a")
    assert again.put(old, late=True, token="s/1").n_written == 0
    again.flush()
    assert again.put(old, late=True, token="s/1").n_written == 0 and state(again.snapshot()) == want
    top = again._claims()
    again._claim("s/2", 50)  # claimed, then the writer is lost before the log has it, and others write and flush
    again.put(puts(spark, [(500, 99, 9)]))
    again.flush()
    last = KVTable.open(spark, str(tmp_path), "a")
    assert last.put(puts(spark, [(600, 98, 8)]), late=True, token="s/2").n_written == 1
    assert state(last.snapshot()) == want | {99: 9, 98: 8} and len(last._claims()) <= len(top) + 1


def test_unflushed_bytes_are_counted_and_found_again(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    for i in range(3):
        t.put(puts(spark, [(i * 10 + j, j, 1) for j in range(10)]))
    assert t.unflushed_bytes() == 120 == KVTable.open(spark, str(tmp_path), "a", opts=SMALL).unflushed_bytes()
    t.flush()
    assert t.unflushed_bytes() == 0


def test_readers_in_threads_beside_a_writer(spark, tmp_path):
    """Each read sees whole versions: the values of all keys come from one write or a later one, never from an earlier."""
    from concurrent.futures import ThreadPoolExecutor

    t = KVTable.open(spark, str(tmp_path), "a", opts=SMALL)
    t.put(puts(spark, [(i, i, 0) for i in range(50)]))
    t.compact_every(0.2)

    def read(n: int) -> list[int]:
        reader = KVTable.open(spark, str(tmp_path), "a", opts=SMALL, mode="read")
        seen = []
        for _ in range(4):
            got = state(reader.refresh().snapshot())
            assert sorted(got) == list(range(50)) and len(set(got.values())) == 1
            assert reader.get(n).first().v >= got[n]
            seen.append(got[n])
        return seen

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(read, n) for n in range(4)]
        for step in range(1, 6):
            t.put(puts(spark, [(step * 50 + i, i, step) for i in range(50)]))
            t.flush()
        for job in jobs:
            assert job.result() == sorted(job.result())
    t.close()
    assert set(state(t.snapshot()).values()) == {5}
