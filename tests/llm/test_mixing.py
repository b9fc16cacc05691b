import random
from collections import defaultdict
from fractions import Fraction

import pytest
from helpers import edge_rows, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import mixing as M


def ideal_shares(sources):
    """Blocks that the ideal mixture has taken of each source after each slot, stepped from one exhausted source to the next."""
    left, took, t = {s: Fraction(n) for s, n, _ in sources}, {s: Fraction(0) for s, *_ in sources}, Fraction(0)
    weight, total = {s: Fraction(w) for s, _, w in sources}, sum(n for _, n, _ in sources)
    out = [dict(took)]
    while len(out) <= total:
        live = sum(weight[s] for s in left if left[s])
        step = min([len(out) - t, *(left[s] * live / weight[s] for s in left if left[s])])
        for s in left:
            if left[s]:
                took[s] += step * weight[s] / live
                left[s] -= step * weight[s] / live
        t += step
        if t == len(out):
            out.append(dict(took))
    return out


@given(st.lists(st.tuples(st.integers(1, 40), st.floats(1e-3, 1e3)), min_size=1, max_size=7))
@settings(max_examples=80, deadline=None)
def test_windows_hold_and_sources_are_less_than_a_block_off(rows):
    sources = [(f"s{i}", n, w) for i, (n, w) in enumerate(rows)]
    ideal = M.Ideal(sources)
    got, total = list(M.schedule(ideal)), sum(n for n, _ in rows)
    assert [g[5] for g in got] == list(range(total))
    assert all(release <= slot < deadline for _, _, _, release, deadline, slot in got)
    want, seen = ideal_shares(sources), defaultdict(int)
    for i, k, *_, slot in got:
        s = ideal.names[i]
        assert k == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - want[slot + 1][x]) < 1 for x, *_ in sources)


def test_earliest_deadline_first_of_the_released_blocks():
    """A plain scheduler over all blocks, slot by slot."""
    rng = random.Random(3)
    for _ in range(20):
        ideal = M.Ideal([(f"s{i}", rng.randrange(1, 30), rng.random() + 0.01) for i in range(rng.randrange(1, 6))])
        got = list(M.schedule(ideal))
        jobs = {(i, k): (release, deadline) for i, k, _, release, deadline, _ in got}
        for *_, slot in got:
            i, k = min((job for job in jobs if jobs[job][0] <= slot), key=lambda job: (jobs[job][1], job))
            assert got[slot][:2] == (i, k)
            del jobs[i, k]


def test_given_weights_over_a_million_slots():
    given_ = {"a": 0.3333333, "b": 0.00001, "c": 0.6666567}
    total = sum(map(Fraction, given_.values()))
    ideal, seen, n = M.Ideal([(s, 2_000_000, w) for s, w in given_.items()]), [0, 0, 0], 0
    share = [Fraction(given_[s]) / total for s in ideal.names]
    for i, *_ in M.schedule(ideal):
        seen[i], n = seen[i] + 1, n + 1
        if n % 997 == 0:
            assert all(abs(x - w * n) < 1 for x, w in zip(seen, share))
        if n == 1_000_000:
            break
    assert n == 1_000_000


def test_many_sources():
    got = list(M.schedule(M.Ideal([(f"s{i}", 1 + i % 3, 1.0 + i % 11) for i in range(30_000)])))
    assert len(got) == 60_000 and all(r <= s < d for *_, r, d, s in got)


def test_documents_keep_whole_and_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(0, 60), "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(300)] + edge_rows("y" * 500)
    docs = frame(spark, rows).withColumn("slot", F.lit("clash"))
    got = M.mix_sources(docs, {"a": 1.0, "b": 2.0}, block_bytes=100).collect()
    assert len(got) == len(rows) and {"release", "deadline", "doc_id", "text"} <= set(got[0].asDict())
    at = defaultdict(list)
    for r in got:
        assert r.release <= r.slot < r.deadline
        at[r.source].append((r.offset, r.block, len((r.text or "").encode())))
    for rs in at.values():
        rs.sort(key=lambda r: (r[0], r[2]))
        total = 0
        for offset, block, n in rs:
            assert offset == total and block <= offset // 100
            total += n
    assert M.mix_sources(frame(spark, [])).count() == 0
    assert M.mix_sources(frame(spark, []), ordered=True).count() == 0


def test_many_equal_rows_are_numbered_and_fill_their_blocks(spark):
    docs = frame(spark, [(1, "z" * 30, "en", "a", 1)] * 40 + [(2, "q" * 7, "en", "a", 1)]).repartition(5)
    got = M.mix_sources(docs, block_bytes=100).collect()
    assert len(got) == 41
    (other,) = [r.offset for r in got if r.doc_id == 2]
    first = 0 if other else 7
    assert sorted(r.offset for r in got if r.doc_id == 1) == [first + 30 * i for i in range(40)]
    assert all(r.slot == r.block == min(r.offset // 100, 12) for r in got)


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_ordered_rows_are_written_in_order(spark, tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(M, "PART_BYTES", part_bytes)
    docs = frame(spark, [(i, "z" * (i % 37), "en", "abc"[i % 3], 1) for i in range(200)])
    M.mix_sources(docs, block_bytes=50, ordered=True).write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).select("*", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r.doc_id for r in back] == [r.doc_id for r in sorted(back, key=lambda r: (r.slot, r.source, r.offset, r.doc_id))]


def test_pieces_do_not_change_the_ranks(spark, monkeypatch):
    docs = frame(spark, [(i, "z" * (i % 7), "en", "a", 1) for i in range(200)])
    key = lambda d: sorted((r.doc_id, r.slot, r.offset) for r in d.collect())
    whole = key(M.mix_sources(docs, block_bytes=50))
    monkeypatch.setattr(M, "RANKED_ROWS", 10)
    assert key(M.mix_sources(docs, block_bytes=50)) == whole
