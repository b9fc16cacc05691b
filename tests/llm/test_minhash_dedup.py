import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import edge_rows, edited, frame, prose, vocabulary
from pyspark.sql import functions as F

from siltstone.llm import minhash_dedup as M
from siltstone.llm import tokens as T


def features(spark, rows):
    w = M.frequent_shingles(frame(spark, rows))
    h, at, *_ = T.words(pa.array([r[1] for r in rows], pa.string()))
    g, n, off = T.distinct_counts(*T.shingles(h, at, M.SHINGLE_WORDS))
    x = w.of(g, n)
    return [(g[a:b], x[a:b]) for a, b in zip(off[:-1], off[1:])]


def brute(spark, rows):
    f, parent = features(spark, rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations([(k, r[0]) for k, r in enumerate(rows) if r[0] is not None], 2):
        if a == b or (len(f[i][0]) and len(f[j][0]) and M.weighted_jaccard(f[i], f[j]) >= M.MIN_JACCARD - 1e-12):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def corpus(seed=11, base=12):
    rng, words = random.Random(seed), vocabulary(2500)
    rows, common = [], prose(rng, 30, words)
    for _ in range(base):
        text = prose(rng, rng.randrange(40, 160), words)
        for share in (0, 0, 0.005, 0.01, 0.03, 0.1):
            if rng.random() < 0.8:
                rows.append((len(rows), edited(rng, text, share, words)))
    rows += [(len(rows) + i, prose(rng, 25, words) + " " + common) for i in range(20)]  # share a passage, are no copies
    rows.append((len(rows), "two words"))
    rows.append((len(rows), "two words"))
    return [(a, b, "en", "s", 1) for a, b in rows]


def test_equals_brute_force(spark):
    rows = corpus() + edge_rows("q r " * 3000)
    docs = frame(spark, rows).withColumn("class_id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = M.near_duplicates(docs).collect()
    want = brute(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == (None if r.doc_id is None else want[r.doc_id]), r
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("block", [3, 1024])
def test_rivals_in_blocks(spark, monkeypatch, block):
    """A bucket whose leader is unlike the others: their links come from the blocks."""
    rng, words = random.Random(2), vocabulary(2000)
    a, b = prose(rng, 200, words), prose(rng, 200, words)
    texts = [(0, prose(rng, 200, words)), *((i, edited(rng, a, 0.004, words)) for i in range(1, 8)), *((i, edited(rng, b, 0.004, words)) for i in range(8, 12))]
    monkeypatch.setattr(M, "BLOCK", block)
    frame_ = spark.createDataFrame(texts, "doc_id bigint, text string")
    left = spark.createDataFrame([(5, i, True, 0.9, i) for i in range(12)], "bucket bigint, member bigint, far boolean, distance double, component bigint")
    weights = spark.sparkContext.broadcast(M.Weights([], 12))
    links = {(r.a, r.b) for r in M.rival_links(left, frame_, weights).collect()}
    from siltstone.llm.shared import components

    edges = spark.createDataFrame(list(links), "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges, "t").collect()}
    assert got == {i: 1 for i in range(1, 8)} | {i: 8 for i in range(8, 12)}


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    pool = M._draws()
    g = T.mix(np.arange(1, 401, dtype=np.uint64))
    a, b = rng.choice([1.0, 2.0, 4.0], 400), rng.choice([1.0, 2.0, 4.0], 400)
    a[:80], b[-80:] = 0, 0
    same = 0
    for k in range(M.SAMPLES):
        slot = (g * M._ODD[k]) >> np.uint64(48)
        low = g & np.uint64(0xFFFFFFFF)
        s = [np.min((M._sample(slot[w > 0], np.log(w[w > 0])) | low[w > 0])) for w in (a, b)]
        same += s[0] == s[1]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert pool["plain"].dtype == np.uint64 and abs(same / M.SAMPLES - want) < 4 * np.sqrt(want * (1 - want) / M.SAMPLES)


def test_frequent_shingles_weigh_less(spark):
    line = "these ten words stand in each one of the texts"
    rng, words = random.Random(5), vocabulary(4000)
    rows = [(i, line + " " + prose(rng, 20, words), "en", "s", 1) for i in range(50)]
    f = features(spark, rows)
    assert sorted(set(np.round(np.concatenate([w for _, w in f]), 6))) == [1.0, 2.0]


def test_empty_and_wordless(spark):
    assert M.near_duplicates(frame(spark, [])).count() == 0
    got = M.near_duplicates(frame(spark, [(1, ""), (2, None), (3, " "), (4, "")])).collect()
    assert all(r.kept and r.class_id == r.doc_id for r in got)


@pytest.mark.parametrize("parts", [1, 64])
def test_weights_are_exact_in_every_layout(spark, monkeypatch, parts):
    monkeypatch.setattr(M, "COUNTED_TEXTS", 30)  # 400 texts in 13 tasks at most, in batches of a few texts
    monkeypatch.setattr(M, "COUNTED_AT_ONCE", 200)
    rng, words = random.Random(21), vocabulary(4000)
    lines = [prose(rng, 6, words) for _ in range(3)]
    rows = [(i, " ".join([prose(rng, 20, words)] + [line for line, share in zip(lines, (2, 10, 200)) if i % share == 0])) for i in range(400)]
    docs = frame(spark, rows).repartition(parts)
    counts = {}
    for _, text in rows:
        w = text.split()
        for g in {tuple(w[i : i + 5]) for i in range(len(w) - 4)}:
            counts[g] = counts.get(g, 0) + 1
    got = M.frequent_shingles(docs)
    want = {}
    for g, n in counts.items():
        if n >= 2:
            h, at, *_ = T.words(pa.array([" ".join(g)]))
            want[int(T.shingles(h, at, 5)[0][0])] = 1 + np.log(1 / max(n / 400, M.RARE_SHARE)) / np.log(1 / M.RARE_SHARE)
    assert len(want) >= 4 and dict(zip(got.table.tolist(), got.idf.tolist())) == pytest.approx(want)


def test_classes_do_not_depend_on_the_layout(spark):
    docs = frame(spark, corpus(seed=31))
    got = [sorted(map(tuple, M.near_duplicates(docs.repartition(n)).collect())) for n in (1, 64)]
    assert got[0] == got[1]
