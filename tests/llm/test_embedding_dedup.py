import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import embedding_dedup as E

KIND = "vec_id bigint, embedding array<float>, label int"


def data(n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, d))
    rows = []
    for i in range(n):
        v = (base[rng.integers(20)] + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.1])).astype(np.float32)
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    return rows


ODD = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] + [1.0] * 7, 1), (1003, [float("inf")] + [1.0] * 7, 1), (1004, [None] + [1.0] * 7, 1), (1005, [1.0] * 8, None), (1006, [], 1), (1007, [2.0] * 8, 2), (1008, [4.0] * 8, 2), (1009, [1.0] * 8, 2)]


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            a = np.array(v, float)
            ok[i] = (a / np.linalg.norm(a), label)
    links, parent = dict.fromkeys((r[0] for r in rows), 0), {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(ok)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if ok[i][1] == ok[j][1] and ok[i][0] @ ok[j][0] >= E.MIN_COSINE:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], root(i), root(i) == i) for i in links}


@pytest.mark.parametrize("cell,block", [(4000, 4096), (15, 7)])
def test_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = data() + ODD
    df = spark.createDataFrame(rows, KIND).withColumn("cell", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_groups(df).collect()}
    assert got == brute(rows)
    assert sum(n > 0 for n, *_ in got.values()) > 100


def test_centroids_are_unit_and_cells_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = E.spherical_kmeans(x, 6)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)


def test_repeated_ids_and_empty(spark):
    got = E.embedding_groups(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], KIND)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert E.embedding_groups(spark.createDataFrame([], KIND)).count() == 0


def test_components_in_double_precision(spark):
    """Two vectors that single precision would make equal to a third are apart at a threshold that only doubles can tell."""
    a, b = [1.0, 0.0], [1.0, 2e-5]
    df = spark.createDataFrame([(1, a, 0), (2, b, 0), (3, [1.0, 1e-12], 0)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in E.embedding_groups(df, min_cosine=1 - 1e-10).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_unit_rows_equal_plain_code():
    import pyarrow as pa

    rows = [[3.0, 4.0], None, [], [0.0, 0.0], [1.0, None], [float("inf"), 1.0], [float("nan")], [2.0], [1.0, 2.0, 2.0]]
    for column in (pa.array(rows, pa.list_(pa.float32())), pa.array([[9.0], *rows], pa.list_(pa.float64())).slice(1)):
        x, ok = E.unit_rows(column)
        assert ok.tolist() == [True, False, False, False, False, False, False, True, True]
        assert np.allclose(x[ok], [[0.6, 0.8, 0], [1, 0, 0], [1 / 3, 2 / 3, 2 / 3]])
