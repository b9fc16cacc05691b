import random

from siltstone.llm.shared import components


def test_equals_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 440)] + [(500, x) for x in range(501, 560)] + [(5, 5), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    assert got == {i: root(i) for i in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0
