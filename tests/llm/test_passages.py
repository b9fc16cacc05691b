import random
from collections import defaultdict

import pytest
from helpers import edge_rows, frame, prose, vocabulary
from pyspark.sql import functions as F

from siltstone.llm import passages as P


def brute(rows):
    n, seen = P.MIN_WORDS, defaultdict(set)
    texts = [(r[0], (r[1] or "").split()) for r in rows if r[0] is not None]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(d)
    out = set()
    for d, w in texts:
        spans = [[i, i + n] for i in range(len(w) - n + 1) if len(seen[tuple(w[i : i + n])]) > 1]
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        out |= {(d, a, b) for a, b in merged}
    return out


def test_equals_brute_force(spark):
    rng, words = random.Random(13), vocabulary(900)
    parts = [prose(rng, rng.randrange(30, 200), words).split() for _ in range(14)]
    rows = []
    for i in range(90):
        w = prose(rng, rng.randrange(0, 60), words).split()
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(parts)
            a = rng.randrange(0, max(1, len(p) - 40))
            w += p[a : a + rng.randrange(20, 200)] + prose(rng, rng.randrange(0, 9), words).split()
        rows.append((i, " ".join(w), "en", "s", 1))
    one = prose(rng, 60, words)
    rows += [(200, one + " sep1 " + one, "en", "s", 1)]  # repeats within one text alone
    rows += [(201, "la " * 300, "en", "s", 1), (202, "la " * 80 + "end1", "en", "s", 1)]
    rows += edge_rows("w " * 3000)
    docs = frame(spark, rows).withColumn("place", F.lit("clash")).withColumn("other", F.lit(1))
    got = P.repeated_passages(docs).collect()
    spans = [(r.doc_id, r.start_word, r.end_word) for r in got]
    assert len(spans) == len(set(spans)) and set(spans) == brute(rows) and len(spans) > 60
    assert all(r.n_words == r.end_word - r.start_word >= P.MIN_WORDS and r.other_doc_id != r.doc_id for r in got)


def test_repeated_rows_and_empty(spark):
    rng, words = random.Random(1), vocabulary(500)
    t, u = prose(rng, 80, words), prose(rng, 120, words)
    assert P.repeated_passages(frame(spark, [(1, t), (1, t)])).count() == 0
    assert P.repeated_passages(frame(spark, [])).count() == 0
    got = P.repeated_passages(frame(spark, [(1, t), (1, u), (2, u)])).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(1, 0, 120), (2, 0, 120)}


@pytest.mark.parametrize("size", [5, 40, 10**6])
def test_neighbours_across_ranges(spark, monkeypatch, size):
    """Against a sorted list: the nearest suffix of another text before, for the first text of a beginning the one behind."""
    monkeypatch.setattr(P, "SORTED_AT_ONCE", size)
    rng = random.Random(size)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, rng.randrange(40)]), rng.randrange(3), rng.randrange(5 if rng.random() < 0.5 else 40), rng.randrange(60)) for _ in range(300)})
    got = {(r.prefix, r.doc_id, r.place): (r.other, r.there, r.first) for r in P.neighbours(spark.createDataFrame(rows, "prefix bigint, tail bigint, doc_id bigint, place int")).collect()}
    want = {}
    for i, (prefix, _, doc, place) in enumerate(rows):
        before = [(d, p) for q, _, d, p in rows[:i] if q == prefix and d != doc]
        first_run = not before
        after = [(d, p) for q, _, d, p in rows[i:] if q == prefix and d != doc]
        if before or after:
            want[prefix, doc, place] = (*(before[-1] if before else after[0]), first_run)
    keys = [(q, d, p) for q, _, d, p in rows]
    once = {k for k in keys if keys.count(k) == 1}  # a place has one suffix
    assert set(got) == set(want) and {k: got[k] for k in once & set(got)} == {k: want[k] for k in once & set(want)}


def test_a_line_that_a_third_of_all_texts_repeat(spark):
    rng, words = random.Random(3), vocabulary(900)
    line = prose(rng, 60, words)
    rows = [(i, " ".join([prose(rng, rng.randrange(0, 50), words)] + [line] * rng.randrange(1, 6) if i % 3 == 0 else [prose(rng, 90, words)]), "en", "s", 1) for i in range(120)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in P.repeated_passages(frame(spark, rows)).collect()}
    assert got == brute(rows) and len(got) >= 40
