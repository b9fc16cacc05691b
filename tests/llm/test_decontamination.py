import random

import numpy as np
import pyarrow as pa
from helpers import edge_rows, edited, frame, prose, vocabulary
from pyspark.sql import functions as F

from siltstone.llm import decontamination as D


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
    return max(map(max, h))


def test_alignment_equals_the_table():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        score, first, end = D.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[first:end]) == score


def test_exact_and_edited_copies(spark):
    rng, words = random.Random(6), vocabulary(3000)
    items = [(i, prose(rng, 40, words)) for i in range(12)]
    rows, want = edge_rows(), set()
    for i in range(60):
        text = prose(rng, 120, words)
        if i % 2:
            item = items[i % 12]
            passage = item[1] if i % 4 == 1 else edited(rng, item[1], 0.12, words)
            text = text + " " + passage.upper() + ".\n" + prose(rng, 50, words)
            want.add((i, item[0]))
        rows.append((i, text, "en", "s", 1))
    bench = spark.createDataFrame(items + [(None, "x y z"), (50, None), (51, ""), (52, "of the")], "item_id bigint, text string")
    docs = frame(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1))
    got = D.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all((r.score == 1.0) == (r.doc_id % 4 == 1) for r in got)
    assert all(abs(r.start_word - 120) <= 3 for r in got)
    kept = {r.doc_id for r in D.decontaminated(docs, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_item_in_most_texts_and_blocks(spark, monkeypatch):
    rng, words = random.Random(7), vocabulary(2000)
    item, other = prose(rng, 30, words), prose(rng, 30, words)
    docs = frame(spark, [(i, prose(rng, 20, words) + " " + item) for i in range(40)] + [(99, other)])
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id bigint, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == {(i, 1) for i in range(40)} | {(99, 2)}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(frame(spark, [(1, "a b c")]), bench).count() == 0
    assert D.contaminated(frame(spark, []), spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")).count() == 0


def test_search_against_all_alignments(spark):
    """Seeds find nothing that plain alignment of all pairs does not, and most of it: all copies up to 10 % of edits, and of those over the score at 20 to 40 %, 0.9."""
    rng, words = random.Random(11), vocabulary(1500)
    weighted = lambda n: " ".join(words[min(int(rng.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(n))  # noqa: E731  frequent words among rare ones

    def altered(text, share):
        out = []
        for w in text.split():
            x = rng.random()
            out += [w] if x >= share else rng.choice([[], [rng.choice(words)], [w, rng.choice(words)]])
        return " ".join(out)

    items, rows, rate = [(i, weighted(rng.randrange(12, 40))) for i in range(15)], [], {}
    for i in range(250):
        rate[i] = (i % 5) / 10
        rows.append((i, " ".join([weighted(25), altered(items[i % 15][1], rate[i]), weighted(25)]), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame(spark, rows), bench).collect()}
    it, want = D.Items(*map(list, zip(*items))), set()
    for doc, text, *_ in rows:
        h = D.words(pa.array([text]))[0]
        want |= {(doc, it.ids[i]) for i, w in enumerate(it.words) if D.smith_waterman(w, h)[0] >= D.MIN_SCORE * D.MATCH * len(w)}
    assert got <= want
    recall = {r: (len({p for p in want & got if rate[p[0]] == r}), len({p for p in want if rate[p[0]] == r})) for r in sorted(set(rate.values()))}
    print(recall)
    assert all(a == b for r, (a, b) in recall.items() if r <= 0.1) and sum(a for r, (a, _) in recall.items() if r > 0.1) >= 0.9 * sum(b for r, (_, b) in recall.items() if r > 0.1), recall
