import random
import re

import numpy as np
from helpers import edge_rows, frame, prose, vocabulary
from pyspark.sql import functions as F

from siltstone.llm import toxicity as T

BAD = ["vile1", "rotten2", "filth3", "scumb4"]


def corpus(n=400, seed=8):
    rng, words = random.Random(seed), vocabulary(800)
    rows, marks = [], []
    for i in range(n):
        w = prose(rng, 60, words).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_held_out_accuracy_and_edges(spark):
    rows, marks = corpus()
    rows += edge_rows()
    labels = spark.createDataFrame([m for m in marks if m[0] % 3 != 1] + [(None, 1, 1), (901, None, None), (5000, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("plain", F.lit(1)).withColumn("_toxic", F.lit(1))
    model = T.learn(docs, labels)
    assert {b.encode() for b in BAD} <= set(model[0])
    got = T.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    test = [m for m in marks if m[0] % 3 == 1]
    assert np.mean([by[i] == t for i, _, t in test]) > 0.97
    assert all(by[i] == 0 for i in (900, 901, 902, 903, 904))
    kept = [r.doc_id for r in T.accepted(docs, model).collect()]
    assert sorted(kept, key=str) == sorted((r.doc_id for r in got if not r.predicted), key=str)


def test_copied_passages_teach_no_words(spark):
    rng, words = random.Random(9), vocabulary(800)
    rows, marks = corpus(200)
    passage = "oddone1 oddtwo2 oddthree3"
    rows += [(1000 + i, f"{prose(rng, 20, words)} {BAD[0]} {passage} {BAD[1]}", "en", "s", 1) for i in range(12)]
    marks += [(1000 + i, 1, 1) for i in range(12)]
    model = T.learn(frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    assert b"oddtwo2" not in model[0] and BAD[0].encode() in model[0]


def test_clauses():
    g = T.Grammar({b"fool": 2.0})
    names = dict(zip(T.FEATURES, g.features("You are a fool. He is not a fool! She said the fool came; I will kill you")))
    assert names == {"plain": 2.0, "negated": 2.0, "reported": 2.0, "threat": 4.0, "targeted": 10.0, "clauses": 4.0, "distinct": 2.0}
    assert sum(g.features("foolish words")) == 0
    plain_end = dict(zip(T.FEATURES, g.features("not now. fool")))
    assert plain_end["plain"] == 2.0 and plain_end["negated"] == 0


def test_composition_equals_the_cascade():
    rng = random.Random(3)
    start, table = T.GRAMMAR
    parts = [T.report_transducer(), T.negation_transducer(), T.clause_transducer()]
    for _ in range(200):
        symbols = [rng.randrange(7) for _ in range(12)]
        out, s = [], start
        for x in symbols:
            s, y = table[s, x]
            out.append(y)
        want = symbols
        for first, t in parts:
            state, nxt = first, []
            for x in want:
                state, y = t[state, x]
                nxt.append(y)
            want = nxt
        assert out == want


def test_stems_generalise(spark):
    rng, words = random.Random(12), vocabulary(800)
    rows, marks = [], []
    for i in range(300):
        w = prose(rng, 50, words).split()
        for _ in range(3 * (i % 3 == 0)):
            w.insert(rng.randrange(len(w)), "vexor" + rng.choice(words))
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(i % 3 == 0)))
    model = T.learn(frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    assert b"vexor*" in model[0]
    got = T.score_toxicity(frame(spark, [(1, "a vexornew1 b. c vexornew2 d. vexornew3"), (2, "a vex or b")]), model).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [1, 0]


def test_nothing_to_learn(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = T.learn(frame(spark, [(1, "a b")]), labels)
    assert model[0] == {} and T.score_toxicity(frame(spark, [(1, "a b")]), model).first().predicted == 0
    assert T.score_toxicity(frame(spark, []), model).count() == 0


def test_insults_in_quotes_and_beside_punctuation(spark):
    g = T.Grammar({b"fool": 2.0, b"vexor*": 1.0})
    for t in ("'fool'", "\u2018fool\u2019", "\u201cfool\u201d", "\u00abfool\u00bb", "\u00a1fool!", "so\u2014fool\u2014so", "fool\u2026", "'vexornew", "\u00bfvexornew?", "'kill'"):
        assert g.features(t)[5] == 1, t
    assert T.text_words("\u00abFool\u00bb isn't _so_ 'bad'\u2014no.") == [b"fool", b"isn't", b"so", b"bad", b"no"]
    rows, marks = corpus()
    rows = [(i, " ".join(f"\u00ab{w}\u00bb" if w in BAD else w for w in t.split()), *rest) for i, t, *rest in rows]
    model = T.learn(frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    assert {b.encode() for b in BAD} <= set(model[0])


def test_quick_look_misses_no_match():
    rng = random.Random(5)
    glue = ["'", "\u2019", "\u00ab", "_", "-", " ", "\u2014", "\u00a1", "."]
    for lexicon in ({b"fool": 2.0, "cr\u00e9tin".encode(): 1.0, b"d'oh": 1.0, b"vexor*": 1.0}, {"\u0434\u0443\u0440".encode(): 1.0}, {b"d'oh*": 1.0}):
        g = T.Grammar(lexicon)
        for _ in range(400):
            text = "".join(rng.choice(["fool", "cr\u00e9tin", "d'oh", "vexornew", "\u0434\u0443\u0440", "so", "kill"]) + rng.choice(glue) for _ in range(3))
            before = g.features(text)
            g.may_hit, keep = (lambda low: True), g.may_hit
            assert g.features(text) == before
            g.may_hit = keep


def plain_features(text, insults):
    """The grammar in plain code: clause by clause, word by word."""
    out, seen = dict.fromkeys(T.FEATURES, 0.0), set()
    for clause in re.split(r"[.!?;|\n]", text.lower()):
        reported, reach, found = False, 0, False
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)*", clause)
        targeted = any(w in T.TARGETS for w in words)
        for w in words:
            negated = reach > 0
            if w in T.REPORTS:
                reported = True
            kind = "threat" if w in T.THREATS else "plain" if w in insults else None
            if kind:
                weight = insults.get(w, 4.0)
                out["reported" if reported else "negated" if negated else kind] += weight
                out["targeted"] += weight * targeted
                seen.add(w)
                found = True
            reach = T.NEGATION_REACH if w in T.NEGATIONS else max(0, reach - 1)
        out["clauses"] += found
    return out | {"distinct": float(len(seen))}


def test_grammar_equals_plain_code():
    rng = random.Random(17)
    insults = {"fool": 2.0, "vile1": 1.5}
    g = T.Grammar({w.encode(): x for w, x in insults.items()})
    pieces = ["you", "not", "never", "said", "kill", "fool", "vile1", "word", "so", "isn't", ".", "!", ";", "\n", "|", "Fool", "them"]
    for _ in range(500):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert dict(zip(T.FEATURES, g.features(text))) == plain_features(text, insults), text


def test_score_equals_plain_code(spark):
    rows, marks = corpus(300)
    insults, weights = T.learn(frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    own = {w.decode(): x for w, x in insults.items() if not w.endswith(T.STEM)}
    stems_ = {w[:-1].decode(): x for w, x in insults.items() if w.endswith(T.STEM)}
    for r in T.score_toxicity(frame(spark, rows), (insults, weights)).join(frame(spark, rows).select("doc_id", "text"), "doc_id").collect():
        listed = dict(own)
        for w in re.findall(r"[^\W_]+", r.text.lower()):
            for n in T.STEM_BYTES:
                if w not in listed and len(w) > n and w[:n] in stems_:
                    listed[w] = stems_[w[:n]]
        f = plain_features(r.text, listed)
        z = weights[-1] + sum(w * np.log1p(f[n]) for w, n in zip(weights, T.FEATURES))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= T.THRESHOLD)
