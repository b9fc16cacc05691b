import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import edge_rows, frame, vocabulary
from pyspark.sql import functions as F

from siltstone.llm import language_model as L
from siltstone.llm import recurrent as R


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def corpus(n=160):
    rng = random.Random(4)
    a, b = vocabulary(150, 1), [w + "q" for w in vocabulary(150, 2)]
    return [(i, " ".join(rng.choice(v) for _ in range(rng.randrange(5, 90))), "en", "s", 1) for i in range(n) for v in [rng.choice((a, b))]]


def test_base_score_counts_and_gain(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD_WORDS", 60)  # so that most words meet their counts in the join
    monkeypatch.setattr(L, "MODEL_WORDS", 40)
    rows = corpus() + edge_rows("w Zz " * 20_000)
    docs = frame(spark, rows).withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))).withColumn("cold", F.lit("clash"))
    got = L.score_documents(docs, docs.where("not held_out")).collect()
    train = [r for r in rows if not (r[0] is not None and r[0] % 7 == 2)]  # a null text is an empty one
    c = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 4)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score <= 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    p = R.start(np.arange(304, 0, -1.0), 4, seed=3)
    states = np.random.default_rng(1).standard_normal((3, R.HIDDEN)).astype(np.float32) * 0.5
    for s in states:
        lp = R.log_probabilities(p, np.repeat(s[None], 304, axis=0), np.arange(304), 300)
        assert abs(np.exp(lp).sum() - 1) < 1e-4


def test_gradients_equal_differences():
    words, tails = 140, 3
    p = {k: v.astype(np.float64) for k, v in R.start(np.arange(143, 0, -1.0), tails).items()}
    t = R.Trainer(p, words, tails)
    rng = np.random.default_rng(5)
    steps, b = 5, 3
    before = rng.integers(0, 143, (steps, b)).astype(np.int32)
    before[0, 0] = before[3, 1] = words + tails
    token, valid = rng.integers(0, 143, (steps, b)).astype(np.int32), np.ones((steps, b), bool)
    valid[4, 2] = False
    h = rng.standard_normal((b, R.HIDDEN)) * 0.1
    scale = R.WINDOW_TRAINING * R.LANES_TRAINING

    def loss():
        states, _, _ = R.forward(p, before, words + tails, h, False)
        return -R.log_probabilities(p, states[valid].astype(np.float64), token[valid], words).sum() / scale

    g, _, value = t.gradients(before, token, valid, h)
    assert abs(value - loss()) < 1e-6
    full = {"u": g["u"], "wc": g["wc"], "bc": g["bc"], "x": np.zeros_like(p["x"]), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
    full["x"][g["x"][0]] = g["x"][1]
    for part, gw, gb in g["words"]:
        full["ww"][part] += gw
        full["bw"][part] += gb
    for k, grad in full.items():
        spots = np.argsort(-np.abs(grad).ravel())[:4]
        for s in spots:
            at = np.unravel_index(s, grad.shape)
            e = 1e-2 if k != "u" else 1e-3
            old = p[k][at]
            p[k][at] = old + e
            up = loss()
            p[k][at] = old - e
            down = loss()
            p[k][at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-2 * abs(grad[at]) + 2e-6, k


def test_state_runs_across_windows(monkeypatch):
    rng = np.random.default_rng(6)
    p = R.start(np.arange(143, 0, -1.0), 3)
    p["u"] *= 8
    off = np.array([0, 90, 90, 97, 200])
    ids = rng.integers(0, 143, 200).astype(np.int32)
    one = R.score(p, ids, off, 140, 3)
    monkeypatch.setattr(R, "WINDOW_SCORING", 7)
    monkeypatch.setattr(R, "LANES_SCORING", 1)
    assert np.allclose(one, R.score(p, ids, off, 140, 3), rtol=1e-4) and one[1] == 0


def test_no_training_texts(spark):
    docs = frame(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))
    got = L.score_documents(docs, docs.where("false")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in got)
    empty = frame(spark, []).withColumn("held_out", F.lit(False))
    assert L.score_documents(empty, empty).count() == 0


def test_every_training_text_reaches_the_trainers(spark):
    docs = frame(spark, corpus(60)).where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(16)) != 0)
    v = L.vocabulary(L.count_tokens(docs))
    first = R.pack(R.start(np.concatenate([v.c[: v.model], v.tail_tokens]), L.TAILS))
    got = L.train(docs, spark.sparkContext.broadcast(v), first)
    assert np.isfinite(got).all() and not np.array_equal(got, first)


def test_a_word_has_one_row_whatever_stands_before_it(spark, monkeypatch):
    monkeypatch.setattr(L, "COUNTED_AT_ONCE", 1)
    texts = ["a", "x a", "x\na", "x\ta y", "\ra", "a a\na"] * 3
    docs = frame(spark, list(enumerate(texts))).repartition(6, "doc_id")
    want = Counter(w for t in texts for w in tokens(t))
    assert sorted(r.c for r in L.count_tokens(docs).collect()) == sorted(want.values())
    h, _, tail = L.tokens_of(pa.array(texts))
    assert len(set(zip(h.tolist(), tail.tolist()))) == len(want)


def test_null_texts_are_learned_as_empty(spark):
    a, b, c = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    docs = spark.createDataFrame([(a, "a b"), (b, None), (c, "")], "doc_id bigint, text string")
    assert {r.train_tokens for r in L.score_documents(docs.withColumn("held_out", F.lit(False)), L.training(docs)).collect()} == {3 + 1 + 1}


def test_a_flat_distribution_has_model_words(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD_WORDS", 100)
    v = L.vocabulary(L.count_tokens(frame(spark, [(i, f"once{i}") for i in range(900)])))
    assert 50 < len(v.h) < 150 and v.tokens == 1800 and v.distinct == 901


def test_two_trainers_are_averaged_by_their_tokens(spark, monkeypatch):
    docs = frame(spark, corpus(90))
    v = L.vocabulary(L.count_tokens(docs))
    first = R.pack(R.start(np.concatenate([v.c[: v.model], v.tail_tokens]), L.TAILS))
    monkeypatch.setattr(L, "ROUNDS", 1)
    monkeypatch.setattr(L, "AVERAGED", 2)
    size = sum(len(t.encode()) for _, t, *_ in corpus(90))
    for trainers in (2, 5):  # 5: three levels of averages
        monkeypatch.setattr(L, "TRAINER_BYTES", size / trainers)
        dealt = docs.withColumn("t", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(trainers))).withColumn("h", F.xxhash64("doc_id")).orderBy("t", "h", "doc_id", "text").collect()
        total, tokens_ = 0.0, 0
        for k in range(trainers):
            texts = pa.array([r.text for r in dealt if r.t == k])
            h, off, tail = L.tokens_of(texts)
            t = R.Trainer(R.unpack(first, v.model, L.TAILS), v.model, L.TAILS)
            t.learn(v.ready().model_ids(v.find(h), tail), off)
            total, tokens_ = total + t.tokens * R.pack(t.p).astype(float), tokens_ + t.tokens
        got = L.train(docs, spark.sparkContext.broadcast(v), first)
        assert np.allclose(got, total / tokens_, atol=1e-5) and not np.allclose(got, first, atol=1e-4)


def plain_score(p, words, tails, ids):
    """One text, token by token, in double precision."""
    k, h, total, before = R.HIDDEN, np.zeros(R.HIDDEN), 0.0, words + tails
    sig = lambda x: 1 / (1 + np.exp(-x))
    p = {n: x.astype(float) for n, x in p.items()}
    for t in ids:
        x, g = p["x"][before], h @ p["u"]
        z, r = sig(x[:k] + g[:k]), sig(x[k : 2 * k] + g[k : 2 * k])
        n = np.tanh(x[2 * k :] + r * g[2 * k :])
        h = (1 - z) * n + z * h
        c = h @ p["wc"] + p["bc"]
        cls = t // R.CLASS_WORDS if t < words else t - words + -(-words // R.CLASS_WORDS)
        total += c[cls] - np.log(np.exp(c).sum())
        if t < words:
            lo, hi = cls * R.CLASS_WORDS, min(words, (cls + 1) * R.CLASS_WORDS)
            w = p["ww"][lo:hi] @ h + p["bw"][lo:hi]
            total += w[t - lo] - np.log(np.exp(w).sum())
        before = t
    return total


def test_whole_scores_equal_plain_code(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD_WORDS", 200)
    monkeypatch.setattr(L, "MODEL_WORDS", 150)
    rows = [*corpus(60), (900, None, None, None, None), (901, "never seen words x9z", "en", "s", 1)]
    docs = frame(spark, rows).withColumn("held_out", F.col("doc_id") >= 900)
    learn_from = docs.where("not held_out")
    v = L.vocabulary(L.count_tokens(learn_from)).ready()
    p = R.unpack(L.train(learn_from, spark.sparkContext.broadcast(v), R.pack(R.start(np.concatenate([v.c[: v.model], v.tail_tokens]), L.TAILS))), v.model, L.TAILS)
    c = Counter(w for r in rows if r[0] < 900 for w in tokens(r[1]))
    assert v.model == 150 and sum(c.values()) == v.tokens
    for r in L.score_documents(docs, learn_from).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        h, _, tail = L.tokens_of(pa.array([text], pa.string()))
        ids = v.model_ids(v.find(h), tail)
        want = plain_score(p, v.model, L.TAILS, ids) / math.log(10)
        for w, t, i in zip(tokens(text), tail, ids):
            if i >= v.model:  # the word's add-one share of its tail class
                want += math.log10((c[w] + 1) / (v.tail_tokens[t] + v.tail_words[t] + 1))
        assert abs(r.score - want) < 1e-3 * max(1, abs(want)), (r, want)


def test_a_window_steps_each_table_of_weights_once(monkeypatch):
    words, rng, steps = 3 * R.CLASS_WORDS - 5, np.random.default_rng(2), []
    t = R.Trainer(R.start(np.arange(words + 4, 0, -1.0), 4), words, 4)
    step = R.Trainer._step
    monkeypatch.setattr(R.Trainer, "_step", lambda self, k, *a: steps.append(k) or step(self, k, *a))
    old = R.pack(t.p)
    t.learn(rng.integers(0, words + 4, R.WINDOW_TRAINING).astype(np.int32), np.array([0, R.WINDOW_TRAINING]))
    assert sorted(steps) == sorted(t.p) and np.isfinite(R.pack(t.p)).all() and not np.array_equal(old, R.pack(t.p))


def test_texts_become_tokens_once_for_all_rounds(spark, monkeypatch):
    docs = frame(spark, corpus(40) + [(900, None)])
    v = L.vocabulary(L.count_tokens(docs))
    first, inputs = R.pack(R.start(np.concatenate([v.c[: v.model], v.tail_tokens]), L.TAILS)), []
    f = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a: inputs.append(self.columns) or f(self, run, *a))
    L.train(docs, spark.sparkContext.broadcast(v), first)
    assert sum("text" in x for x in inputs) == 1 < L.ROUNDS


def test_a_window_steps_the_classes_it_has(monkeypatch):
    words, tails = 5 * R.CLASS_WORDS - 9, 3  # the last class is not full
    p = {k: v.astype(np.float64) for k, v in R.start(np.arange(words + tails, 0, -1.0), tails).items()}
    t, begin, rng = R.Trainer(p, words, tails), words + tails, np.random.default_rng(8)
    token = rng.choice([1, 5, R.CLASS_WORDS + 3, words - 1, words - 4, words + 1], (4, 3)).astype(np.int32)
    before, valid, h = rng.integers(0, begin, (4, 3)).astype(np.int32), np.ones((4, 3), bool), np.zeros((3, R.HIDDEN))
    g, _, _ = t.gradients(before, token, valid, h)
    ((part, gw, gb),) = g["words"]
    assert sorted(set((part // R.CLASS_WORDS).tolist())) == sorted({int(x) // R.CLASS_WORDS for x in token.ravel() if x < words}) and part.max() == words - 1

    def loss():
        return -R.log_probabilities(p, R.forward(p, before, begin, h, False)[0][valid].astype(np.float64), token[valid], words).sum() / (R.WINDOW_TRAINING * R.LANES_TRAINING)

    for k, grad in (("ww", gw), ("bw", gb)):
        for s in np.argsort(-np.abs(grad).ravel())[:6]:
            i, *rest = np.unravel_index(s, grad.shape)
            at, e = (part[i], *rest), 1e-2
            p[k][at] += e
            up = loss()
            p[k][at] -= 2 * e
            assert abs((up - loss()) / (2 * e) - grad[i, *rest]) < 2e-2 * abs(grad[i, *rest]) + 2e-6
            p[k][at] += e
    old = {k: p[k].copy() for k in ("ww", "bw")}
    t._window(before, token, valid, h)
    others = np.setdiff1d(np.arange(words), part)
    assert all(np.array_equal(old[k][others], t.p[k][others]) and not np.array_equal(old[k], t.p[k]) for k in old)


def test_windows_take_no_new_pages():
    """A window's arrays use the memory of the window before."""
    code = """if 1:
        import resource, numpy as np
        from siltstone.llm import recurrent as R
        words, n = 2048, 30 * R.WINDOW_TRAINING
        t = R.Trainer(R.start(np.arange(words + 8, 0, -1.0), 8), words, 8)
        ids = np.random.default_rng(1).integers(0, words + 8, n * R.LANES_TRAINING).astype(np.int32)
        faults = []
        for _ in range(2):
            t.learn(ids, np.arange(0, len(ids) + 1, n))
            faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
        print((faults[1] - faults[0]) / 30)"""
    root = os.path.join(os.path.dirname(R.__file__), "..", "..")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=120)
    assert float(out.stdout) < 400, out.stderr


def test_texts_learned_from_become_tokens_once_for_their_scores_too(spark, monkeypatch):
    docs = frame(spark, corpus(40) + [(900, None), (901, ""), (902, "w1 never")]).withColumn("held_out", F.col("doc_id") % 5 == 0)
    want = {r.doc_id: r for r in L.score_documents(docs, docs.where("not held_out")).collect()}
    inputs, f = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a: inputs.append(self.columns) or f(self, run, *a))
    got = {r.doc_id: r for r in L.score_documents(docs).collect()}
    assert sum("text" in x for x in inputs) == 2  # to be counted, and for training and scores
    assert got.keys() == want.keys() and all(got[i][:6] == want[i][:6] and abs(got[i].score - want[i].score) < 1e-3 * max(1, abs(want[i].score)) for i in want)


def test_softmaxes_hold_a_block_of_rows(monkeypatch):
    """A window's logits stay in the near caches; sums and gradients are those of rows taken at once."""
    words, rng, sizes = 5 * R.CLASS_WORDS, np.random.default_rng(9), []
    p = {k: v.astype(np.float64) for k, v in R.start(np.arange(words + 4, 0, -1.0), 4).items()}
    before, token = (rng.integers(0, words + 4, (16, 40)).astype(np.int32) for _ in range(2))
    valid, h = rng.random((16, 40)) < 0.9, rng.standard_normal((40, R.HIDDEN))
    odds = R._odds
    monkeypatch.setattr(R, "_odds", lambda x, own: sizes.append(len(x)) or odds(x, own))
    monkeypatch.setattr(R, "BLOCK", 10_000)
    whole, _, loss = R.Trainer(p, words, 4).gradients(before, token, valid, h)
    states = rng.standard_normal((640, R.HIDDEN))
    lp = R.log_probabilities(p, states, token.ravel(), words)
    assert sizes == [valid.sum(), (token[valid] < words).sum()]
    sizes.clear()
    monkeypatch.setattr(R, "BLOCK", 150)
    got, _, value = R.Trainer(p, words, 4).gradients(before, token, valid, h)
    assert max(sizes) <= 150 and len(sizes) > 6 and np.isclose(value, loss, rtol=1e-12)
    for a, b in [*((whole[k], got[k]) for k in ("u", "wc", "bc")), *zip(whole["x"], got["x"]), *zip(whole["words"][0][1:], got["words"][0][1:])]:
        assert np.allclose(a, b, rtol=1e-5, atol=1e-12)
    assert np.allclose(lp, R.log_probabilities(p, states, token.ravel(), words))


def test_rows_of_a_name_are_summed():
    rng = np.random.default_rng(3)
    for names in (np.repeat([7, 0, 2, 900], [3 * R.FEW_ROWS, R.FEW_ROWS, R.FEW_ROWS + 1, 1]), rng.zipf(1.4, 3000) % 500, np.zeros(5, int), np.arange(9)):
        names, x = rng.permutation(names).astype(np.int32), rng.standard_normal((len(names), 6))
        got, sums = R._summed(names, x, 1000)
        assert sorted(got) == sorted(set(names.tolist()))
        assert all(np.allclose(s, x[names == n].sum(axis=0)) for n, s in zip(got, sums))
