import numpy as np
import pyarrow as pa
import regex

from siltstone.llm import tokens as T


def test_words_equal_a_plain_split():
    texts = ["Ab cd, ef", "", None, "É é-x  y", "\n", "a" * 50, "b c"]
    h, at, start, end = T.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        want = [w.lower() for w in regex.findall(r"[^\x00-\x20!-/:-@\[-`{-\x7f]+", t or "")]
        got = T.word_strings(pa.array(texts), i)
        assert [g.decode() for g in got] == want
        for w, x in zip(got, h[at[i] : at[i + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_hashes(monkeypatch):
    col = pa.array(["some words in here " * 40, "x" * 300 + " tail"])
    a = T.words(col)[0]
    monkeypatch.setattr(T, "BLOCK", 16)
    assert (T.words(col)[0] == a).all()


def test_sliced_columns():
    col = pa.array(["zero", "one two", "three"])
    h, at, *_ = T.words(col.slice(1))
    assert at.tolist() == [0, 2, 3] and (h[:2] == T.words(pa.array(["one two"]))[0]).all()


def test_ngrams_long_and_short_agree():
    h, at, *_ = T.words(pa.array(["a b c d e f g h i j", "c d e f g h i j k l"]))
    g, whole = T.ngrams(h, at, 8)
    assert whole.tolist().count(True) == 6 and g[2] == g[10] and g[0] != g[1]
    g, whole = T.ngrams(np.tile(h, 3), np.array([0, 30, 60]), 15)
    assert g[0] == g[20] == g[40]


def test_shingles_of_short_texts():
    h, at, *_ = T.words(pa.array(["a b", "", "a b", "b a", "a b c d e f"]))
    g, off = T.shingles(h, at, 5)
    assert np.diff(off).tolist() == [1, 0, 1, 1, 2] and g[0] == g[1] != g[2]
    values, counts, off = T.distinct_counts(np.array([3, 1, 3, 2], np.uint64), np.array([0, 3, 3, 4]))
    assert values.tolist() == [1, 3, 2] and counts.tolist() == [1, 2, 1] and off.tolist() == [0, 2, 2, 3]
