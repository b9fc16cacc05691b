import random
import re

from helpers import edge_rows, frame, prose, vocabulary
from pyspark.sql import functions as F

from siltstone.llm import language as L


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    vocab = {lang: [c + w for w in vocabulary(300, seed)] for lang, seed, c in (("aa", 1, "q"), ("bb", 2, "z"), ("cc", 3, "ö"))}
    rows = [(i, prose(rng, 40, vocab[lang]), lang, "s", 1) for i in range(240) for lang in [rng.choice(list(vocab))]]
    docs = frame(spark, rows + edge_rows("q1 " * 30_000))
    learned = L.learn_dictionaries(docs.where("doc_id % 3 <> 1 and doc_id < 900"))
    assert sorted(learned) == ["aa", "bb", "cc"] and max(map(len, learned.values())) <= L.DICTIONARY_BYTES
    got = L.identify_language(docs.withColumn("score", F.lit("clash")), learned).collect()
    test = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (900, 901, 902)] == ["und"] * 3 and by[904] != "und"


def test_narrow_margins_are_rejected():
    c = L.Classifier({"a": b"same words " * 50, "b": b"same words " * 50})
    assert c.predict("same words here")[0] == "a" and not c.predict("same words here")[3]


def test_nothing_to_learn(spark):
    assert L.learn_dictionaries(frame(spark, []).where("false")) == {}
    assert L.identify_language(frame(spark, [(1, "text")]), {}).first().lang_pred == "und"


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 300} only here", f"l{i % 300:03}", "s", 1) for i in range(600)] + [(999, "once seen", "rare", "s", 1)]
    assert len(L.learn_dictionaries(frame(spark, rows))) == 301


def test_predictions_equal_plain_compression(spark):
    """Dictionaries and sizes made anew, without the operator's classes."""
    import zstandard

    rng = random.Random(5)
    vocab = {lang: [c + w for w in vocabulary(60, 2)] for lang, c in (("aa", ""), ("bb", "x"), ("cc", "é"))}
    rows = [(i, prose(rng, rng.randrange(0, 25), vocab[lang]), lang, "s", 1) for i in range(90) for lang in [rng.choice(list(vocab))]]
    learned = L.learn_dictionaries(frame(spark, rows))
    for lang, raw in learned.items():  # texts under SLICE_BYTES give all they have
        lines = sorted(" ".join(re.findall(r"[^\W\d_]+", t.lower())) for _, t, tag, *_ in rows if tag == lang and t)
        assert sorted(x.strip() for x in raw.decode().splitlines()) == lines
    texts = {i: t for i, t, *_ in rows}
    for r in L.identify_language(frame(spark, rows), learned).collect():
        text = re.sub(r"[\W\d_]+", " ", texts[r.doc_id].lower()).encode()
        sizes = {}
        for lang, raw in learned.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(text))
        first, second = sorted(sizes.values())[:2]
        assert r.lang_pred == (min(sizes, key=lambda k: (sizes[k], k)) if text else "und")
        assert not text or r.accepted == ((second - first) / second >= L.MIN_MARGIN)
