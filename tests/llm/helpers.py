import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) + str(i % 7) for i in range(n)]


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng, text, share, words):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split())


def frame(spark, rows):
    """Rows (doc_id, text) or full ones."""
    return spark.createDataFrame([r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows], DOCS)


def edge_rows(long_text="w " * 60_000):
    """Nulls, empty and very long texts, repeated rows and ids."""
    return [(None, "null id here now ok", None, None, None), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "  \n\t ", "en", None, 5), (903, long_text, "en", "s", 1), (904, "x", "en", "s", 1), (904, "x", "en", "s", 1), (905, "é É ß 日本", None, "s", 9)]
