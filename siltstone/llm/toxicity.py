"""Toxicity by a weighted finite-state pattern grammar.

Five lexical transducers of one state each (insult, threat, target, negation, report) write a word as a weighted symbol;
insults and their weights are learned from labelled rows, the other classes are fixed lists. Three more read the symbols in
turn: reported speech, negation, and the clause with its target. Each is a table of (state, symbol) -> (state, symbol);
their composition is one table that turns a text into matched clauses: an insult or a threat that stands plain, negated or
reported, in a clause with a target or without. Weights are summed by kind of match, and a logistic function of these sums,
fit on labelled rows, is the score. An insult that stands by itself is a clause of the plain kind without a target: what
such clauses weigh is learned as for the others, since in the labelled rows most insults stand so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, documents, drop_saved, save
from .worker import kept, task

#: At most so many labelled rows of each kind are learned from, the smallest by a hash of doc_id.
TOXIC_ROWS = 8_000
CLEAN_ROWS = 16_000
#: An insult occurs in so many toxic texts at least, in so many different contexts, with this log-odds at least.
MIN_TEXTS = 4
MIN_CONTEXTS = 4
MIN_LOG_ODDS = 3.0
#: Contexts for each text; a word of copied passages has the same few contexts in all copies.
MIN_CONTEXT_SHARE = 0.4
MOST_INSULTS = 20_000
#: Stems: first bytes of words, learned as words are if so many different words begin with them; longer ones go first.
STEM_BYTES = (6, 5, 4)
MIN_STEM_WORDS = 3
STEM = b"*"
THRESHOLD = 0.7

# The closed classes of the grammar.
TARGETS = "you your u ur he she they him her them tu ton toi vous votre il elle ils elles du dein dich ihr euch er sie tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie ne jamais nunca jamás".split()
REPORTS = "said says wrote writes claimed called quoted reported sagte meinte schrieb dit disait écrit dijo decía escribió".split()
THREATS = "kill hurt destroy murder töten umbringen vernichten tuer détruire matar destruir".split()

#: Symbols: other, insult, threat, target, negation, report, end of a clause; then how a match stands.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
NEGATED, REPORTED, BOTH = 7, 8, 9  # an insult or threat under negation, in reported speech, under both
TARGETED_END = 10  # the end of a clause that names a target
Table = dict[tuple[object, int], tuple[object, int]]
NEGATION_REACH = 3


def report_transducer() -> tuple[object, Table]:
    """After a report verb, matches of the clause are reported."""
    t: Table = {}
    for s in (0, 1):
        for x in range(7):
            t[s, x] = (0 if x == END else 1 if x == REPORT else s, REPORTED if s and x in (INSULT, THREAT) else x)
    return 0, t


def negation_transducer() -> tuple[object, Table]:
    """A negation reaches the next few words of its clause."""
    t: Table = {}
    for s in range(NEGATION_REACH + 1):
        for x in range(10):
            y = {INSULT: NEGATED, THREAT: NEGATED, REPORTED: BOTH}.get(x, x) if s else x
            t[s, x] = (0 if x == END else NEGATION_REACH if x == NEGATION else max(0, s - 1), y)
    return 0, t


def clause_transducer() -> tuple[object, Table]:
    """Remembers whether the clause names a target, before or after its matches, and writes so at its end."""
    t: Table = {}
    for s in (0, 1):
        for x in range(10):
            t[s, x] = (0 if x == END else 1 if x == TARGET else s, TARGETED_END if x == END and s else x)
    return 0, t


def compose(a: tuple[object, Table], b: tuple[object, Table]) -> tuple[object, Table]:
    """The transducer that feeds what a writes to b."""
    start, todo, out = (a[0], b[0]), [(a[0], b[0])], {}
    seen = {start}
    while todo:
        p, q = todo.pop()
        for (s, x), (s2, y) in a[1].items():
            if s == p and (q, y) in b[1]:
                q2, z = b[1][q, y]
                out[(p, q), x] = ((s2, q2), z)
                if (s2, q2) not in seen:
                    seen.add((s2, q2))
                    todo.append((s2, q2))
    return start, out


GRAMMAR = compose(compose(report_transducer(), negation_transducer()), clause_transducer())
FEATURES = ["plain", "negated", "reported", "threat", "targeted", "clauses", "distinct"]
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_PIECE = re.compile(_WORD.pattern + r"|[.!?;|\n]")

_FRAGMENTS = bytes(c if c < 0x80 and chr(c).isalnum() else 0x20 for c in range(256))


def fragments(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits. A word's runs are runs of every text that holds the word."""
    return raw.translate(_FRAGMENTS).split()


def text_words(text: str) -> list[bytes]:
    """Lower-cased words, as the grammar reads them."""
    return " ".join(_WORD.findall(text.lower())).encode("utf-8", "surrogatepass").split()


def stems(words: set[bytes], length: int) -> set[bytes]:
    return {w[:length] + STEM for w in words if len(w) > length}


class Grammar:
    """Matches clauses of texts against the composed transducer. ``insults``: words, and stems that end with a star."""

    def __init__(self, insults: dict[bytes, float]):
        self.stems = {n: {w[:-1]: x for w, x in insults.items() if w.endswith(STEM) and len(w) == n + 1} for n in STEM_BYTES}
        self.stems = {n: x for n, x in self.stems.items() if x}
        insults = {w.decode("utf-8", "replace"): x for w, x in insults.items() if not w.endswith(STEM)}
        self.symbol: dict[str, int] = {w: REPORT for w in REPORTS} | {w: NEGATION for w in NEGATIONS} | {w: TARGET for w in TARGETS}
        self.symbol |= {w: THREAT for w in THREATS} | {w: INSULT for w in insults}
        self.symbol |= {c: END for c in ".!?;|\n"}
        self.weight = {w: 4.0 for w in THREATS} | insults
        self.hot = frozenset(w.encode() for w in [*THREATS, *insults])
        # a run of each word, and the stems that are runs, for a look at a text before it is split; without them every text is split
        self.quick = frozenset(max(fragments(w), key=len, default=b"") for w in self.hot)
        self.every = b"" in self.quick or any(fragments(w) != [w] for found in self.stems.values() for w in found)
        self.known: dict[str, int] = {}
        start, table = GRAMMAR
        states = {start: 0}
        for (s, _), (s2, _) in table.items():
            states.setdefault(s, len(states))
            states.setdefault(s2, len(states))
        self.move = [[(0, OTHER)] * 7 for _ in states]
        for (s, x), (s2, y) in table.items():
            self.move[states[s]][x] = (states[s2], y)

    def may_hit(self, low: str) -> bool:
        """False only if no word of a lower-cased text is an insult or a threat."""
        words = set(fragments(low.encode("utf-8", "surrogatepass")))
        return self.every or not self.quick.isdisjoint(words) or any(not {w[:n] for w in words}.isdisjoint(found) for n, found in self.stems.items())

    def symbol_of(self, piece: str) -> int:
        """Words that no lexicon has are looked up by their stems; a stem's weight becomes the word's."""
        raw = piece.encode("utf-8", "surrogatepass")
        for n, found in self.stems.items():
            if len(raw) > n and raw[:n] in found:
                self.weight.setdefault(piece, found[raw[:n]])
                return INSULT
        return OTHER

    def features(self, text: str | None) -> list[float]:
        out = [0.0] * len(FEATURES)
        low = (text or "").lower()
        if not low or not self.may_hit(low):
            return out
        symbol, known, state, clause, seen = self.symbol, self.known, 0, [], set()
        for piece in _PIECE.findall(low + "\n"):
            x = symbol.get(piece)
            if x is None:
                x = known.get(piece)
                if x is None:
                    if len(known) > 100_000:
                        known.clear()
                    x = known[piece] = self.symbol_of(piece)
            state, y = self.move[state][x]
            if y in (INSULT, THREAT, NEGATED, REPORTED, BOTH):
                clause.append((y, x, self.weight[piece]))
                seen.add(piece)
            elif x == END and clause:
                for how, what, w in clause:
                    out[1 if how == NEGATED else 2 if how in (REPORTED, BOTH) else 3 if what == THREAT else 0] += w
                    out[4] += w * (y == TARGETED_END)
                out[5] += 1
                clause = []
        out[6] = float(len(seen))
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept. One class alone gives its constant."""
    x = np.column_stack([scaled(x), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[bytes, float], np.ndarray]:
    """Insults with their log-odds, and the weights of the score, from labelled rows (doc_id, toxic).

    A bounded number of rows is chosen by a hash of doc_id. Rows with null labels, ids or texts teach nothing. Without
    rows of both kinds the lexicon is empty and the score is constant 0.
    """
    spark = docs.sparkSession
    marked = labels.select("doc_id", F.col("toxic").alias("_toxic")).where("doc_id is not null and _toxic in (0, 1)")
    pick = lambda k, n: marked.where(F.col("_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(pick(1, TOXIC_ROWS).union(pick(0, CLEAN_ROWS)).distinct())
    sample = save(docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "text", "_toxic"), "toxic-sample")
    totals = {r._toxic: r["count"] for r in sample.groupBy("_toxic").count().collect()}
    nothing = np.zeros(len(FEATURES) + 1)
    nothing[-1] = -30.0
    if not totals.get(1) or not totals.get(0):
        return {}, nothing

    @task("toxicity")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for x in batches:
            for t, k in zip(x.column("text").to_pylist(), x.column("_toxic").to_pylist()):
                own = set(text_words(t))
                counts[k].update(own)
                for n in STEM_BYTES:
                    counts[k].update(stems(own, n))
        both = list(counts[1])  # words of clean texts alone are no candidates anywhere
        for w in counts[0]:
            if w not in counts[1]:
                both.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([counts[1][w] for w in both], pa.int64()), pa.array([counts[0][w] for w in both], pa.int64())], names=["w", "tox", "clean"])

    odds = F.log((F.col("tox") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    found = (
        sample.mapInArrow(count, "w binary, tox long, clean long").groupBy("w").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
        .where(F.col("tox") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.desc("odds"), "w").limit(MOST_INSULTS).collect()
    )
    candidates = {bytes(r.w): (r.odds, r.tox) for r in found}
    shared = spark.sparkContext.broadcast(frozenset(candidates))

    @task("toxicity")
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for x in batches:
            out = set()
            for t in x.column("text").to_pylist():
                w = [b"", *text_words(t), b""]
                for i in range(1, len(w) - 1):
                    for name in (w[i], *(w[i][:n] + STEM for n in STEM_BYTES if len(w[i]) > n)):
                        if name in shared.value:
                            out.add((name, w[i], xxhash.xxh3_64_intdigest(w[i - 1] + b" " + w[i + 1]) >> 1))
            got = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in ((0, pa.binary()), (1, pa.binary()), (2, pa.int64()))], names=["w", "word", "c"])

    seen = sample.where("_toxic = 1").mapInArrow(contexts, "w binary, word binary, c long")
    varied = seen.groupBy("w").agg(F.countDistinct("c").alias("n"), F.countDistinct("word").alias("words")).where(F.col("n") >= MIN_CONTEXTS)
    insults = {}
    for r in varied.collect():
        odds_, tox = candidates[bytes(r.w)]
        if r.n >= MIN_CONTEXT_SHARE * tox and (r.words >= MIN_STEM_WORDS or not bytes(r.w).endswith(STEM)):
            insults[bytes(r.w)] = odds_
    rows = with_features(sample, insults).select("_toxic", *FEATURES).toPandas()
    drop_saved(sample)
    return insults, fit_logistic(rows[FEATURES].to_numpy(float), rows["_toxic"].to_numpy(float))


def _grammar(insults: dict[bytes, float]) -> Grammar:
    return kept("toxicity", tuple(sorted(insults.items())), lambda: Grammar(insults))


def with_features(df: DataFrame, insults: dict[bytes, float], text: str = "text") -> DataFrame:
    """``df`` without the text, with the summed clause weights of each row."""
    shared = df.sparkSession.sparkContext.broadcast(insults)
    rest = [c for c in df.columns if c != text and c not in FEATURES]
    schema = df.select(*rest).schema
    for f in FEATURES:
        schema = schema.add(f, "double")

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _grammar(shared.value)
        for x in batches:
            f = np.array([g.features(t) for t in x.column(text).to_pylist()], float).reshape(x.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([x.column(c) for c in rest] + [pa.array(f[:, i].copy()) for i in range(len(FEATURES))], names=rest + FEATURES)

    return df.select(text, *rest).mapInArrow(run, schema)


def logistic(weights: np.ndarray):
    z = F.lit(float(weights[-1]))
    for f, w in zip(FEATURES, weights):
        z = z + F.lit(float(w)) * F.log1p(F.col(f))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_toxicity(df: DataFrame, model: tuple[dict[bytes, float], np.ndarray]) -> DataFrame:
    """(columns of ``df`` without text, score, predicted): predicted is 1 where the score is at least 0.7.

    Null and empty texts match no clause and have the score of the intercept. A row is judged by itself: repeats and ties
    change nothing; columns of ``df`` named as the features, score or predicted are replaced.
    """
    rest = [c for c in df.columns if c not in ("text", "score", "predicted", *FEATURES)]
    out = with_features(df.select("text", *rest), model[0]).withColumn("score", logistic(model[1]))
    return out.select(*rest, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: tuple[dict[bytes, float], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` predicts 0 for, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @task("toxicity")
    def score(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        insults, weights = shared.value
        g = _grammar(insults)
        for texts in column:
            x = np.array([g.features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            z = np.full(len(texts), weights[-1])
            for i in range(len(FEATURES)):
                z += weights[i] * np.log1p(x[:, i])
            yield pd.Series(1 / (1 + np.exp(-z)))

    return docs.where(score("text") < THRESHOLD)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    model = learn(docs, labels)
    return score_toxicity(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))), model)
