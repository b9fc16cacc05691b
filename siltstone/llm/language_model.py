"""LM scoring of whole documents: add-one unigram base and a gated recurrent model (see ``recurrent``).

Counts of all tokens of all training texts come first. The most frequent words are the model's word tokens; every other
word, unknown ones too, belongs to one of TAILS tail classes by its last bytes. The recurrent model predicts tail classes
as it does words, and within a tail class a word has its add-one share of the class's training tokens, so that the
probabilities of all words and one unknown word for each tail class sum to one. Weights are learned by trainers that
together read every training text, in rounds; after each round their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recurrent
from .shared import crc_mod, documents, drop_saved, save
from .tokens import slices, text_buffer, words

#: Words whose counts every worker holds, at most; the counts of all others meet their words in a join.
HELD_WORDS = 262_144
#: Words that the recurrent model tells apart, and its tail classes.
MODEL_WORDS, TAILS = 4_096, 32
#: Bytes of training text for each trainer, and rounds.
TRAINER_BYTES, ROUNDS = 10 << 20, 2
COUNTED_AT_ONCE = 3_000_000
#: Bytes of text whose texts share a trainer's lanes.
TRAINED_AT_ONCE = 12 << 20
#: Weights of a chunk, and trainers whose chunks are averaged in one task; averages of more are averaged again.
CHUNK, AVERAGED = 1 << 16, 64
#: A model token in storage.
ID = np.dtype("<u2")
END = np.uint64(0x9E3779B97F4A7C15)
LN10 = float(np.log(10.0))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of texts with an end after each, offsets of the texts, and each token's tail class."""
    h, at, begin, end = words(column, white_space_only=True)
    raw, _ = text_buffer(column)
    n = len(at) - 1
    off = at + np.arange(n + 1)
    out, tail = np.full(int(off[-1]), END, np.uint64), np.zeros(int(off[-1]), np.int16)
    word = np.ones(len(out), bool)
    word[off[1:] - 1] = False
    out[word] = h
    if len(h):
        at = end - 1
        last = raw[at].astype(np.int16)
        at -= 1
        prior = raw[at] * (at >= begin)  # 0 for words of one byte
        tail[word] = (last * 31 + prior * np.int16(7)) % TAILS
    return out, off, tail


def training(df: DataFrame) -> DataFrame:
    """The rows to learn from; a null text is an empty one."""
    return df.where(F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(True)))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, tail, c): how often each token occurs in the texts, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.uint64)
            tail = np.concatenate([x[1] for x in held]) if held else np.zeros(0, np.int16)
            order = np.argsort(h)
            h, tail = h[order], tail[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[first].astype(np.int64)), pa.array(tail[first]), pa.array(np.diff(np.append(first, len(h))))], names=["h", "tail", "c"])

        for batch in batches:
            for x in slices(batch, "text"):
                h, _, tail = tokens_of(x.column("text"))
                held.append((h, tail))
                size += len(h)
                if size >= COUNTED_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return docs.select("text").mapInArrow(run, "h long, tail short, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


class Vocabulary:
    """Held words by descending count: hashes, counts and tail classes, with a direct table for look-up."""

    SHIFT = 64 - 21

    def __init__(self, h: np.ndarray, c: np.ndarray, tail: np.ndarray, tokens: int, distinct: int, tail_tokens: np.ndarray, tail_words: np.ndarray):
        self.h, self.c, self.tail, self.tokens, self.distinct = h, c, tail, tokens, distinct
        self.model = min(MODEL_WORDS, len(h))
        self.tail_tokens, self.tail_words = tail_tokens, tail_words
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def ready(self) -> Vocabulary:
        """Tables that are made in each worker."""
        slot = (self.sorted >> np.uint64(self.SHIFT)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange(1 << (64 - self.SHIFT))).astype(np.int32)
        self.deepest = int(np.bincount(slot).max(initial=0))
        self.padded = np.append(self.sorted, np.zeros(self.deepest + 1, np.uint64))
        self.places = np.append(self.order, np.zeros(self.deepest + 1, np.int64))
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each token among the held words, -1 for others."""
        k = self.first[(h >> np.uint64(self.SHIFT)).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        if not len(self.h):
            return out
        left = np.arange(len(h))
        for _ in range(self.deepest):
            seen = self.padded[k]
            hit = (seen == h[left]) & (k < len(self.h))
            out[left[hit]] = self.places[k[hit]]
            go = ~hit & (seen < h[left]) & (k < len(self.h))
            left, k = left[go], k[go] + 1
            if not len(left):
                break
        return out

    def model_ids(self, place: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.where((place >= 0) & (place < self.model), place, self.model + tail).astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the held words are those above a count, so that no task sends more of them than there are; of the last count's words,
    # about as many as there is room for, by their hashes
    band, share = F.floor(F.log2("c") * 64), F.shiftrightunsigned("h", 11).cast("double") / 2.0**53
    room, held = HELD_WORDS, F.lit(False)
    for r in sorted(counts.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):  # at most 64 bands for each doubling
        held = (band > r.b) | ((band == r.b) & (share < min(1.0, room / r.n)))
        if r.n > room:
            break
        room -= r.n
    top = counts.where(held).select("h", "c", "tail").toArrow()  # columns, no row objects on the driver
    h, c, tail = (top.column(k).to_numpy().astype(t) for k, t in (("h", np.uint64), ("c", np.int64), ("tail", np.int64)))
    order = np.lexsort((h, -c))
    h, c, tail = h[order], c[order], tail[order]
    by = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(TAILS), np.zeros(TAILS)
    for r in by:
        tokens[r.tail], distinct[r.tail] = r.n, r.v
    k = min(MODEL_WORDS, len(h))
    tokens -= np.bincount(tail[:k], weights=c[:k], minlength=TAILS)
    distinct -= np.bincount(tail[:k], minlength=TAILS)
    return Vocabulary(h, c, tail, total.n or 0, total.v or 0, tokens, distinct)


_ready: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    v = shared.value
    if id(v) not in _ready:
        _ready.clear()
        _ready[id(v)] = v.ready()
    return v


def encode(docs: DataFrame, vocab) -> DataFrame:
    """Texts as tokens of the recurrent model (``ids``), with all that a score needs besides its probability; saved.

    ``docs``: doc_id, held_out, text. ``rest`` is the log10 of held words' shares of their tail classes, ``cold`` the words that are not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocab)
        log_c = np.log10(np.append(v.c, 0) + 1.0)  # the last place, -1: not held
        log_tail = np.log10(v.tail_tokens + v.tail_words + 1.0)
        base_log = np.log10(v.tokens + v.distinct + 1)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for x in slices(batch, "text"):
                h, off, tail = tokens_of(x.column("text"))
                place = v.find(h)
                ids = v.model_ids(place, tail)
                n, rows = np.diff(off), x.num_rows
                text = np.repeat(np.arange(rows), n)
                lc = log_c[place]
                base = np.bincount(text, weights=lc, minlength=rows) - n * base_log
                tails = np.flatnonzero(ids >= v.model)
                rest = np.bincount(text[tails], weights=lc[tails] - log_tail[tail[tails]], minlength=rows).astype(float)  # of no words: integers
                cold = np.flatnonzero(place < 0)
                missing = np.bincount(text[cold], minlength=rows)
                at = np.concatenate(([0], np.cumsum(missing)))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h[cold].astype(np.int64)))
                tokens = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((off * ID.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(ID))])
                cols = [pa.array(row + np.arange(rows)), x.column("doc_id"), x.column("held_out"), x.column("size"), pa.array(n), pa.array(n - missing), pa.array(base), pa.array(rest), lists, tokens]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "size", "n_tokens", "n_known", "base_score", "rest", "cold", "ids"])
                row += rows

    kinds = "row long, doc_id long, held_out boolean, size int, n_tokens long, n_known long, base_score double, rest double, cold array<long>, ids binary"
    return save(docs.select("doc_id", "held_out", "text", F.octet_length("text").alias("size")).mapInArrow(run, kinds), "lm-ids")


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a batch's texts, and their offsets."""
    ids = batch.column("ids").cast(pa.large_binary())
    _, at, raw = ids.buffers()
    off = np.frombuffer(at, np.int64)[ids.offset : ids.offset + len(ids) + 1] // ID.itemsize
    return np.frombuffer(raw, ID, int(off[-1]))[off[0] :].astype(np.int32), off - off[0]


def train(docs: DataFrame, vocab, first: np.ndarray) -> np.ndarray:
    """Weights after all rounds. ``docs``: training texts; ``vocab``: a broadcast Vocabulary."""
    encoded = encode(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), vocab)
    flat = train_encoded(encoded, vocab, first)
    drop_saved(encoded)
    return flat


def train_encoded(encoded: DataFrame, vocab, first: np.ndarray) -> np.ndarray:
    """Weights after all rounds over rows of ``encode``."""
    spark = encoded.sparkSession
    words_, tails = vocab.value.model, TAILS
    size = encoded.agg(F.sum("size").alias("b")).first().b or 0
    trainers = max(1, round(size / TRAINER_BYTES))
    own = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(trainers)).cast("int")
    dealt = encoded.select("doc_id", own.alias("_t"), "size", "ids").repartitionById(trainers, F.col("_t")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "ids").select("_t", "size", "ids")
    flat = first
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = recurrent.Trainer(recurrent.unpack(now.value, words_, tails), words_, tails)
            me = 0
            for batch in batches:
                for x in slices(batch, "size", TRAINED_AT_ONCE):
                    me = x.column("_t")[0].as_py()
                    t.learn(*ids_of(x))
            if t.tokens:
                w = recurrent.pack(t.p)
                parts = [w[i : i + CHUNK].tobytes() for i in range(0, len(w), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([me] * len(parts), pa.int32()), pa.array([t.tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "t", "tokens", "w"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, tokens, total = None, 0, 0.0

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], names=["chunk", "t", "tokens", "w"])

            for x in batches:
                for k, g, n, w in zip(*(x.column(c).to_pylist() for c in ("chunk", "t", "tokens", "w"))):
                    if now is not None and now != (k, g):
                        yield done()
                    if now != (k, g):
                        now, tokens, total = (k, g), 0, 0.0
                    tokens, total = tokens + n, total + n * np.frombuffer(w, np.float32).astype(np.float64)
            if now is not None:
                yield done()

        rows, groups, kinds = dealt.mapInArrow(run, "chunk int, t int, tokens long, w binary"), trainers, "chunk int, t int, tokens long, w binary"
        while True:  # a level for each power of AVERAGED; no task averages more than so many at a time
            groups = -(-groups // AVERAGED)
            keys = ["chunk", "_g"]
            rows = rows.withColumn("_g", F.floor(F.col("t") / AVERAGED).cast("int")).repartition(*keys).sortWithinPartitions(*keys, "t")
            rows = rows.select("chunk", F.col("_g").alias("t"), "tokens", "w").mapInArrow(average, kinds)
            if groups == 1:
                break
        rows = rows.collect()  # one model
        if rows:
            flat = np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(rows, key=lambda r: r.chunk)])
    return flat


def score_documents(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, held_out, text).

    Scores are log10 probabilities of whole texts. Null and empty texts have the end token alone. Without training texts
    every word is unknown. A repeated row gets its score again; other columns are not read. Without ``learn_from``
    the rows that are not held out are learned from, and no text becomes tokens a second time for its score.
    """
    spark = docs.sparkSession
    counts = save(count_tokens(docs.where("not held_out") if learn_from is None else learn_from), "token-counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    start = recurrent.pack(recurrent.start(np.concatenate([v.c[: v.model], v.tail_tokens]), TAILS))
    encoded = encode(docs, shared)  # a text becomes tokens once, for training and for its score
    weights = spark.sparkContext.broadcast(train_encoded(encoded.where("not held_out"), shared, start) if learn_from is None else train(learn_from, shared, start))
    model, passed = v.model, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "cold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = recurrent.unpack(weights.value, model, TAILS)
        for batch in batches:
            for x in slices(batch, "size", 12 << 20):
                score = recurrent.score(p, *ids_of(x), model, TAILS) / LN10 + x.column("rest").to_numpy()
                yield pa.RecordBatch.from_arrays([*(x.column(k) for k in passed), pa.array(score)], names=[*passed, "score"])

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, cold array<long>, score double"
    part = save(encoded.select(*passed, "size", "rest", "ids").mapInArrow(run, kinds), "lm-parts")
    drop_saved(encoded)
    cold = part.select("row", F.explode("cold").alias("h")).join(counts.select("h", "c"), "h")
    more = cold.groupBy("row").agg(F.count("*").alias("_k"), F.sum(F.log10(F.col("c") + 1.0)).alias("_s"))
    extra = F.coalesce("_s", F.lit(0.0))
    return part.drop("cold").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"), F.lit(int(v.tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return score_documents(docs.withColumn("held_out", held_out))
