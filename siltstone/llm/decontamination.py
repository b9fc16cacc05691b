"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .tokens import ngrams, slices, words
from .worker import task

SEED_WORDS = 3
#: Of an item's n-grams, the rarer half in the corpus are seeds, and all that at most this share of texts hold.
RARE_SHARE = 1e-4
#: Seeds at different places of an item that must fall together before it is aligned; items with few seeds need one.
MIN_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score over that of a whole copy.
MIN_SCORE = 0.55
#: Items are searched in blocks of so many words at most; this bounds what each worker holds.
BLOCK_WORDS = 2_000_000


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, first, end) with the place in b. Ties: the first end in a, then in b."""
    n = len(b)
    at = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), at.copy()
    best, span = 0, (0, 0)
    for x in a:
        diagonal = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = row[1:] + GAP
        take = diagonal >= up
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.where(take, diagonal, up), 0)
        came = at.copy()
        came[1:] = np.where(new[1:] > 0, np.where(take, origin[:-1], origin[1:]), at[1:])
        # gaps along the row: the best earlier cell less its distance, by a running maximum
        reach = np.maximum.accumulate(new - GAP * at)
        along = reach + GAP * at
        if (along > new).any():
            keys = new - GAP * at
            source = np.maximum.accumulate(np.where(keys == reach, at, 0))
            came = np.where(along > new, came[source], came)
            new = np.maximum(along, new)
        row, origin = new, came
        k = int(row.argmax())
        if row[k] > best:
            best, span = int(row[k]), (int(origin[k]), k)
    return best, *span


class Items:
    """Benchmark items as word hashes with their n-grams; some of them are seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, at, _, _ = words(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [h[s:e] for s, e in zip(at[:-1], at[1:])]
        self.n = SEED_WORDS
        grams, whole = ngrams(h, at, self.n)
        self.grams = [grams[s:e][whole[s:e]] for s, e in zip(at[:-1], at[1:])]
        self.table = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))

    def choose(self, df: np.ndarray, texts: int) -> None:
        """Keep the seeds: sorted hashes, and for each the (item, place) pairs that have it. ``df``: texts that hold each n-gram of the table."""
        places = defaultdict(list)
        self.need = []
        for i, g in enumerate(self.grams):
            count = df[np.searchsorted(self.table, g)]
            rare = count <= max(RARE_SHARE * texts, float(np.median(count)) if len(count) else 0)
            for p in np.flatnonzero(rare):
                places[int(g[p])].append((i, int(p)))
            self.need.append(min(MIN_SEEDS, max(1, int(rare.sum()) // 4)))
        self.seeds = np.array(sorted(places), np.uint64)
        self.places = [places[int(s)] for s in self.seeds]
        self.filter = bits(self.seeds)


def bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[values >> np.uint64(48)] = True
    return out


def find(values: np.ndarray, whole: np.ndarray, table: np.ndarray, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that are in the sorted table, and their places there."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.flatnonzero(filter_[values >> np.uint64(48)] & whole)
    k = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    hit = table[k] == values[maybe]
    return maybe[hit], k[hit]


def count_grams(docs: DataFrame, items) -> np.ndarray:
    """In how many texts each n-gram of the items' table occurs. The driver holds two numbers for each, no row objects."""

    @task("decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        f, total = bits(it.table), np.zeros(len(it.table), np.int64)
        for batch in batches:
            for x in slices(batch, "text"):
                h, at, _, _ = words(x.column("text"))
                g, whole = ngrams(h, at, it.n)
                p, k = find(g, whole, it.table, f)
                doc = np.searchsorted(at, p, side="right")
                pair = np.unique(doc * np.int64(len(it.table)) + k)
                total += np.bincount(pair % len(it.table), minlength=len(it.table)) if len(pair) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(it.table[some].astype(np.int64)), pa.array(total[some])], names=["g", "n"])

    rows = docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    table = items.value.table
    out = np.zeros(len(table), np.int64)
    out[np.searchsorted(table, rows.column("g").to_numpy().astype(np.uint64))] = rows.column("n").to_numpy()
    return out


def matches(it: Items, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(row, item_id, score, first word, end word) for each text and item that align well: the best place of each."""
    out = []
    h, at, _, _ = words(texts)
    g, whole = ngrams(h, at, it.n)
    places, seeds = find(g, whole, it.seeds, it.filter)
    doc = np.searchsorted(at, places, side="right") - 1
    hits = defaultdict(list)
    for p, k, d in zip(places.tolist(), seeds.tolist(), doc.tolist()):
        for i, q in it.places[k]:
            hits[d, i].append((p, q))
    for (d, i), got in hits.items():
        m, best, first = len(it.words[i]), (0.0, 0, 0), 0
        for j in range(1, len(got) + 1):  # seeds less than two lengths of the item apart stand together
            if j < len(got) and got[j][0] - got[j - 1][0] <= 2 * m:
                continue
            near, first = got[first:j], j
            if len({q for _, q in near}) < it.need[i]:
                continue
            lo, hi = max(int(at[d]), near[0][0] - m), min(int(at[d + 1]), near[-1][0] + it.n + m)
            s, b, e = smith_waterman(it.words[i], h[lo:hi])
            score = s / (MATCH * m)
            if score > best[0]:
                best = (score, lo + b - int(at[d]), lo + e - int(at[d]))
        if best[0] >= MIN_SCORE:
            out.append((d, it.ids[i], *best))
    return out


def align(docs: DataFrame, items) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of all matches."""

    @task("decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, "text"):
                out = matches(items.value, x.column("text"))
                ids = x.column("doc_id").take(pa.array([o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array([o[k] for o in out], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long")


def item_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast blocks of the benchmark's items, their seeds chosen by counts over all texts."""
    spark = docs.sparkSession
    usable = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = usable.agg(F.sum(F.size(F.split("text", "\\s+"))).alias("w")).first().w or 0
    blocks = max(1, -(-size // BLOCK_WORDS))
    texts = docs.count() if size else 0
    for b in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        it = Items([r.item_id for r in rows], [r.text for r in rows])
        it.choose(count_grams(docs, spark.sparkContext.broadcast(it)), texts)
        yield spark.sparkContext.broadcast(it)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Training texts that hold a benchmark item or an edited copy of it: (doc_id, item_id, score, start_word, end_word).

    Each item's rarer n-grams, by their counts over all texts, are seeds; where enough of them fall together in a text, the
    item is aligned with that stretch. The seeds are relative to the item, so an item that a third of all texts hold keeps
    them. Null and empty texts and items, and items of fewer than three words, match nothing; a repeated row gives its
    matches again, and a repeated item_id its own; a text has one row for each item, its best place (ties: the first).
    Other columns are not read. Benchmarks beyond ``BLOCK_WORDS`` words are searched in blocks.
    """
    out = None
    for items in item_blocks(docs, benchmark):
        found = align(docs, items)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text ``contaminated`` finds in no item; null texts stay. Nothing is shuffled but counts."""
    for items in item_blocks(docs, benchmark):

        @F.pandas_udf("boolean")
        @task("decontamination")
        def hit(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in column:
                out = np.zeros(len(texts), bool)
                batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
                at = 0
                for x in slices(batch, "text"):
                    out[[at + m[0] for m in matches(items.value, x.column("text"))]] = True
                    at += x.num_rows
                yield pd.Series(out)

        docs = docs.where(~hit("text"))
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
