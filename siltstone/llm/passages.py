"""Repeated passages by a sparse suffix array.

Of each text only the suffixes at minimisers are kept: the place of the least hash among the 25 runs of 26 words that a
stretch of 50 words holds. Equal stretches of 50 words have the same minimiser, whatever surrounds them, so no repeat of 50
words is without a kept suffix on both sides. Suffixes are sorted, by their first 26 words, then the 24 that follow, then
text and place, over ranges that may part a frequent beginning; each is compared with its neighbour, the nearest suffix of
another text before it that begins alike. Neighbours at one distance in successive suffixes grow into passages, since
these overlap. At the ends of these the match is extended left and right to all stretches of 50 words whose minimiser it is,
and these are compared too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, save
from .tokens import mix, ngrams, slices, words

MIN_WORDS = 50
PREFIX = 26
SPREAD = MIN_WORDS - PREFIX + 1
#: About so many suffixes are sorted in one task.
SORTED_AT_ONCE = 1_000_000


def minimisers(prefix: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each word the place of the least prefix hash among the next SPREAD places; ties go to the first. -1 where no stretch begins."""
    n = len(prefix)
    value = np.where(whole, mix(prefix ^ np.uint64(0xA5A5A5A5DEADBEEF)), np.uint64(2**64 - 1))
    place = np.arange(n)
    span = 1
    while span < SPREAD:
        step = min(span, SPREAD - span)
        take = value[step:] < value[:-step] if step < n else np.zeros(0, bool)
        value, place = value.copy(), place.copy()
        value[: len(take)][take] = value[step:][take]
        place[: len(take)][take] = place[step:][take]
        span += step
    return place


def stretches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, the minimiser of the stretch at each word and whether a stretch of MIN_WORDS begins there."""
    prefix, whole = ngrams(h, at, PREFIX)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(h)) >= MIN_WORDS
    return prefix, minimisers(prefix, whole), room


def kept_suffixes(docs: DataFrame) -> DataFrame:
    """(prefix, tail, doc_id, place) of each text's minimisers: hashes of the first 26 words and of those that follow, up to 50."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, "text"):
                h, at, _, _ = words(x.column("text"))
                prefix, least, room = stretches(h, at)
                place = least[room]
                place = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
                doc = np.searchsorted(at, place, side="right") - 1
                rest, whole = ngrams(h, at, SPREAD - 1)
                after = np.minimum(place + PREFIX, max(len(h) - 1, 0))
                tail = np.where(place + MIN_WORDS <= at[doc + 1], rest[after], np.uint64(0))  # a suffix that ends before has none
                yield pa.RecordBatch.from_arrays([pa.array(prefix[place].astype(np.int64)), pa.array(tail.astype(np.int64)), x.column("doc_id").take(pa.array(doc)), pa.array((place - at[doc]).astype(np.int32))], names=["prefix", "tail", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, "prefix long, tail long, doc_id long, place int")


#: What a neighbour row is: matched; at the start of a range, where the range before decides; the first of its beginning at
#: the end of a range, where the next range decides; and a border row: the last two texts of a range, and its first two.
MATCHED, ASKS_BEFORE, ASKS_AFTER, LAST, FIRST = range(5)


def neighbours(suffixes: DataFrame) -> DataFrame:
    """(doc_id, place, other, there, first, prefix) of each suffix whose first 26 words another text holds.

    (other, there) is the neighbour before it in suffix order, of another text; the first text of a beginning has the one
    after it instead (first). Each range of the order is compared in its task; what stands at a range's border meets the
    last texts of the ranges before, or the first of those behind, which are a few rows for each range.
    """
    spark = suffixes.sparkSession
    ranges = max(1, -(-suffixes.count() // SORTED_AT_ONCE))
    keys = ["prefix", "tail", "doc_id", "place"]
    ordered = suffixes.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("range"), *keys)
    schema = "range int, kind int, doc_id long, place int, other long, there int, first boolean, prefix long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        x = pa.Table.from_batches(held).combine_chunks()
        part, prefix, doc, place = (x.column(c).to_numpy() for c in ("range", "prefix", "doc_id", "place"))
        n, at = len(doc), np.arange(len(doc))
        group = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        of = np.searchsorted(group, at, side="right") - 1
        lo, hi = group[of], np.append(group[1:], n)[of]
        turn = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (doc[1:] != doc[:-1]))))
        run_of = np.searchsorted(turn, at, side="right") - 1
        before, after = turn[run_of] - 1, np.append(turn[1:], n)[run_of]
        has, has_next = before >= lo, after < hi
        open_start, open_end = ~has & (lo == 0), ~has & ~has_next & (hi == n)
        kind = np.where(has, MATCHED, np.where(open_start, ASKS_BEFORE, np.where(has_next, MATCHED, ASKS_AFTER)))
        keep = np.flatnonzero(has | open_start | has_next | open_end)
        near = np.where(has, before, np.where(has_next, after, -1))[keep]
        # border rows: the last text of the range and the last other text that begins alike, and likewise the first ones
        edge, edge_kind = [n - 1, 0], [LAST, FIRST]
        if before[-1] >= lo[-1]:
            edge, edge_kind = [*edge, before[-1]], [*edge_kind, LAST]
        if after[0] < hi[0]:
            edge, edge_kind = [*edge, after[0]], [*edge_kind, FIRST]
        rows = np.concatenate([keep, edge])
        near = np.concatenate([near, np.full(len(edge), hi[0] == n)])  # of border rows: whether the range is one beginning
        none = np.concatenate([near[: len(keep)] < 0, np.zeros(len(edge), bool)])
        border = np.arange(len(rows)) >= len(keep)
        second = np.maximum(0, np.arange(len(rows)) - len(keep) - 1)  # of border rows: 0 for those at the very border
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[rows]), pa.array(np.concatenate([kind[keep], edge_kind]).astype(np.int32)), pa.array(doc[rows]), pa.array(place[rows]),
                pa.array(np.where(border, near, doc[near]), mask=none), pa.array(np.where(border, second, place[near]).astype(np.int32), mask=none), pa.array(~np.append(has[keep], np.ones(len(edge), bool))), pa.array(prefix[rows]),
            ],
            names=["range", "kind", "doc_id", "place", "other", "there", "first", "prefix"],
        )

    found = save(ordered.mapInArrow(run, schema), "suffix-neighbours")
    borders: dict[int, dict[int, list]] = {}
    for r in found.where(F.col("kind") >= LAST).collect():  # four rows for each range at most
        borders.setdefault(r.range, {LAST: [], FIRST: []})[r.kind].append(r)
    for both in borders.values():
        for rows in both.values():
            rows.sort(key=lambda r: r.there > 0)
    carried = [(0, *r) for r in _carry(borders, sorted(borders), FIRST, LAST)] + [(1, *r) for r in _carry(borders, sorted(borders, reverse=True), LAST, FIRST)]
    from_ = spark.createDataFrame(carried, "_side int, range int, prefix long, _nth int, _doc long, _place int")
    here = found.where(F.col("kind").isin(ASKS_BEFORE, ASKS_AFTER))
    asked = here.join(F.broadcast(from_), ["range", "prefix"], "left").where(F.col("_doc").isNull() | (F.col("_doc") != F.col("doc_id")))
    side = lambda k: F.min(F.when((F.col("_side") == k), F.struct("_nth", "_doc", "_place")))
    resolved = (
        asked.groupBy("doc_id", "place", "prefix", "other", "there").agg(side(0).alias("b"), side(1).alias("a"))
        .select("doc_id", "place", F.coalesce("b._doc", "other", "a._doc").alias("other"), F.coalesce("b._place", "there", "a._place").alias("there"), F.col("b").isNull().alias("first"), "prefix")
        .where("other is not null")
    )
    return found.where(F.col("kind") == MATCHED).select("doc_id", "place", "other", "there", "first", "prefix").union(resolved)


def _carry(borders: dict[int, dict[int, list]], order: list[int], near: int, far: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(range, prefix, nth, doc_id, place): for each range the texts, two at most and the nearest first, with which the ranges on one side end in its own beginning."""
    prefix, texts = None, []
    for p in order:
        start, end = borders[p][near][0], borders[p][far][0]
        if prefix == start.prefix:
            yield from ((p, prefix, i, *t) for i, t in enumerate(texts))
        own = [(r.doc_id, r.place) for r in borders[p][far]]
        if end.other and prefix == end.prefix:  # the range is one beginning, that of the ranges before
            own += [t for t in texts if t[0] not in {d for d, _ in own}]
        prefix, texts = end.prefix, own[:2]


def grow(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Passages and stretches of texts with their matched suffixes.

    ``texts``: doc_id, text; ``suffixes``: as ``neighbours`` has them. A text meets its suffixes in a task that holds one
    text's at a time. Returns (doc_id, start, stop, other, stretch, check): passages of 50 words or more that neighbours at
    one distance cover, on both sides (stretch null); and each stretch that may be repeated but is in no such passage, or
    belongs to the first text of its beginning, with two hashes of its words.
    """
    both = (
        texts.select("doc_id", F.lit(0).alias("kind"), "text", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("int").alias("there"), F.lit(None).cast("boolean").alias("first"), F.lit(None).cast("long").alias("prefix"))
        .union(suffixes.select("doc_id", F.lit(1), F.lit(None).cast("string"), "place", "other", "there", "first", "prefix"))
        .repartition("doc_id").sortWithinPartitions("doc_id", "kind", "place")
    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows in runs that end between two texts."""
        held: list[pa.RecordBatch] = []
        for x in batches:
            ids = x.column("doc_id").to_numpy()
            if held and len(ids) and held[-1].column("doc_id")[-1].as_py() != ids[0]:
                yield pa.Table.from_batches(held)
                held = []
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if cut:
                yield pa.Table.from_batches([*held, x.slice(0, cut)])
                held = []
            if len(ids) > cut:
                held.append(x.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete(batches):
            kind = table.column("kind").to_numpy()
            rows = table.filter(pa.array(kind == 1))
            if not rows.num_rows:
                continue
            owner, place, other, there, first, begins = (rows.column(c).to_numpy() for c in ("doc_id", "place", "other", "there", "first", "prefix"))
            own = table.filter(pa.array(kind == 0)).select(["doc_id", "text"]).combine_chunks()
            for batch in own.to_batches():
                lo = np.searchsorted(owner, batch.column("doc_id").to_numpy())
                hi = np.searchsorted(owner, batch.column("doc_id").to_numpy(), side="right")
                some = np.flatnonzero(hi > lo)
                asked = pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), batch.column("text").take(pa.array(some)), pa.array(lo[some]), pa.array(hi[some])], names=["doc_id", "text", "lo", "hi"])
                for x in slices(asked, "text"):
                    yield _grown(x, place, other, there, first, begins)

    return both.mapInArrow(run, "doc_id long, start int, stop int, other long, stretch long, check int")


def _grown(x: pa.RecordBatch, place_: np.ndarray, other_: np.ndarray, there_: np.ndarray, first_: np.ndarray, begins_: np.ndarray) -> pa.RecordBatch:
    h, at, _, _ = words(x.column("text"))
    prefix, least, room = stretches(h, at)
    whole, _ = ngrams(h, at, MIN_WORDS)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))))
    out: list[tuple] = []
    doc_col, start_col, hash_col, check_col = [], [], [], []
    for i, (doc, lo_, hi_) in enumerate(zip(*(x.column(c).to_pylist() for c in ("doc_id", "lo", "hi")))):
        lo, n = int(at[i]), int(at[i + 1] - at[i])
        starts = np.flatnonzero(room[lo : lo + n])
        if not len(starts):
            continue
        mine = least[lo : lo + len(starts)] - lo  # stretches begin at 0, 1, ... as long as there is room
        place, other, there, first = place_[lo_:hi_], other_[lo_:hi_], there_[lo_:hi_], first_[lo_:hi_]
        here = (place < n) & (prefix[lo + np.minimum(place, n - 1)].astype(np.int64) == begins_[lo_:hi_])  # else of another row of this doc_id
        place, other, there, first = place[here], other[here], there[here], first[here]
        if not len(place):
            continue
        rank = np.searchsorted(np.unique(mine), place)
        same = (rank[1:] - rank[:-1] == 1) & (other[1:] == other[:-1]) & (there[1:] - there[:-1] == place[1:] - place[:-1])
        edge = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        inside = np.zeros(len(starts), bool)
        for a, b in zip(edge[:-1], edge[1:] - 1):
            begin, stop = int(place[a]), int(place[b]) + PREFIX
            if stop - begin >= MIN_WORDS:
                out.append((doc, begin, stop, int(other[a])))
                out.append((int(other[a]), int(there[a]), int(there[a]) + stop - begin, doc))
                inside[begin : stop - MIN_WORDS + 1] = True
        k = np.minimum(np.searchsorted(place, mine), len(place) - 1)
        ask = np.flatnonzero((place[k] == mine) & (~inside | first[k]))
        doc_col.append(np.full(len(ask), doc))
        start_col.append(ask)
        hash_col.append(whole[lo + ask])
        check_col.append(sums[lo + ask + MIN_WORDS] - sums[lo + ask])
    n = sum(map(len, doc_col))
    cat = lambda c, t: np.concatenate([*c, np.zeros(0, t)]).astype(t)
    begin = cat(start_col, np.int64)
    cols = [
        pa.array(np.concatenate([np.array([o[0] for o in out], np.int64), cat(doc_col, np.int64)])),
        pa.array(np.concatenate([np.array([o[1] for o in out], np.int64), begin]).astype(np.int32)),
        pa.array(np.concatenate([np.array([o[2] for o in out], np.int64), begin + MIN_WORDS]).astype(np.int32)),
        pa.array([o[3] for o in out] + [None] * n, pa.int64()),
        pa.concat_arrays([pa.nulls(len(out), pa.int64()), pa.array(cat(hash_col, np.uint64).astype(np.int64))]),
        pa.concat_arrays([pa.nulls(len(out), pa.int32()), pa.array((cat(check_col, np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32))]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "stop", "other", "stretch", "check"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id): the passages of each text whose every 50 words occur in another text.

    Passages are as long as they can be; those that overlap or touch are one. other_doc_id is the smallest other text seen
    with a part of it. Repeats within one text alone do not count, and rows of one doc_id are one text. Null and empty texts
    and texts under 50 words have none; rows with a null doc_id are left out. Other columns are not read.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    near = neighbours(save(kept_suffixes(rows), "suffixes"))
    found = save(grow(rows, near), "passages")
    asked = found.where("stretch is not null")
    keys = ["stretch", "check"]
    # written, so that the join deals both sides out anew and may split a stretch that a third of all texts hold
    twice = save(asked.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi"), "repeated-stretches")
    again = asked.select("doc_id", "start", "stop", *keys).join(twice, keys).select("doc_id", "start", "stop", F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    grown = found.where("stretch is null").groupBy("doc_id", "start", "stop").agg(F.min("other").alias("other"))
    ahead = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        grown.union(again).withColumn("_far", F.max("stop").over(ahead))
        .withColumn("_new", F.coalesce(F.col("start") > F.col("_far"), F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_new").over(upto))
        .groupBy("doc_id", "_island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other").alias("other_doc_id"))
    )
    return merged.select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "other_doc_id")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
