"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal bytes. In the ideal mixture all sources that still have blocks are read at
once, each at a rate in proportion to its weight. By virtual time v a source of weight w and n blocks has given min(w v, n)
blocks there, so v comes at slot T(v), the sum of these over all sources, and its block k is read from T(k / w) to
T((k + 1) / w): it is released at the floor of the first and due before the ceiling of the second. One slot takes one block,
and of the released blocks the one with the earliest deadline goes first. The ideal reading itself fits the windows, so
earliest deadline first meets all deadlines, and after any number of slots a source is less than one block off its given
weight; when a source runs out, the others' rates rise and nothing is dropped. Weights and windows are exact integers.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, save

BLOCK_BYTES = 256 << 10
#: Without given weights a source weighs its bytes to this power.
EXPONENT = 0.5
#: About so many rows are ranked in one task.
RANKED_ROWS = 5_000
#: Bytes of text in a part of the written mixture.
PART_BYTES = 64 << 20
#: Slots that the scheduler hands on together.
BATCH = 50_000
NEW = ["block", "phase", "release", "deadline", "slot", "offset"]


class Ideal:
    """Exact times of the ideal mixture: sources (name, blocks, weight) by the virtual time at which they run out."""

    def __init__(self, sources: Iterable[tuple[str, int, float]]):
        kept = [(s, n, Fraction(w)) for s, n, w in sources if n > 0]
        scale = max((w.denominator for *_, w in kept), default=1)  # powers of two
        kept.sort(key=lambda r: (Fraction(r[1]) / r[2], r[0]))
        self.names = [s for s, *_ in kept]
        self.blocks = [n for _, n, _ in kept]
        self.weights = [int(w * scale) for *_, w in kept]
        self.ends = [n / w for n, w in zip(self.blocks, self.weights)]
        self.done, self.rest = [0], [sum(self.weights)]
        for n, w in zip(self.blocks, self.weights):
            self.done.append(self.done[-1] + n)
            self.rest.append(self.rest[-1] - w)

    def phase(self, i: int, k: int) -> int:
        """How many sources have run out before source i has given k blocks."""
        w, p = self.weights[i], bisect_left(self.ends, k / self.weights[i])
        while p < len(self.ends) and self.blocks[p] * w < k * self.weights[p]:  # the look-up is by rounded quotients
            p += 1
        while p and self.blocks[p - 1] * w >= k * self.weights[p - 1]:
            p -= 1
        return p

    def time(self, i: int, k: int, phase: int) -> tuple[int, int]:
        """Floor and ceiling of the slot by which source i has given k blocks."""
        w = self.weights[i]
        q, r = divmod(k * self.rest[phase] + self.done[phase] * w, w)
        return q, q + (r > 0)


def schedule(ideal: Ideal) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source's place, block, phase, release, deadline, slot) of all blocks by slot, earliest deadline first.

    Each source has one block in hand at a time, so memory grows with the sources and not with the blocks. Ties go to the
    source that runs out first, then by name.
    """
    ready, waiting = [], []
    phase, release = [0] * len(ideal.names), [0] * len(ideal.names)
    after = [(0, 0, 0)] * len(ideal.names)

    def window(i: int, k: int) -> int:
        p = ideal.phase(i, k + 1)
        low, high = ideal.time(i, k + 1, p)
        after[i] = (low, high, p)
        return high

    for i in range(len(ideal.names)):
        ready.append((window(i, 0), i, 0))
    heapq.heapify(ready)
    slot = 0
    while ready or waiting:
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(i, k), i, k))
        deadline, i, k = heapq.heappop(ready)
        yield i, k, phase[i], release[i], deadline, slot
        slot += 1
        release[i], _, phase[i] = after[i]
        if k + 1 < ideal.blocks[i]:
            if release[i] <= slot:
                heapq.heappush(ready, (window(i, k + 1), i, k + 1))
            else:
                heapq.heappush(waiting, (release[i], i, k + 1))


def scheduled_blocks(sources: DataFrame) -> DataFrame:
    """(_g, block, phase, release, deadline, slot) of all blocks of ``sources`` (_g, n, w), streamed from one task.

    The schedule is a sequence, so one task makes it; it holds a few numbers for each source and hands its slots on in
    batches. Slots are as many as blocks: for more bytes take larger blocks, or more time (about 3 us a slot).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for x in batches for r in zip(*(x.column(c).to_pylist() for c in ("_g", "n", "w")))]
        ideal = Ideal(rows)
        names, held = pa.array(ideal.names, pa.string()), []

        def batch() -> pa.RecordBatch:
            x = np.array(held, np.int64).reshape(len(held), 6)
            return pa.RecordBatch.from_arrays([names.take(pa.array(x[:, 0])), *(pa.array(x[:, c].copy()) for c in range(1, 6))], names=["_g", "block", "phase", "release", "deadline", "slot"])

        for r in schedule(ideal):
            held.append(r)
            if len(held) == BATCH:
                yield batch()
                held = []
        yield batch()

    return sources.select("_g", "n", "w").repartition(1).mapInArrow(run, "_g string, block long, phase long, release long, deadline long, slot long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the group of its source, a hash of its doc_id, its bytes and a key that equal rows share."""
    named = lambda c, none: (F.coalesce(c, F.lit(none)), F.col(c).isNull())
    parts = [*named("doc_id", 0), *named("source", ""), *named("text", "")]
    return docs.withColumns(
        {
            # a null source is one of its own, apart from every name
            "_g": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")),
            "_h": F.xxhash64("doc_id"),
            "_b": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
            "_k1": F.xxhash64(*parts),
            "_k2": F.xxhash64(F.lit(1), *reversed(parts)),
        }
    )


def _ranked(docs: DataFrame, weights: dict[str | None, float] | None, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The distinct rows of ``docs`` (_g, _k1, _k2, _b, n, _start, _top): how many equal rows each stands for, the bytes of the source
    before it and the source's last block; and the schedule of all blocks. Texts are read for their bytes and hashes alone:
    none of them is shuffled, and no row reaches the driver.
    """
    spark = docs.sparkSession
    rows = save(_keyed(docs).groupBy("_g", "_h", "_k1", "_k2", "_b").agg(F.count("*").alias("n")), "mixing-rows")
    pieces = max(1, -(-rows.count() // RANKED_ROWS))
    # a source of any size is ranked in pieces by ranges of the hash, whose sums are added up before
    rows = rows.withColumn("_piece", F.floor((F.shiftright("_h", 33) + 2.0**30) / 2.0**31 * pieces).cast("int"))
    sums = save(rows.groupBy("_g", "_piece").agg(F.sum(F.col("_b") * F.col("n")).alias("_s")), "mixing-pieces")
    total = sums.groupBy("_g").agg(F.sum("_s").alias("b"))
    if weights is None:
        weight = F.greatest(F.col("b"), F.lit(1)).cast("double") ** EXPONENT
    else:
        given = {"n" if s is None else "s" + s: float(w) for s, w in weights.items() if w > 0}
        total = total.join(spark.createDataFrame(sorted(given.items()), "_g string, _w double"), "_g", "left")
        weight = F.coalesce("_w", F.lit(min(given.values(), default=1.0)))
    sources = total.select("_g", F.greatest(F.ceil(F.col("b") / block_bytes), F.lit(1)).cast("long").alias("n"), weight.alias("w"))
    blocks = save(scheduled_blocks(sources), "mixing-slots")

    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_g").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_g", "_piece").orderBy("_h", "_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(F.col("_b") * F.col("n")).over(inside), F.lit(0))
    top = blocks.groupBy("_g").agg(F.max("block").alias("_top"))
    placed = rows.join(sums.select("_g", "_piece", before.alias("_before")), ["_g", "_piece"]).withColumn("_start", start).join(top, "_g")
    return placed.select("_g", "_k1", "_k2", "_b", "n", "_start", "_top"), blocks


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, ordered: bool = False) -> DataFrame:
    """``docs`` with block, phase, release, deadline, slot and offset (bytes of the source before the row).

    Order by slot, source, offset to read the mixture; with ``ordered`` the rows come so, part after part, each of about
    PART_BYTES. Within a source rows come by a hash of doc_id. A row lies in the block where it begins; a text longer than a
    block takes its source's following slots too. phase: sources that have run out before the block. Null sources are one
    source of their own; a source without a weight gets the least given one; without weights a source weighs the square
    root of its bytes. Null and empty texts have no bytes. Rows that are equal in doc_id, source and text stand next to each
    other in any order. An empty table gives no rows. Columns of ``docs`` with the new names, or that begin with an
    underscore, are replaced.

    Rows are ranked without their texts, which meet their slots in one join by hash that sorts no text.
    """
    docs = docs.select(*(c for c in docs.columns if c not in NEW and not c.startswith("_")))
    placed, blocks = _ranked(docs.select("doc_id", "source", "text"), weights, block_bytes)
    keys, times = ["_k1", "_k2"], ["phase", "release", "deadline", "slot"]
    block = F.least(F.floor(F.col("offset") / block_bytes), F.col("_top")).alias("block")
    placed = save(placed, "mixing-places")
    own = placed.where("n = 1").withColumn("offset", F.col("_start")).select("_g", *keys, "offset", block).join(blocks, ["_g", "block"])
    out = _keyed(docs).drop("_g").join(own.select(*keys, "offset", "block", *times).hint("shuffle_hash"), keys).select(*docs.columns, *NEW)
    again = placed.where("n > 1")
    if again.limit(1).count():
        spread = _numbered(_keyed(docs).drop("_g", "_b").join(again, keys))
        spread = spread.withColumn("offset", F.col("_start") + F.col("_b") * F.col("_no")).select(*docs.columns, "_g", "offset", block)
        out = out.union(spread.join(blocks, ["_g", "block"]).select(*docs.columns, *NEW))
    if ordered:
        slots = max(1, blocks.count())
        parts = max(1, -(-slots * block_bytes // PART_BYTES))
        out = out.repartitionById(parts, F.floor(F.col("slot") * parts / slots).cast("int")).sortWithinPartitions("slot", "source", "offset", "doc_id")
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _no, from 0 among those of equal _k1 and _k2: counted part by part, so that no task gathers equal rows."""
    keys = ["_k1", "_k2"]
    held = save(rows.withColumn("_part", F.spark_partition_id()), "mixing-repeats")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy(*keys, "_part").count().select(*keys, "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h")) - 1
    return held.withColumn("_no", number).join(before, [*keys, "_part"]).withColumn("_no", F.col("_no") + F.col("_before"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "block", "phase", "release", "deadline", "slot", "offset")
