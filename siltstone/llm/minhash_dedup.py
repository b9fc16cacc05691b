"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF word shingles, banded, verified exactly.

Weight of a shingle in a text: how often it occurs times its idf. idf is 2 for shingles that fewer than a share
``RARE_SHARE`` of all texts hold and falls with the logarithm of that share to 1 for one that all hold, so that boilerplate
counts half. Only the frequent ones need a table; at most (mean shingles of a text) / RARE_SHARE shingles can be frequent,
whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import bits, find
from .shared import components, documents, drop_saved, save
from .tokens import _mix_int, distinct_counts, mix, shingles, slices, words
from .worker import task

SHINGLE_WORDS = 5
MIN_JACCARD = 0.8
#: At a similarity of 0.8, 99.8 of 100 pairs meet in a band.
BANDS, ROWS = 16, 5
SAMPLES = BANDS * ROWS
RARE_SHARE = 0.002
#: Shingles, up to twice as many, that are counted together, and the texts and bytes at least that a counting task reads if there are so many.
COUNTED_AT_ONCE = 4_000_000
COUNTED_TEXTS, COUNTED_BYTES = 25_000, 64 << 20
#: Members of a leader that are compared in one task.
MEMBERS = 2_000
#: Texts of a bucket, beyond its leader's, that are compared with each other in one task.
BLOCK = 1_024

_ODD = np.array([_mix_int(5000 + k) | 1 for k in range(SAMPLES)], dtype=np.uint64)
_pool: dict[str, np.ndarray] = {}


def _draws() -> dict[str, np.ndarray]:
    """Gamma(2, 1) r and c and uniform beta for 2**16 slots; a shingle's slot differs from sample to sample."""
    if not _pool:
        rng = np.random.default_rng(20240607)
        n = 1 << 16
        _pool["r"] = -np.log(rng.random(n) * rng.random(n) + 1e-300)
        _pool["log_c"] = np.log(-np.log(rng.random(n) * rng.random(n) + 1e-300))
        _pool["beta"] = rng.random(n)
        _pool["plain"] = _sample(np.arange(n), np.full(n, np.log(2.0)))
    return _pool


def _sample(slot: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """The sampling value of a weight in the high half of a 64-bit integer; smaller wins, and it is equal only if the quantised weight is."""
    p = _pool
    t = np.floor(log_weight / p["r"][slot] + p["beta"][slot])
    value = (p["log_c"][slot] - p["r"][slot] * (t - p["beta"][slot] + 1)).astype(np.float32)
    raw = value.view(np.uint32)
    ordered = np.where(raw >> 31, ~raw, raw | np.uint32(1 << 31))
    return ordered.astype(np.uint64) << np.uint64(32)


def idf_weights(df: np.ndarray, texts: int) -> np.ndarray:
    share = np.clip(df / max(texts, 1), RARE_SHARE, 1.0)
    return 1.0 + np.log(1.0 / share) / np.log(1.0 / RARE_SHARE)


class Weights:
    """idf of the frequent shingles, sorted by hash; 2 for all others."""

    def __init__(self, rows: list[tuple[int, int]], texts: int):
        order = sorted((g & (2**64 - 1), n) for g, n in rows)
        self.table = np.array([g for g, _ in order], np.uint64)
        self.idf = idf_weights(np.array([n for _, n in order], float), texts)
        self.filter = bits(self.table)

    def of(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts * 2.0
        at, k = find(values, np.ones(len(values), bool), self.table, self.filter)
        w[at] = counts[at] * self.idf[k]
        return w


def candidate_shingles(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Shingles of which some may be frequent, all frequent ones among them, and the number of texts with a shingle.

    Texts are counted in batches; a batch hands on the shingles that at least half of RARE_SHARE of its texts hold. A shingle
    that RARE_SHARE of all texts hold loses less than half of that in the batches that keep silent, so its sum is at least
    the other half. Small parts of the input are read together, since a batch of few texts has little to leave out.
    """

    @task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []

        def count(own: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
            g, texts = np.sort(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in own)])), sum(n for _, n in own)
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(g)))
            keep = n >= RARE_SHARE / 2 * texts
            return pa.RecordBatch.from_arrays([pa.array(np.append(g[first][keep].astype(np.int64), 0)), pa.array(np.append(n[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), texts))], names=["g", "n", "texts"])

        for batch in batches:
            for x in slices(batch, "text"):
                h, at, _, _ = words(x.column("text"))
                g, _, off = distinct_counts(*shingles(h, at, SHINGLE_WORDS))
                held.append((g, int((np.diff(off) > 0).sum())))
                size = np.cumsum([len(g) for g, _ in held])
                if size[-1] >= 2 * COUNTED_AT_ONCE:  # a batch stays behind, so that the last one is no small rest
                    cut = int(np.searchsorted(size, COUNTED_AT_ONCE)) + 1
                    yield count(held[:cut])
                    held = held[cut:]
        yield count(held)

    all_ = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, all_.n // COUNTED_TEXTS, all_.b // COUNTED_BYTES)
    sums = save(docs.select("text").coalesce(parts).mapInArrow(run, "g long, n long, texts long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "shingle-df")
    texts = sums.agg(F.sum("texts").alias("t")).first().t or 0
    found = sums.where(F.col("n") >= max(1, RARE_SHARE / 2 * texts)).select("g").toArrow().column("g").to_numpy()
    drop_saved(sums)
    return np.sort(found.astype(np.int64).view(np.uint64)), texts


def frequent_shingles(docs: DataFrame) -> Weights:
    """Document frequencies of the frequent shingles over all texts: candidates first, then their exact counts.

    Neither the layout of the files nor the order of rows changes them. What reaches the driver is bounded as said above.
    """
    found, texts = candidate_shingles(docs)
    if not len(found):
        return Weights([], texts)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        filter_, total = bits(table), np.zeros(len(table), np.int64)
        for batch in batches:
            for x in slices(batch, "text"):
                h, at, _, _ = words(x.column("text"))
                g, off = shingles(h, at, SHINGLE_WORDS)
                at, k = find(g, np.ones(len(g), bool), table, filter_)
                doc = np.searchsorted(off, at, side="right") - 1
                total += np.bincount(np.unique(doc * np.int64(len(table)) + k) % len(table), minlength=len(table))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    rows = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, RARE_SHARE * texts)).collect()
    return Weights([(int(found[r.k]), r.n) for r in rows], texts)


def signatures(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, d1, d2, bands) of each text with a word: a digest of its shingles and band keys."""

    @task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_of, pool = weights.value, _draws()
        for batch in batches:
            for x in slices(batch, "text"):
                h, at, _, _ = words(x.column("text"))
                g, n, off = distinct_counts(*shingles(h, at, SHINGLE_WORDS))
                some = np.flatnonzero(np.diff(off) > 0)
                if not len(some):
                    continue
                start = off[some]
                w = w_of.of(g, n)
                odd = np.flatnonzero(w != 2.0)
                log_w = np.log(w[odd])
                low = g & np.uint64(0xFFFFFFFF)
                sig = np.empty((len(some), SAMPLES), np.uint64)
                for k in range(SAMPLES):
                    slot = (g * _ODD[k]) >> np.uint64(48)
                    v = pool["plain"][slot]
                    if len(odd):
                        v[odd] = _sample(slot[odd], log_w)
                    v |= low
                    sig[:, k] = np.minimum.reduceat(v, start)
                m = mix(sig.copy())
                band = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    band = band * np.uint64(0x9E3779B97F4A7C15) + m[:, r::ROWS]
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.int64)
                tagged = g + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                d1, d2 = (np.add.reduceat(mix(tagged ^ np.uint64(c)), start).astype(np.int64) for c in (0x1234567, 0x89ABCDEF01))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([x.column("doc_id").take(pa.array(some)), pa.array(d1), pa.array(d2), lists], names=["doc_id", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted hash arrays with their weights."""
    k = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][k] == b[0]
    common = float(np.minimum(a[1][k[hit]], b[1][hit]).sum())
    return common / (float(a[1].sum()) + float(b[1].sum()) - common)


def verify(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """(leader, member, distance): one less weighted Jaccard similarity. Members stream past their leader, so many to a task."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = (
        pairs.join(counts, "leader").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
        .join(texts.withColumnRenamed("doc_id", "member"), "member").select("leader", "part", F.lit(True).alias("is_member"), "member", "text")
    )
    leaders = (
        counts.join(texts.withColumnRenamed("doc_id", "leader"), "leader")
        .select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_member"), F.col("leader").alias("member"), "text")
    )

    @task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_of, now, own = weights.value, None, []
        for batch in batches:
            for x in slices(batch, "text"):
                h, at, _, _ = words(x.column("text"))
                g, n, off = distinct_counts(*shingles(h, at, SHINGLE_WORDS))
                w = w_of.of(g, n)
                out = []
                for i, (leader, part, is_member, member) in enumerate(zip(*(x.column(c).to_pylist() for c in ("leader", "part", "is_member", "member")))):
                    f = (g[off[i] : off[i + 1]], w[off[i] : off[i + 1]])
                    if now != (leader, part):
                        now, own = (leader, part), []
                    if not is_member:
                        own.append((f[0].copy(), f[1].copy()))
                    elif own:
                        out.append((leader, member, 1 - max(weighted_jaccard(o, f) for o in own)))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["leader", "member", "distance"])

    keys = ["leader", "part"]
    rows = leaders.union(members).repartition(*keys).sortWithinPartitions(*keys, "is_member")
    # a repeated doc_id has a row for each of its texts; the nearest counts
    return rows.mapInArrow(run, "leader long, member long, distance double").groupBy("leader", "member").agg(F.min("distance").alias("distance"))


class Block:
    """Weighted shingles of the texts of a block, for exact comparison of one with many."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, offsets: np.ndarray):
        _, self.at = np.unique(values, return_inverse=True)
        self.w, self.off = weights, offsets
        self.total = np.add.reduceat(np.append(weights, 0.0), offsets[:-1]) * (np.diff(offsets) > 0)
        self.dense = np.zeros(int(self.at.max(initial=-1)) + 1)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the rising places ``others`` that are similar to text i."""
        mine = slice(self.off[i], self.off[i + 1])
        small, large = np.minimum(self.total[others], self.total[i]), np.maximum(self.total[others], self.total[i])
        others = others[small >= (MIN_JACCARD - 1e-9) * large]
        if not len(others):
            return others
        self.dense[self.at[mine]] = self.w[mine]
        n = np.diff(self.off)[others]
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        flat = np.arange(int(n.sum())) + np.repeat(self.off[others] - start, n)
        common = np.add.reduceat(np.minimum(self.dense[self.at[flat]], self.w[flat]), start)
        self.dense[self.at[mine]] = 0.0
        return others[common >= (MIN_JACCARD - 1e-12) * (self.total[others] + self.total[i] - common)]


def rival_links(left: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Links (a, b) between a bucket's texts that its leader leaves open, enough of them to connect whom they connect.

    ``left``: (bucket, member, far, distance, component). Two texts are compared if one is far from the leader, their
    distances to it allow a link and they are not known to be connected. A bucket is dealt out in blocks, so a task holds
    two blocks at a time, and only links leave it, one for each two components that they join.
    """
    counts = left.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("n > 1").drop("n")
    i = F.pmod(F.xxhash64("member"), F.col("nb")).cast("int")
    dealt = (
        left.join(counts, "bucket").withColumn("_i", i)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("bucket", F.least("_i", "_j").alias("lo"), F.greatest("_i", "_j").alias("hi"), "_i", "member", "far", "distance", "component")
        .join(texts.withColumnRenamed("doc_id", "member"), "member")
    )
    keys = ["bucket", "lo", "hi"]

    def links(held: list[pa.RecordBatch], w_of: Weights) -> list[tuple[int, int]]:
        x = pa.Table.from_batches(held).combine_chunks()
        h, at, _, _ = words(x.column("text").chunk(0))
        g, n, off = distinct_counts(*shingles(h, at, SHINGLE_WORDS))
        block = Block(g, w_of.of(g, n), off)
        part, ids, far, d, comp = (x.column(c).to_numpy() for c in ("_i", "member", "far", "distance", "component"))
        comp, cross, out = comp.copy(), len(np.unique(part)) > 1, []
        for s in range(len(ids)):
            o = np.arange(s + 1, len(ids))
            o = o[(far[s] | far[o]) & (comp[s] != comp[o]) & (np.abs(d[s] - d[o]) <= 1 - MIN_JACCARD + 1e-9) & ((part[o] != part[s]) | (not cross))]
            for y in block.similar(s, o) if len(o) else o:
                if comp[y] != comp[s]:
                    out.append((int(ids[s]), int(ids[y])))
                    comp[comp == comp[y]] = comp[s]
        return out

    @task("minhash_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_of, now, held = weights.value, None, []
        make = lambda got: pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for x in batches:
            k = np.stack([x.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1)))) if len(k) else []
            for s, e in zip(edge, [*edge[1:], len(k)]):
                if now != tuple(k[s]):
                    if sum(y.num_rows for y in held) > 1:
                        yield make(links(held, w_of))
                    now, held = tuple(k[s]), []
                held.append(x.slice(s, e - s))
        if sum(y.num_rows for y in held) > 1:
            yield make(links(held, w_of))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for each row: class_id is the smallest doc_id that links of weighted Jaccard >= 0.8 reach.

    Texts with equal shingles are one class from the start and count once in what follows. In a band's bucket each class is
    compared with the leader, the smallest. Weighted Jaccard distance is a metric, so classes near the leader need no
    comparison with each other, and one near it needs none with one far from it unless their distances to it allow a link;
    what remains is compared in blocks.
    Texts without words (null and empty ones too) are never duplicates. A repeated doc_id is one document: its rows share a
    class. A null doc_id has a null class and is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    weights = spark.sparkContext.broadcast(frequent_shingles(rows))
    named = rows.where("doc_id is not null and text is not null")
    sigs = save(signatures(named, weights), "signatures")
    reps = save(sigs.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    # the rows of a repeated doc_id belong together
    same = sigs.select("doc_id", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).where("doc_id <> rep").select("doc_id", "rep").distinct()
    again = sigs.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("doc_id")
    repeats = same.join(again, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    buckets = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    heads = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    held = save(buckets.join(heads, "bucket").where("rep <> leader").select("bucket", "leader", F.col("rep").alias("member")), "buckets")
    pairs = held.select("leader", "member").distinct()
    wanted = held.select(F.explode(F.array("leader", "member")).alias("doc_id")).distinct()
    # wanted grows with the corpus: a merge join at every size
    texts = save(named.join(wanted.hint("merge"), "doc_id"), "candidate-texts")
    first = save(verify(pairs, texts, weights), "first-links")

    linked = F.col("distance") <= 1 - MIN_JACCARD + 1e-12
    known = held.join(first, ["leader", "member"])
    border = known.where(~linked).groupBy("bucket").agg(F.min("distance").alias("_d"))
    left = known.join(border, "bucket").where(~linked | (F.col("distance") >= F.col("_d") - (1 - MIN_JACCARD) - 1e-9)).select("bucket", "member", (~linked).alias("far"), "distance")
    links = first.where(linked).select(F.col("leader").alias("a"), F.col("member").alias("b")).union(repeats)
    comp = save(components(links, "near"), "near-first")
    rivals = left.join(comp, F.col("member") == F.col("node"), "left").select("bucket", "member", "far", "distance", F.coalesce("component", "member").alias("component"))
    second = save(rival_links(rivals, texts, weights), "second-links")
    if second.limit(1).count():
        comp = components(links.union(second), "near")
    classes = reps.select("d1", "d2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("class_id"))
    of_doc = sigs.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").join(of_doc, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
