"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, exact at the threshold.

A vector lives in the cell of its nearest centroid. As a query it also visits every other cell that can hold a partner:
if a is its own centroid and b the other, all of b's vectors lie on b's side of the plane that halves a and b, and a
vector whose distance to that plane exceeds the sine of the threshold's angle has no partner there. So no pair is lost,
whatever the centroids are. They are fit on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, save

MIN_COSINE = 0.98
#: Vectors of a cell at which a label gets another one, and the most cells of all labels (their centroids are broadcast).
CELL = 4_000
MOST_CELLS = 4_096
#: Centroids are fit on so many vectors for each cell, in so many rounds.
SAMPLE_PER_CELL = 64
ROUNDS = 8
#: Vectors of a block of a cell, on either side of a product.
BLOCK = 4_096


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors in double precision, and which rows are valid. Shorter vectors go on with zeros.

    Straight from the Arrow buffers; a null list has no components.
    """
    n = len(column)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    flat = flat.fill_null(float("nan")) if flat.null_count else flat
    flat = flat.to_numpy(zero_copy_only=False)
    x = np.zeros((n, int(size.max(initial=0))))
    x[np.arange(x.shape[1])[None, :] < size[:, None]] = flat
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        ok = np.isfinite(norm) & (norm > 0)
        x = np.where(ok[:, None], x / norm[:, None], 0.0)
    return x, ok


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids; the start is spread by taking the farthest of a few rows each time."""
    c = x[:1]
    for i in range(1, min(k, len(x))):
        trial = x[(np.arange(8) * 7919 + i * 104729) % len(x)]
        c = np.vstack([c, trial[np.argmin((trial @ c.T).max(axis=1))][None]])
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 1e-12, total / np.maximum(n, 1e-12), c)
    return c


def fit_cells(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of the labels that need more than one cell; a label that is not in the result is one cell."""
    spark = vectors.sparkSession
    n = F.count("*")
    total = vectors.count()
    cell = max(CELL, -(-2 * total // MOST_CELLS))
    big = {r.label: r.n for r in vectors.groupBy("label").agg(n.alias("n")).where(F.col("n") > cell).collect()}  # at most total / cell
    if not big:
        return {}
    plan = spark.createDataFrame([(k, min(1.0, SAMPLE_PER_CELL * (-(-v // cell)) / v)) for k, v in big.items()], "label int, share double")
    part = (F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / 2.0**53) < F.col("share")
    rows = vectors.join(F.broadcast(plan), "label").where(part).select("label", "id", "v").toArrow()  # about SAMPLE_PER_CELL * MOST_CELLS vectors at most
    labels, ids = rows.column("label").to_numpy(), rows.column("id").to_numpy()
    out = {}
    for label in big:
        own = np.flatnonzero(labels == label)
        x, ok = unit_rows(rows.column("v").take(pa.array(own[np.argsort(ids[own], kind="stable")])).combine_chunks())
        if ok.any():
            out[label] = spherical_kmeans(x[ok], -(-big[label] // cell))
    return out


def place(vectors: DataFrame, centroids: dict[int, np.ndarray], min_cosine: float) -> DataFrame:
    """(label, cell, query, id, mult, v): each vector in its own cell, and as a query in each cell that can hold a partner."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(max(0.0, 1 - min_cosine**2))) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            unit, ok = unit_rows(x.column("v"))
            label = np.array(x.column("label").to_pylist())
            take, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            queries = [np.zeros(0, bool)]
            for one in np.unique(label):
                rows = np.flatnonzero((label == one) & ok)
                c = shared.value.get(int(one))
                home = np.zeros(len(rows), np.int64)
                if c is not None and len(rows):
                    u = np.zeros((len(rows), max(c.shape[1], unit.shape[1])))
                    u[:, : unit.shape[1]] = unit[rows]
                    c = np.pad(c, ((0, 0), (0, u.shape[1] - c.shape[1])))
                    cos = u @ c.T
                    home = np.argmax(cos, axis=1)
                    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
                    margin = cos[np.arange(len(rows)), home][:, None] - cos
                    # equal centroids part nothing: any distance is possible
                    visit = margin <= reach * gap[home] + 1e-12
                    visit[np.arange(len(rows)), home] = False
                    r, k = np.nonzero(visit)
                    take.append(rows[r])
                    cells.append(k)
                    queries.append(np.ones(len(r), bool))
                for q in (True, False):
                    take.append(rows)
                    cells.append(home)
                    queries.append(np.full(len(rows), q))
            got = x.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([got.column("label"), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(queries)), got.column("id"), got.column("mult"), got.column("v")], names=["label", "cell", "query", "id", "mult", "v"])

    return vectors.mapInArrow(run, "label int, cell int, query boolean, id long, mult long, v array<double>")


def compare(placed: DataFrame, min_cosine: float) -> DataFrame:
    """(id, other, n): links of queries with the residents of a cell, summed by block (other is null), and links enough to connect whom they connect (n is 0).

    A cell is dealt out in blocks of residents and of queries, so no task holds more than a block of residents and the
    queries stream past it.
    """
    counts = placed.groupBy("label", "cell").agg(F.sum(F.col("query").cast("long")).alias("q"), F.sum((~F.col("query")).cast("long")).alias("r"))
    blocks = F.broadcast(counts.select("label", "cell", F.ceil(F.col("r") / BLOCK).cast("int").alias("nr"), F.greatest(F.lit(1), F.ceil(F.col("q") / BLOCK)).cast("int").alias("nq")))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), n).cast("int")
    zero = F.lit(0)
    dealt = (
        placed.join(blocks, ["label", "cell"]).where("nr > 0")
        .withColumn("_i", F.when(F.col("query"), own(F.col("nq"))).otherwise(own(F.col("nr"))))
        .withColumn("_j", F.explode(F.sequence(zero, F.when(F.col("query"), F.col("nr")).otherwise(F.col("nq")) - 1)))
        .select("label", "cell", F.when(F.col("query"), F.col("_j")).otherwise(F.col("_i")).alias("rb"), F.when(F.col("query"), F.col("_i")).otherwise(F.col("_j")).alias("qb"), "query", "id", "mult", "v")
    )
    keys = ["label", "cell", "rb", "qb"]

    def links(rid: np.ndarray, rm: np.ndarray, r: np.ndarray, state: dict, qid: np.ndarray, q: np.ndarray) -> list[tuple]:
        out = []
        if not len(rid):
            return out
        for s in range(0, len(qid), 1024):
            hit = q[s : s + 1024] @ r.T >= min_cosine
            ids = qid[s : s + 1024]
            hit &= ids[:, None] != rid[None, :]
            n = hit @ rm
            linked = np.flatnonzero(n)
            if not len(linked):
                continue
            hit = hit[linked]
            out += [(int(i), None, int(c)) for i, c in zip(ids[linked], n[linked])]
            label = state["label"]
            least = np.where(hit, label[None, :], len(rid)).min(axis=1)
            out += [(int(i), int(rid[k]), 0) for i, k in zip(ids[linked], least)]
            for row in np.flatnonzero(np.where(hit, label[None, :], -1).max(axis=1) > least):
                roots = np.unique(state["label"][hit[row]])
                if len(roots) > 1:
                    out += [(int(rid[roots[0]]), int(rid[k]), 0) for k in roots[1:]]
                    state["label"][np.isin(state["label"], roots)] = roots[0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rid, rm, r, width = None, [], [], [], 0
        ready = None
        for x in batches:
            k = np.stack([x.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1)))) if len(k) else []
            query = x.column("query").to_numpy(zero_copy_only=False)
            ids = x.column("id").to_numpy()
            unit, _ = unit_rows(x.column("v"))
            mult = x.column("mult").to_numpy()
            out = []
            for s, e in zip(edge, [*edge[1:], len(k)]):
                if now != tuple(k[s]):
                    now, rid, rm, r, ready = tuple(k[s]), [], [], [], None
                some = np.arange(s, e)
                res = some[~query[s:e]]
                if len(res):
                    rid.append(ids[res])
                    rm.append(mult[res])
                    r.append(unit[res])
                ask = some[query[s:e]]
                if len(ask) and rid:
                    width = max([unit.shape[1], *(y.shape[1] for y in r)])
                    if ready is None or ready[2].shape[1] < width:
                        label = ready[3] if ready else {"label": np.arange(sum(map(len, rid)))}
                        ready = (np.concatenate(rid), np.concatenate(rm), np.vstack([np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in r]), label)
                    out += links(*ready, ids[ask], np.pad(unit[ask], ((0, 0), (0, width - unit.shape[1]))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["id", "other", "n"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "query").mapInArrow(run, "id long, other long, n long")


def embedding_groups(embeddings: DataFrame, min_cosine: float = MIN_COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: (vec_id, n_links, component_id, kept).

    Vectors are compared when their labels are equal and not null. A null or zero vector, or one with a null or non-finite
    component, and a vector with a null label or id links with nothing and is kept. Equal vectors of a label are compared
    once and counted by how often they occur; a repeated vec_id counts as another vector. Vectors of different lengths are
    compared as if the shorter one went on with zeros. kept: the one vector of a group with the smallest id. Other columns
    are not read.
    """
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("int").alias("label"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("_ok", F.coalesce(~bad & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"_k1": F.xxhash64("label", "v"), "_k2": F.xxhash64(F.lit(1), "v", "label")})
    good = rows.where("_ok")
    classes = save(good.groupBy("label", "_k1", "_k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("v").alias("v")), "vector-classes")
    vectors = classes.select("label", "id", "mult", "v")
    found = save(compare(save(place(vectors, fit_cells(vectors), min_cosine), "vector-cells"), min_cosine), "vector-links")
    n = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "vector")
    per_class = (
        classes.select("_k1", "_k2", "id", "mult").join(n, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
        .select("_k1", "_k2", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.drop("v", "label").join(per_class.withColumn("_ok", F.lit(True)), ["_k1", "_k2", "_ok"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0
       AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= {MIN_COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM e LEFT JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
