"""Nearest vectors by an inverted file of centroids, for many queries over many vectors.

``build`` clusters a sample of at most ``SAMPLE_ROWS`` vectors by k-means into
cells, then puts every vector into the list of its nearest centroid, with its
difference from the centroid as one byte a dimension.  ``search`` joins each query
with the lists of its nearest cells (``probes`` of them), compares by the bytes,
and ranks the ``REFINE * k`` best of each query by the vectors themselves.  Lists
are cut into parts of about ``LIST_ROWS`` vectors, so a cell with a third of all
vectors is many tasks' work.  Queries are joined, never sent through the driver.

The result is approximate: a neighbour in a cell that isn't probed is missed.
``probes_for`` gives the number of probes at which a stated share of the true
neighbours of a sample of vectors is found; ``recall`` measures any result.
``search.knn`` is the exact way.

Edge cases: null vectors, null ids and vectors of another length than most are in
no list and find nothing; equal scores are ranked by id; a vector of zeros has
cosine 0 with all; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import vectors as V
from loomtext.plans.shared import Scratch

from . import search as S

#: Vectors that the centroids are fitted on; cells, whose centroids are broadcast; vectors of a task's list.
SAMPLE_ROWS, MAX_CELLS, LIST_ROWS = 65_536, 16_384, 20_000
#: Candidates of a query, times k, that are ranked by their vectors; so many in all are broadcast.
REFINE, BROADCAST_ROWS = 4, 200_000
#: Queries that probes_for asks exactly, at most.
TUNING_QUERIES = 256
#: Cells (8 bytes) of a matrix of distances.
CELLS = 2_000_000
LISTS = "cell int, id long, code binary, scale float, vector array<float>"


@dataclass(frozen=True)
class Index:
    lists: DataFrame
    parts: DataFrame  # (cell, parts)
    centers: Broadcast
    metric: str


def _matrix(column: pa.Array, dim: int, metric: str) -> np.ndarray:
    v = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    if metric == "cosine":
        norms = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
    return v


def _fitting(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """Rows (id, vector) with an id and a vector of the index's length."""
    return batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)))


def _order(v: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    far = (centers * centers).sum(1)[None, :] - 2 * v @ centers.T
    near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(v), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def _assign(batches: Iterator[pa.RecordBatch], centers: Broadcast, metric: str) -> Iterator[pa.RecordBatch]:
    c = centers.value
    for batch in batches:
        batch = _fitting(batch, c.shape[1])
        v = _matrix(batch.column(1), c.shape[1], metric)
        cell = np.concatenate([_order(v[lo : lo + 1024], c, 1)[:, 0] for lo in range(0, len(v), 1024)]) if len(v) else np.zeros(0, np.int64)
        rest = v - c[cell]
        scale = np.abs(rest).max(axis=1, initial=0) / 127
        codes = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
        columns = [pa.array(cell.astype(np.int32)), batch.column(0), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(scale.astype(np.float32)), batch.column(1).cast(pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "id", "code", "scale", "vector"])


def _probe(batches: Iterator[pa.RecordBatch], centers: Broadcast, metric: str, probes: int) -> Iterator[pa.RecordBatch]:
    c = centers.value
    for batch in batches:
        batch = _fitting(batch, c.shape[1])
        near = _order(_matrix(batch.column(1), c.shape[1], metric), c, min(probes, len(c)))
        row = np.repeat(np.arange(len(near)), near.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(near.ravel().astype(np.int32)), batch.column(1).take(pa.array(row))], ["query_id", "cell", "vector"])


def _nearest_of(centers: Broadcast, metric: str, keep: int) -> Callable:
    def near(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        return _compare(centers.value[int(key[0].as_py())], held, asked, metric, keep)

    return near


def _compare(c: np.ndarray, held: pa.Table, asked: pa.Table, metric: str, keep: int) -> pa.Table:
    """The keep vectors of a part of a list (with centroid c) that are nearest to each query, by their codes."""
    out: tuple = ([], [], [])
    if held.num_rows and asked.num_rows:
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.int8).reshape(held.num_rows, -1)
        v = c + codes * held.column("scale").to_numpy()[:, None].astype(np.float64)
        square, ids, query = (v * v).sum(1), held.column("id").to_numpy(), asked.column("query_id").to_numpy()
        q = _matrix(asked.column("vector").combine_chunks(), len(c), metric)
        n, step = min(keep, len(ids)), max(1, CELLS // len(ids))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            far = square[None, :] - 2 * part @ v.T + (part * part).sum(1)[:, None]
            near = np.argpartition(far, n - 1, axis=1)[:, :n]
            out[0].append(np.repeat(query[lo : lo + step], n))
            out[1].append(ids[near].ravel())
            out[2].append(np.take_along_axis(far, near, 1).ravel())
    return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "far"])


def build(vectors: DataFrame, metric: str = "cosine", cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Index:
    """The stored index of (id, vector); by default about twice the square root of their number of cells."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"no cells for {metric}")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ivf")
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    n, dim = (most["n"], most["dim"]) if most else (0, 0)
    cells = min(MAX_CELLS, cells or max(1, round(2 * math.sqrt(n))))
    fitting = rows.filter(F.size("vector") == dim)
    if n > sample_rows:
        fitting = fitting.sample(fraction=sample_rows / n, seed=7)
    unit = V.normalize(F.col("vector")) if metric == "cosine" else F.col("vector")
    centers = np.zeros((1, max(dim, 1)))
    if n:
        features = scratch.keep(fitting.select(unit.alias("vector"))).select(array_to_vector("vector").alias("features"))
        centers = np.array(KMeans(k=max(2, cells), maxIter=10, seed=7).fit(features).clusterCenters())  # at most MAX_CELLS of them
    shared = spark.sparkContext.broadcast(centers)
    lists = scratch.keep(rows.mapInArrow(partial(_assign, centers=shared, metric=metric), LISTS))
    parts = scratch.keep(lists.groupBy("cell").agg(F.ceil(F.count("*") / LIST_ROWS).alias("parts")))
    return Index(lists, parts, shared, metric)


def search(queries: DataFrame, index: Index, k: int, probes: int, refine: int = REFINE) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of the probed lists for each query (query_id, vector)."""
    scratch = Scratch(queries.sparkSession, "ivf-search")
    asked = scratch.keep(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")))
    cells = asked.mapInArrow(partial(_probe, centers=index.centers, metric=index.metric, probes=probes), "query_id long, cell int, vector array<double>")
    right = cells.join(F.broadcast(index.parts), "cell")  # at most MAX_CELLS rows
    right = right.select("query_id", "cell", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = index.lists.join(F.broadcast(index.parts), "cell").select("cell", "id", "code", "scale", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))

    rough = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(_nearest_of(index.centers, index.metric, k * refine), "query_id long, id long, far double")
    order = Window.partitionBy("query_id").orderBy("far", "id")
    rough = rough.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k * refine).select("query_id", "id").distinct()
    rough = scratch.keep(rough)
    few = F.broadcast(rough) if rough.count() <= BROADCAST_ROWS else rough
    pairs = index.lists.select("id", F.col("vector").cast("array<double>").alias("v")).join(few, "id").join(asked, "query_id")
    return S.top_k(pairs.select("query_id", "id", V.similarity(F.col("vector"), F.col("v"), index.metric).alias("score")), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, id, score, rank) that is found; a neighbour as near as the exact last one counts."""
    last = exact.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    got = last.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("least") - 1e-9).alias("hits"))
    row = got.agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def probes_for(index: Index, k: int, share: float = 0.95, queries: int = TUNING_QUERIES) -> int:
    """The fewest probes (in steps of a half more) at which the share of the exact neighbours of at most so many vectors is found."""
    cells = len(index.centers.value)
    held = index.lists.select("id", "vector")
    n = held.count()
    asked = held.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // queries))) == 0).select(F.col("id").alias("query_id"), "vector").limit(queries)
    asked = Scratch(held.sparkSession, "ivf-tuning").keep(asked)
    exact = Scratch(held.sparkSession, "ivf-tuning").keep(S.knn(asked, held, k, index.metric))
    probes = 1
    while probes < cells and recall(search(asked, index, k, probes), exact) < share:
        probes = min(cells, max(probes + 1, math.ceil(probes * 1.5)))
    return probes
