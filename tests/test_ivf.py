"""Nearest vectors by cells: recall against all pairs, and what cells must not change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import ivf as I
from loomtext.operators import search as S
from loomtext.plans import registry

VECTORS = "id long, vector array<float>"


def clustered(n=3000, dim=16, seed=0):
    """Vectors around 40 middles, a third of all being one and the same."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(40, dim)) * 4
    v = middles[rng.integers(0, 40, n)] + rng.normal(size=(n, dim))
    v[: n // 3] = middles[0]
    return v


def exact(v, ids, q, k, metric):
    """{query row: ids of the k nearest, with all as near as the last one}."""
    if metric == "cosine":
        score = (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :]
    else:
        score = -np.linalg.norm(q[:, None, :] - v[None, :, :], axis=2)
    return [set(ids[s >= np.sort(s)[-k] - 1e-6].tolist()) for s in score]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_few_probes_find_the_neighbours(spark, metric, monkeypatch):
    monkeypatch.setattr(I, "LIST_ROWS", 100)  # the cell of a third of all vectors is cut
    v = clustered()
    ids = np.arange(len(v)) * 2
    table = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], VECTORS)
    index = I.build(table, metric, cells=40)
    assert index.lists.count() == len(v)  # every vector is in a list
    assert index.parts.agg(F.max("parts")).first()[0] >= 10
    q = v[::60]
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "query_id long, vector array<float>")
    found = I.search(queries, index, 10, 4).collect()
    want = exact(v, ids, q, 10, metric)
    hits = sum(r["id"] in want[r["query_id"]] for r in found)
    assert len(found) == 10 * len(q) and hits >= 0.9 * len(found)
    assert sorted(r["rank"] for r in found if r["query_id"] == 3) == list(range(1, 11))
    measured = I.recall(I.search(queries, index, 10, 4), S.knn(queries, table, 10, metric))
    assert measured >= 0.9


def test_all_probes_and_candidates_give_the_exact_result(spark):
    v = clustered(400, 8, 5)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], VECTORS)
    queries = table.filter("id % 20 = 7").select(F.col("id").alias("query_id"), "vector")
    index = I.build(table, cells=12)
    got = I.search(queries, index, 5, 12, refine=400)
    columns = ["query_id", "id", F.round("score", 6).alias("score"), "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, S.knn(queries, table, 5).select(columns).collect()))


def test_probes_are_measured(spark):
    v = clustered(900, 8, 2)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], VECTORS)
    index = I.build(table, cells=20)
    probes = I.probes_for(index, 5, 0.95, queries=60)
    assert 1 <= probes <= 20
    queries = table.filter("id % 9 = 4").select(F.col("id").alias("query_id"), "vector")
    assert I.recall(I.search(queries, index, 5, probes), S.knn(queries, table, 5)) >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 0.1, 0.0]), (5, [0.9, 0.1]), (5, [0.9, 0.1]), (6, [])]
    index = I.build(spark.createDataFrame(rows, VECTORS))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "query_id long, vector array<float>")
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 3)) for r in I.search(asked, index, 3, 9).collect())
    assert [x[:3] for x in got if x[0] == 1] == [(1, 1, 1), (1, 2, 5), (1, 3, 5)]
    assert {x[0] for x in got} == {1, 4} and all(x[3] == 0.0 for x in got if x[0] == 4)
    empty = I.build(spark.createDataFrame([], VECTORS))
    assert I.search(asked, empty, 3, 2).count() == 0
    assert I.search(asked.limit(0), index, 3, 2).count() == 0
    with pytest.raises(ValueError):
        I.build(spark.createDataFrame(rows, VECTORS), "dot")


def test_recall_on_the_test_tables(spark):
    data = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    found = registry.QUERIES["knn_ivf"](spark, data)
    assert I.recall(found.withColumn("score", F.col("score") + 1e-6), S.knn(queries, e, 10)) >= 0.9
