"""Searches through a graph that a task holds, against plain versions and the joins for larger graphs."""

import itertools
import os
import random
import tempfile

import duckdb
import pytest

from loomtext.operators import adjacency
from loomtext.operators import graph as G
from loomtext.plans import registry

from test_readers import plain_betweenness


def graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("direction", ["both", "out", "in"])
def test_betweenness_held_and_joined(spark, monkeypatch, direction):
    monkeypatch.setattr(adjacency, "GATHERED", 7)
    edges = spark.createDataFrame([*graph(1, 40, 60), *[(100 + a, 100 + b) for a, b in graph(2, 12, 60)], (7, 7), (3, None)], "src long, dst long")
    starts = spark.createDataFrame([(k,) for k in [*range(0, 40, 3), *range(100, 112), 999, 999, None]], "id long")
    held = {r["id"]: round(r["score"], 9) for r in G.betweenness(starts, edges, direction).collect()}
    monkeypatch.setattr(adjacency, "MOST_EDGES", 0)
    joined = {r["id"]: round(r["score"], 9) for r in G.betweenness(starts, edges, direction).collect()}
    assert held == joined and sum(x > 0 for x in held.values()) > 10 and held[999] == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_paths_held_and_joined(spark, monkeypatch, kind):
    monkeypatch.setattr(adjacency, "GATHERED", 7)
    monkeypatch.setattr(adjacency, "ROWS", 5)
    name = int if kind == "long" else str
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in graph(3, 9, 45)], f"src {kind}, dst {kind}")
    starts = spark.createDataFrame([(name(k),) for k in (0, 1, 5, 77)], f"id {kind}")
    held = sorted(tuple(r["path"]) for r in G.all_paths(starts, edges, 4).collect())
    monkeypatch.setattr(adjacency, "MOST_EDGES", 0)
    assert held == sorted(tuple(r["path"]) for r in G.all_paths(starts, edges, 4).collect()) and len(held) == len(set(held)) > 100


def test_no_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert G.all_paths(spark.range(3), edges, 3).count() == 0
    assert [r["score"] for r in G.betweenness(spark.range(3), edges).collect()] == [0.0, 0.0, 0.0]


def test_queries_start_from_all_vectors(spark):
    """Only the ids that 50 divides were starts."""
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], 0) for k in range(1, 25)]
    folder = tempfile.mkdtemp(prefix="vectors-")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(os.path.join(folder, "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = sorted(r["path"] for r in registry.QUERIES["graph_all_paths"](spark, folder).collect())
    assert got == sorted(x for (x,) in con.execute(registry.SQL["graph_all_paths"]).fetchall()) and len(got) > 1000

    def cosine(x, y):
        return sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5

    edges = [(a, b) for (a, x, _), (b, y, _) in itertools.combinations(rows, 2) if cosine(x, y) > 0.33]
    scores = {r["id"]: r["score"] for r in registry.QUERIES["graph_betweenness"](spark, folder).collect()}
    want = plain_betweenness([k for k, _, _ in rows], edges)
    assert scores.keys() == want.keys() and all(abs(scores[k] - x) < 1e-5 for k, x in want.items()) and max(scores.values()) > 10
