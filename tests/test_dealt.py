"""Rounds over edges that are dealt once: plain results, and no edge shuffled or joined again in a round."""

import itertools
import random
from collections import Counter

import pytest

from loomtext.operators import graph as G
from loomtext.operators import reach


def graph(seed, n, m, name):
    rng = random.Random(seed)
    return [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(m)]


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


@pytest.mark.parametrize("kind", ["long", "string"])
def test_communities_in_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(reach, "FEW", 30)
    edges = graph(1, 60, 150, int if kind == "long" else str)
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [(edges[0][0], edges[0][0])]
    near = neighbours(edges)
    want = {x: x for x in near}
    for _ in range(3):
        votes = {x: Counter(want[y] for y in near[x]) for x in near}
        want = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
    got = G.communities(spark.createDataFrame([*edges, (edges[0][0], None)], f"src {kind}, dst {kind}"), 3).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want and len(set(want.values())) > 3


def test_clustering_in_colours(spark, monkeypatch):
    monkeypatch.setattr(G, "TRIPLE_EDGES", 300)
    edges = graph(2, 40, 300, int)
    edges += edges[:30] + [(b, a) for a, b in edges[30:60]] + [(99, 100), (100, 100)]
    near = {x: y - {x} for x, y in neighbours(edges).items()}
    want = {}
    for x, ys in near.items():
        closed = sum(b in near[a] for a, b in itertools.combinations(sorted(ys), 2))
        want[x] = 2 * closed / (len(ys) * (len(ys) - 1)) if len(ys) > 1 else 0.0
    got = {r["id"]: r["coefficient"] for r in G.clustering(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - y) < 1e-9 for x, y in want.items())


@pytest.mark.parametrize("what", ["traverse", "communities", "triangles", "clustering"])
def test_edges_are_written_once_and_rounds_read_them(spark, monkeypatch, what):
    """Each level joined all edges again, each round of votes too, and an edge went to a task for each colour."""
    kept = []
    keep = G.Scratch.keep
    monkeypatch.setattr(G.Scratch, "keep", lambda self, df, by=None: kept.append((df, out := keep(self, df, by))) or out)
    monkeypatch.setattr(reach, "FEW", 30)
    monkeypatch.setattr(G, "TRIPLE_EDGES", 300)
    edges = spark.createDataFrame(sorted(set(graph(3, 60, 300, int))), "src long, dst long")
    run = {"traverse": lambda: G.traverse(spark.range(5), edges, 3, "both"), "communities": lambda: G.communities(edges, 3), "triangles": lambda: G.triangles(edges), "clustering": lambda: G.clustering(edges)}
    out = run[what]()
    assert out.count() > 20
    written = [t for _, t in kept if {"src", "dst"} <= set(t.columns)]
    assert len(written) == 1 and written[0].count() in (edges.count(), edges.filter("src <> dst").count())
    plans = [df._jdf.queryExecution().optimizedPlan() for df, _ in kept if df.columns[-1] == "part"] or [out._jdf.queryExecution().optimizedPlan()]
    rounds = [p for p in plans if "MapInArrow" in p.toString()]
    assert len(rounds) >= 1 and all(leaf.toString().startswith("Range") for p in rounds for leaf in (p.collectLeaves().apply(k) for k in range(p.collectLeaves().size())))


def test_lengths_beyond_a_word_of_starts_and_over_merged_levels(spark, monkeypatch):
    monkeypatch.setattr(reach, "MOST_LEVELS", 2)
    monkeypatch.setattr(reach, "STARTS", 128)
    edges = spark.createDataFrame([(1000 * a + k, 1000 * a + k + 1) for a in range(90) for k in range(6)], "src long, dst long")
    pairs = spark.createDataFrame([(1000 * a, 1000 * a + d) for a in range(90) for d in (0, 1, 3, 3, 6, 500)], "start long, goal long")
    got = sorted(map(tuple, G.path_lengths(pairs, edges).collect()))
    assert got == sorted((1000 * a, 1000 * a + d, d) for a in range(90) for d in (0, 1, 3, 6))
