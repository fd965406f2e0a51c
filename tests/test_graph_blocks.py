"""Graph operators that work in blocks against plain versions: many blocks, chunks of starts, colours."""

import itertools
import random
from collections import Counter, deque

import pytest

from loomtext.operators import graph as G
from loomtext.operators import pairs as P
from loomtext.operators import reach


def graph(seed, n, m, name=int):
    rng = random.Random(seed)
    return [(name(a), name(b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m))]


def hops(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in out:
                out[y] = out[x] + 1
                todo.append(y)
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_traverse_in_blocks_and_chunks_of_starts(spark, monkeypatch, kind):
    monkeypatch.setattr(reach, "FEW", 20)
    monkeypatch.setattr(reach, "STARTS", 70)
    monkeypatch.setattr(reach, "GATHERED", 40)
    name = int if kind == "long" else str
    edges = graph(1, 200, 300, name)
    starts = [name(k) for k in range(0, 180)]
    got = G.traverse(spark.createDataFrame([(s,) for s in starts], f"id {kind}"), spark.createDataFrame(edges, f"src {kind}, dst {kind}"), 4).collect()
    want = [(s, y, h) for s in starts for y, h in hops(edges, s).items() if 0 < h <= 4]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000


def test_path_lengths_equal_shortest_paths(spark, monkeypatch):
    monkeypatch.setattr(reach, "FEW", 20)
    monkeypatch.setattr(reach, "STARTS", 64)
    edges = spark.createDataFrame(graph(2, 150, 170), "src long, dst long")
    rng = random.Random(3)
    pairs = spark.createDataFrame([(rng.randrange(160), rng.randrange(160)) for _ in range(600)], "start long, goal long")
    got = sorted(map(tuple, G.path_lengths(pairs, edges).collect()))
    assert got == sorted((r["start"], r["goal"], r["length"]) for r in G.shortest_paths(pairs, edges).collect()) and len({x[2] for x in got}) > 4


@pytest.mark.parametrize("bits", [True, False])
def test_triangles_by_colours(spark, monkeypatch, bits):
    monkeypatch.setattr(G, "TRIPLE_EDGES", 500)
    monkeypatch.setattr(G, "WEDGES", 37)
    if not bits:
        monkeypatch.setattr(G, "BIT_BYTES", 0)
    edges = graph(4, 40, 400)
    simple = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    want = Counter()
    for three in itertools.combinations(range(40), 3):
        if all(p in simple for p in itertools.combinations(three, 2)):
            want.update(three)
    got = {r["id"]: r["triangles"] for r in G.triangles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == dict(want) and len(got) > 20


def test_all_paths_writes_no_longest_paths(spark, monkeypatch):
    kept = []
    keep = G.Scratch.keep
    monkeypatch.setattr(G.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    edges = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "src long, dst long")
    got = G.all_paths(spark.range(1), edges, 3).collect()
    assert len(got) == 4 + 16 + 60 and max(k.count() for k in kept) == 20  # the edges


@pytest.mark.parametrize("tile, largest", [(3, 5), (4, 1000)])
def test_cosine_blocks_of_many_tiles(spark, monkeypatch, tile, largest):
    monkeypatch.setattr(P, "BLOCK", tile)
    monkeypatch.setattr(P, "LARGEST", largest)
    monkeypatch.setattr(P, "TASKS", 3)
    rng = random.Random(5)
    v = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(40)]
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = sorted((a, b) for (a, x), (b, y) in itertools.combinations(v, 2) if cosine(x, y) > 0.5)
    pairs = P.cosine_pairs(spark.createDataFrame(v, "id long, vector array<double>"), 0.5)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == want
    both = P.similarity_graph(pairs)
    assert sorted((r["src"], r["dst"]) for r in both.collect()) == sorted(want + [(b, a) for a, b in want])
    assert both._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_few_blocks_for_many_vectors():
    """A vector goes to every block, so their number may grow with LARGEST only."""
    assert P._blocks(100_000, P.BLOCK) <= 11 and P._blocks(615_000, P.BLOCK) <= 38 and P._blocks(900, P.BLOCK) == 1
