"""Operators against small brute-force versions."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import chunk as K
from loomtext.operators import graph as G
from loomtext.operators import pairs as P
from loomtext.operators import search as S
from loomtext.operators import store
from loomtext.operators.packing import Rule, openings
from loomtext.plans.components import connected_components
from loomtext.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_k_order(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1])], "id long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    got = S.knn(q, v, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 2] and got[0]["score"] > got[1]["score"]
    near = S.vector_scores(q, v, 100, min_score=0.8)
    assert sorted(r["id"] for r in near.collect()) == [0, 2]
    assert S.knn(q.limit(0), v, 2).count() == 0 and S.knn(q, v.limit(0), 2).count() == 0


def test_keyword_search_ties_by_id(spark):
    m = spark.createDataFrame([(3, "red fox"), (1, "Red, fox!"), (2, "blue")], "id long, text string")
    q = spark.createDataFrame([(0, "the red red fox")], "query_id long, text string")
    got = S.keyword_search(q, m, 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 3), (3, 3)]


def test_token_jaccard_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 8)))) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, text string")
    sets = {i: set(t.split()) for i, t in docs}
    for threshold in (0.3, 0.6):
        expected = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}
        assert {(r["a"], r["b"]) for r in P.token_jaccard_pairs(df, threshold).collect()} == expected


def test_cosine_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(data, "id long, vector array<double>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    expected = sorted((a, b) for (a, x), (b, y) in itertools.combinations(data, 2) if cos(x, y) > 0.5)
    assert sorted((r["a"], r["b"]) for r in P.cosine_pairs(df, 0.5).collect()) == expected
    found = {(r["a"], r["b"]) for r in P.cosine_pairs(df, 0.8, "lsh", tables=24, bits=4).collect()}
    wanted = {(a, b) for (a, x), (b, y) in itertools.combinations(data, 2) if cos(x, y) > 0.8}
    assert found <= wanted and len(found) >= 0.9 * len(wanted)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_lsh_join_finds_nine_of_ten(spark, sf):
    from loomtext.plans import registry

    data = f"/root/testdata/{sf}"
    if not os.path.isdir(data):
        pytest.skip("needs the test tables")
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    wanted = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in zip(*np.nonzero(np.triu(v @ v.T > 0.35, 1)))}
    got = [(r["a"], r["b"]) for r in registry.QUERIES["pairs_cosine_lsh"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) <= wanted and len(got) >= 0.9 * len(wanted)


def test_lsh_shape_follows_the_threshold():
    for threshold in (0.1, 0.35, 0.8, 0.99, 1.0):
        bits = P.lsh_bits(threshold, 10_000)
        assert 1 - (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** P.lsh_tables(threshold, bits) >= 0.9


def test_duplicate_groups_follow_the_sequential_rule(spark):
    rng = random.Random(3)
    n = 120
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(200)})
    near = set(edges)
    leader, leaders = {}, []
    for i in range(n):
        mine = next((x for x in leaders if (x, i) in near), None)
        leader[i] = i if mine is None else mine
        if mine is None:
            leaders.append(i)
    got = P.duplicate_groups(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["leader"] for r in got.collect()} == leader
    assert rows(P.duplicate_groups(spark.range(2), spark.createDataFrame([], "a long, b long"))) == [(0, 0), (1, 1)]


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _greedy(sizes, budget):
    starts, run = [], None
    for i, n in enumerate(sizes):
        if run is None or run + n > budget:
            starts.append(i + 1)
            run = n
        else:
            run += n
    return starts


def test_packing_equals_a_loop():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(0, 30))]
        opens, backs = openings(np.array(sizes, np.int64), Rule(12))
        assert [k + 1 for k in opens.tolist()] == _greedy(sizes, 12) and not backs.any()


def test_chunkers_keep_every_word(spark):
    docs = spark.createDataFrame([(1, "One two. Three four five! Six? Seven."), (2, ""), (3, None), (4, "a\n\nb c\n\nd")], "doc_id long, text string")
    for chunker in (K.chunk_fixed, K.chunk_sentence, K.chunk_paragraph, K.chunk_semantic):
        got = chunker(docs, 3).orderBy("doc_id", "chunk_no").collect()
        words = {}
        for r in got:
            words.setdefault(r["doc_id"], []).extend(r["text"].split())
        assert words == {1: "One two. Three four five! Six? Seven.".split(), 4: ["a", "b", "c", "d"]}


def test_windows_and_boundaries(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "")], "doc_id long, text string")
    assert [r["text"] for r in K.window_words(docs, 3, 1).orderBy("chunk_no").collect()] == ["a b c", "c d e"]
    cut = K.chunk_at_boundaries(spark.createDataFrame([(1, "A. B. C.")], "doc_id long, text string"), spark.createDataFrame([(1, [2, 2, 9])], "doc_id long, cuts array<int>"))
    assert [r["text"] for r in cut.orderBy("chunk_no").collect()] == ["A. B.", "C."]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6)], "src long, dst long")
    nodes = spark.range(1, 8)
    assert dict(rows(G.degree(nodes, edges)))[3] == 3 and dict(rows(G.degree(nodes, edges)))[7] == 0
    assert rows(G.triangles(edges)) == [(1, 1), (2, 1), (3, 1)]
    reach = {r["id"]: r["hops"] for r in G.traverse(spark.range(1, 2), edges, 3).collect()}
    assert reach == {2: 1, 3: 2, 4: 3}
    p = G.shortest_paths(spark.createDataFrame([(1, 6), (1, 7), (2, 2)], "start long, goal long"), edges)
    assert {(r["start"], r["goal"]): r["path"] for r in p.collect()} == {(1, 6): [1, 3, 4, 5, 6], (2, 2): [2]}
    assert sum(r["rank"] for r in G.pagerank(nodes, edges).collect()) == pytest.approx(1.0)
    assert ([1, 2, 3, 4],) in [(r["path"],) for r in G.all_paths(spark.range(1, 2), edges, 3).collect()]


def test_access(spark):
    users = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "user_id long, is_active boolean")
    cubes = spark.createDataFrame([(10, "a", 1, True), (11, "b", 2, False)], "cube_id long, cube_name string, owner_id long, is_active boolean")
    links = spark.createDataFrame([(2, 10), (3, 10)], "user_id long, cube_id long")
    asked = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10), (2, 11)], "user_id long, cube_id long")
    assert rows(store.accessible(asked, users, cubes, links)) == [(1, 10), (2, 10)]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id":"1","memory":"x","metadata":{"k":"v"},"created_at":"2024-01-02T03:04:05Z","updated_at":"no"}]')
    (tmp_path / "t.json").write_text('{"nodes":[{"id":"2","memory":"y"}]}')
    got = {r["id"]: r for r in io.read_memories(spark, str(tmp_path)).collect()}
    assert got["1"]["metadata"] == {"k": "v"} and got["1"]["created_at"] is not None and got["1"]["updated_at"] is None
    assert got["2"]["memory"] == "y"
    df = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "id long, text string, cube_id string")
    io.write_cube(df, str(tmp_path / "cube"))
    assert [r["id"] for r in io.read_cube(spark, str(tmp_path / "cube"), "c2").collect()] == [2]
    for stamp in ("1", "2", "3"):
        io.snapshot(df, str(tmp_path / "snap"), stamp)
    assert {r["snapshot"] for r in io.read_snapshots(spark, str(tmp_path / "snap"), 2).collect()} == {2, 3}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "ok.txt").write_text("﻿hello   there")
    (tmp_path / "texts" / "bad.txt").write_text("\x01\x02\x03\x04")
    assert [r["text"] for r in io.read_text_docs(spark, str(tmp_path / "texts"), True).collect()] == ["hello there"]
    io.export_graph_json(spark.range(3), spark.createDataFrame([(0, 1)], "src long, dst long"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "nodes")).count() == 3
    io.append_audit_log(spark.range(2), str(tmp_path / "audit"))
    io.append_audit_log(spark.range(2), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4


def test_long_documents_are_ingested_whole(spark, tmp_path):
    from loomtext.plans import registry

    texts = {1: "One sentence of many words. " * 5000, 2: "Short but sound text.", 3: "tiny", 4: "x" * 1_000_001}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["ingest_documents"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got if r["error"]} == {3, 4}
    sums = {k: sum(r["tokens"] for r in got if r["doc_id"] == k) for k in (1, 2)}
    marks = 5000 // 2
    assert 25_000 <= sums[1] <= 25_000 + marks and sums[2] == 4


def test_pagerank_query_takes_all_links(spark, tmp_path):
    from loomtext.plans import registry

    spark.createDataFrame([(1,), (2,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k,) for k in range(1, 6)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(1, 1), (1, 2), (2, 3), (2, 4), (2, 4)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    rank = {r["id"]: r["rank"] for r in registry.QUERIES["graph_pagerank"](spark, str(tmp_path)).collect()}
    linked = [rank[1_000_000 + k] for k in (1, 2, 3, 4)]
    assert max(linked) == pytest.approx(min(linked), abs=1e-8) and min(linked) > rank[1_000_005] + 1e-6
