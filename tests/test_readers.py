"""Operators that have no SQL twin, against plain versions on small fixtures."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomtext.functions.embed import embedder, letter_counts
from loomtext.operators import chunk as K
from loomtext.operators import graph as G
from loomtext.operators import pairs as P
from loomtext.operators import search as S
from loomtext.operators import structure as D
from loomtext.operators import summarize as Z
from loomtext.sources import io


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def plain_betweenness(nodes, edges):
    near = {v: set() for v in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, before, queue = {s: 0}, dict.fromkeys(nodes, 0), [], {v: [] for v in nodes}, deque([s])
        paths[s] = 1
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        carried = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                carried[v] += paths[v] / paths[w] * (1 + carried[w])
            if w != s:
                score[w] += carried[w]
    return score


def test_betweenness(spark):
    edges = random_edges(12, 16, 1)
    nodes = sorted({v for e in edges for v in e})
    got = {r["id"]: r["score"] for r in G.betweenness(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = plain_betweenness(nodes, edges)
    assert {v: round(x, 9) for v, x in got.items()} == {v: round(x, 9) for v, x in want.items()}


def test_all_paths_use_no_edge_twice(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 1)]
    got = {tuple(r["path"]) for r in G.all_paths(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame(edges, "src long, dst long"), 4).collect()}
    want, now = set(), [((1,), frozenset())]
    for _ in range(4):
        now = [((*p, b), used | {(a, b)}) for p, used in now for a, b in edges if a == p[-1] and (a, b) not in used]
        want |= {p for p, _ in now}
    assert got == want and (1, 2, 1) in got
    some = G.all_paths(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame(edges, "src long, dst long"), 4, spark.createDataFrame([(1,)], "id long"), 1).collect()
    assert [tuple(r["path"]) for r in some] == [(1, 2, 1)]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.59, 0.6, 0.8])
def test_word_set_pairs_equal_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(P, "SET_BLOCK", 17)
    monkeypatch.setattr(P, "EXPANDED", 50)
    monkeypatch.setattr(P, "COLUMNS", 3)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30))] for _ in range(12)]
    texts = ["", "a"] + [" ".join(rng.choice(base)[: rng.randint(1, 40)] + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(4))]) for _ in range(70)]
    sets = [set(t.split()) for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] & sets[b]}
    got = {(r["a"], r["b"]): r["score"] for r in P.token_jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), threshold).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if v > threshold}


def test_word_search_in_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    memories = spark.createDataFrame([(k, text(rng.randint(0, 30))) for k in range(60)], "id long, text string")
    queries = spark.createDataFrame([(k, text(rng.randint(0, 6))) for k in range(30)], "query_id long, text string")
    scored = S.keyword_scores(queries, memories)
    want = sorted(tuple(r) for r in S.top_k(scored, 4).select("query_id", "id", "score", "rank").collect())
    fast = sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in S.top_k(S.fast_scores(queries, memories).withColumn("score", F.round("score", 9)), 4).collect())
    for block in (2048, 7):
        monkeypatch.setattr(S.inverted, "QUERIES", block)
        assert sorted(tuple(r) for r in S.keyword_search(queries, memories, 4).select("query_id", "id", "score", "rank").collect()) == want
        assert sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in S.fast_search(queries, memories, 4).collect()) == fast
    assert S.keyword_search(queries.limit(0), memories, 4).count() == 0


def test_coherence_estimate_is_near_the_exact_mean(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k, k % 2, " ".join(f"w{rng.randrange(30)}" for _ in range(20))) for k in range(60)], "id long, group long, text string")
    exact = {r["group"]: r["coherence"] for r in Z.mean_jaccard(df).collect()}
    near = {r["group"]: r["coherence"] for r in Z.mean_jaccard(df, estimate=True).collect()}
    assert all(abs(exact[g] - near[g]) < 0.05 for g in exact)


def test_semantic_chunks_with_vectors(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb aaaa. aaaa bbbb bbbb. pppp oooo pppp. pppp oooo oooo."), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in K.chunk_semantic(docs, 3, embed=embedder(letter_counts)).orderBy("doc_id", "chunk_no").collect()]
    assert [t for i, t in got if i == 1][-1].startswith("pppp") and {i for i, _ in got} == {1}
    rows = D.chunk_contextual(docs, 3, embedder(letter_counts)).collect()
    assert all(len(r["vector"]) == 16 for r in rows)


def test_table_chunks_begin_with_the_header(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| x{k} | y{k} |" for k in range(20))
    got = D.chunk_multimodal(spark.createDataFrame([(1, table)], "doc_id long, text string"), 30).orderBy("chunk_no").collect()
    assert len(got) > 2 and all(r["text"].startswith("| a | b |\n|---|---|") for r in got)
    assert sum(r["text"].count("| x") for r in got) == 20


def test_sentences_keep_their_digits(spark):
    text = " ".join(f"{k}1 is the number. " for k in range(30))
    got = spark.createDataFrame([(text,)], "text string").select(K.split_sentences(F.col("text")).alias("s")).first()["s"]
    assert got == [f"{k}1 is the number." for k in range(30)]


def test_files(spark, tmp_path):
    deep = '{"a": {"b": [1, {"c": "x"}]}}'
    got = {(r["path"], r["value"]) for r in io.json_paths(spark.createDataFrame([(1, deep)], "id long, j string"), "id", "j").collect()}
    assert got == {("$.a.b[0]", "1"), ("$.a.b[1].c", "x")}
    v, e = spark.range(5), spark.createDataFrame([(0, 1), (1, 4)], "src long, dst long")
    io.export_graph_json(v, e, str(tmp_path / "all"))
    io.export_graph_json(v, e, str(tmp_path / "some"), 3)
    assert spark.read.json(str(tmp_path / "all" / "nodes")).count() == 5 and spark.read.json(str(tmp_path / "some" / "relations")).count() == 1
    m = spark.createDataFrame([("c1", 1), ("c2", 2)], "cube_id string, id long")
    io.write_cube(m, str(tmp_path / "cube"), {"name": "x"}, activation=m.limit(1))
    assert io.read_cube(spark, str(tmp_path / "cube"), cube_id="c2").count() == 1 and io.read_cube_config(spark, str(tmp_path / "cube")) == {"name": "x"}
    io.write_memories(m, str(tmp_path / "tree"), edges=e)
    assert spark.read.json(str(tmp_path / "tree" / "header")).first()["edges"] == 2
    assert io.snapshot_and_clear(m, str(tmp_path / "snap"), "2024").count() == 0 and io.read_snapshots(spark, str(tmp_path / "snap"), 1).count() == 2
    (tmp_path / "h.csv").write_text("name,n\nx,1\ny,2\n")
    (tmp_path / "n.csv").write_text("a,1\nx,1\ny,2\n")
    assert io.read_csv_profiled(spark, str(tmp_path / "h.csv")).columns == ["name", "n"] and io.read_csv_profiled(spark, str(tmp_path / "n.csv")).count() == 3


def test_evidence_and_fallback(spark):
    memories = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta")], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(7, "alpha", None), (8, "alpha", [0.0, 1.0])], "query_id long, text string, vector array<double>")
    got = {(r["query_id"], r["id"]) for r in S.semantic_search(queries, vectors, 1, memories=memories).collect()}
    assert got == {(7, 1), (8, 2)}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_recall_of_the_registered_lsh_join(spark):
    """The registered query on the table against all pairs: at least 0.9 of them, and none else."""
    from loomtext.plans import registry

    sf = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    want = {(r["a"], r["b"]) for r in P.cosine_pairs(v, 0.35).collect()}
    got = {(r["a"], r["b"]) for r in registry.QUERIES["pairs_cosine_lsh"](spark, sf).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0
