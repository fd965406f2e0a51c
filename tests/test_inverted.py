"""The inverted index against scores of all pairs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.operators import inverted as I
from loomtext.operators import search as S


def plain(rows, asked, k, shares):
    out = []
    for query, words in asked.items():
        found = []
        for i, held, norm in rows:
            score = sum(q * ((held.count(w) / len(held)) if shares else 1.0) for w, q in words.items() if w in held)
            score = round(score / norm, 9) if norm and norm > 0 else 0.0
            if score > 0:
                found.append((-score, i))
        out += [(query, i, -s) for s, i in sorted(found)[:k]]
    return sorted(out)


def fixture(n=400, seed=1):
    """Rows of very different lengths, a word that a third of them hold, copies, empty and null ones; negative weights too."""
    rng = random.Random(seed)
    words = [rng.randrange(-(2**62), 2**62) for _ in range(60)]
    rows = []
    for i in range(n):
        held = [words[min(int(rng.expovariate(0.15)), 59)] for _ in range(rng.choice([1, 2, 5, 30]))] + ([words[0]] if i % 3 == 0 else [])
        rows.append((i * 7 - 50, held, rng.choice([1.0, 1.0, 0.5, 2.5])))
    rows += [(10_000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(9000, [], 1.0), (9001, [words[1]], 0.0), (9002, None, 1.0), (9003, [words[2]], None)]
    asked = {q: {words[rng.randrange(60)]: rng.choice([1.0, 0.3, 2.0, -0.4]) for _ in range(rng.randint(1, 12))} for q in range(25)}
    asked[99] = {words[0]: 1.0}
    asked[100] = {123: 1.0}  # in no row
    return rows, asked


def tables(spark, rows, asked):
    held = spark.createDataFrame(rows, "id long, words array<long>, norm double")
    return held, spark.createDataFrame([(q, w, x) for q, ws in asked.items() for w, x in ws.items()], "query_id long, word long, weight double")


def ranked(df, k):
    return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in S.top_k(df, k).collect())


def test_search_equals_all_pairs(spark):
    rows, asked = fixture()
    held, queries = tables(spark, rows, asked)
    clean = [(i, w or [], n) for i, w, n in rows]
    for shares in (True, False):
        for shard, k in ((I.SHARD, 5), (64, 5), (13, 1), (64, 1000)):
            got = ranked(I.search(queries, I.postings(held.repartition(3), shares, shard), k), k)
            assert got == plain(clean, asked, k, shares), (shares, shard, k)


def test_a_stored_index_and_many_buckets(spark, monkeypatch, tmp_path):
    rows, asked = fixture(seed=4)
    held, queries = tables(spark, rows, asked)
    I.postings(held, True, 50).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    want = plain([(i, w or [], n) for i, w, n in rows], asked, 4, True)
    assert ranked(I.search(queries, index, 4), 4) == want
    monkeypatch.setattr(I, "QUERIES", 3)
    monkeypatch.setattr(I, "BROADCAST_WORDS", 0)
    assert ranked(I.search(queries, index, 4), 4) == want
    assert I.search(queries.limit(0), index, 4).count() == 0 and I.search(queries, index.limit(0), 4).count() == 0


def test_most_memories_are_left_out():
    """Rare words decide: of the memories that hold a query's words a small share is scored, none that counts is lost."""
    rng = np.random.default_rng(3)
    n, common = 4096, 40
    sizes = np.full(n, 30)
    words = rng.integers(0, common, (n, 30))
    for q in range(8):  # six memories hold two rare words of each query
        words[rng.choice(n, 6, replace=False), :2] = [1000 + q, 2000 + q]
    ids = np.arange(n) * 3
    table = pa.Table.from_batches([I._turned(0, ids, words.ravel(), sizes, np.ones(n), True)])
    weight = {w: 0.05 for w in range(common)} | {1000 + q: 6.0 for q in range(8)} | {2000 + q: 5.0 for q in range(8)}
    asks = {q: [1000 + q, 2000 + q, *range(q, q + 12)] for q in range(8)}
    held = table.column("word").to_pylist()
    lists = [[q for q, ws in asks.items() if w in ws] for w in held]
    table = table.append_column("queries", pa.array(lists, pa.list_(pa.int64()))).append_column("q", pa.array([[weight[w]] * len(x) for w, x in zip(held, lists)], pa.list_(pa.float64())))
    shard = I.Shard(table)
    got = sorted(zip(*(c.tolist() for c in shard.search(5))))
    rows = [(int(i), w.tolist(), 1.0) for i, w in zip(ids, words)]
    want = plain(rows, {q: {w: weight[w] for w in ws} for q, ws in asks.items()}, 5, True)
    assert [(q, i, round(s, 9)) for q, i, s in got] == want
    assert shard.scored < 0.1 * shard.held


def test_cubes_are_searched_apart(spark):
    memories = spark.createDataFrame([(1, "a", "red fox"), (2, "a", "red hare"), (3, "b", "red fox fox"), (4, "b", "blue"), (5, None, "red fox")], "id long, cube_id string, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, None)], "query_id long, text string")
    cubes = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "cube_id string")
    got = sorted(tuple(r) for r in S.search_cubes(queries, memories, cubes, 2).select("query_id", "cube_id", "id", "score", "rank").collect())
    assert got == [(1, "a", 1, 2, 1), (1, "a", 2, 1, 2), (1, "b", 3, 2, 1), (2, "b", 4, 1, 1)]
    evidence = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "blue"), (2, 1, "hare")], "query_id long, evidence_id long, text string")
    got = sorted(tuple(r) for r in S.evidence_search(evidence, memories.select("id", "text"), 3).select("query_id", "evidence_id", "id", "rank").collect())
    assert got == [(1, 1, 1, 1), (1, 2, 4, 1), (2, 1, 2, 1)]
