"""The word-set join by blocks of like size: each pair once, and few copies of a set."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import pairs as P


def texts(seed, n, longest):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            words = [w for w in words if rng.random() > 0.3] + rng.sample(vocabulary, rng.randint(0, 5))
        else:
            words = rng.sample(vocabulary, rng.randint(1, longest))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("many", [0.0, 1.0])
@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_pairs_over_blocks_and_tiles(spark, monkeypatch, threshold, many):
    for name, value in {"SET_BLOCK": 19, "LEAST_WORDS": 150, "OWN_COLUMNS": 8, "SHARED_COLUMNS": (4, 16), "EXPANDED": 100, "MANY": many, "PREFIX_FROM": 1.0}.items():
        monkeypatch.setattr(P, name, value)
    held = dict(enumerate(texts(3, 150, 60)))
    sets = {i: set(t.split()) for i, t in held.items()}
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0.0
    expected = sorted((a, b, round(score(a, b), 9)) for a, b in itertools.combinations(sets, 2) if score(a, b) > threshold)
    got = P.token_jaccard_pairs(spark.createDataFrame(list(held.items()), "id long, text string"), threshold)
    assert expected and sorted((r["a"], r["b"], round(r["score"], 9)) for r in got.collect()) == expected


def test_copies_of_a_set_do_not_grow_with_the_sets(spark, monkeypatch):
    """Blocks of a fixed number of sets sent each set once for each (300 here)."""
    monkeypatch.setattr(P, "SET_BLOCK", 10)
    sets = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(1) + (F.col("id") % 100).cast("int")), lambda k: F.xxhash64("id", k)).alias("words"))
    units = P._sized_units(sets, 0.6)
    assert units.count() <= 12 * 3000
    alone = units.filter("i = j").groupBy("id").count()
    assert alone.count() == 3000 and alone.agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("kind", ["words", "vectors"])
def test_rows_are_written_once_and_not_sent_to_each_block(spark, monkeypatch, kind):
    """Each set and vector was shuffled once for each block that its own meets."""
    kept = []
    keep = P.Scratch.keep
    monkeypatch.setattr(P.Scratch, "keep", lambda self, df, **by: kept.append(keep(self, df, **by)) or kept[-1])
    for name, value in {"LEAST_WORDS": 150, "BLOCK": 10, "LARGEST": 20, "TASKS": 30}.items():
        monkeypatch.setattr(P, name, value)
    if kind == "words":
        rows = spark.createDataFrame(list(enumerate(texts(8, 100, 40))), "id long, text string")
        pairs = P.token_jaccard_pairs(rows, 0.3)
    else:
        rng = random.Random(9)
        rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(100)], "id long, vector array<float>")
        pairs = P.cosine_pairs(rows, 0.5)
    assert [k.count() for k in kept] == [100] and len(kept[0].select("block").distinct().collect()) > 4
    assert pairs.count() > 50
    # what is shuffled after the rows are written are numbers of pairs of blocks
    leaf = pairs._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaf.size() == 1 and "Range" in leaf.head().toString()


def test_lsh_pairs_come_once_and_without_a_shuffle(spark, monkeypatch):
    """Vectors were shuffled for each table and block, and pairs once more for each table that finds them."""
    kept = []
    keep = P.Scratch.keep
    monkeypatch.setattr(P.Scratch, "keep", lambda self, df, **by: kept.append(keep(self, df, **by)) or kept[-1])
    for name, value in {"LSH_ROWS": 40, "LSH_BATCH": 16, "BLOCK": 7, "PAIRS": 20}.items():
        monkeypatch.setattr(P, name, value)
    rng = random.Random(10)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(150)] + [(150, [0.0] * 5)]
    found = P.cosine_pairs(spark.createDataFrame(rows, "id long, vector array<double>"), 0.5, "lsh", tables=6, bits=3)
    v = np.array([x for _, x in rows])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    codes = P._codes(v, 6, 3)
    want = [(a, b) for a, b in itertools.combinations(range(151), 2) if v[a] @ v[b] > 0.5 and (codes[a] == codes[b]).any()]
    got = found.collect()
    assert sorted((r["a"], r["b"]) for r in got) == want and len(want) > 500
    assert all(abs(r["score"] - v[r["a"]] @ v[r["b"]]) < 1e-9 for r in got)
    leaf = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert [k.count() for k in kept] == [151] and leaf.size() == 1 and "Range" in leaf.head().toString()
