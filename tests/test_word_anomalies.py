"""Frequent words of a text, found in its row."""

import random
from collections import Counter

from loomtext.operators import analyze as A


def test_word_anomalies_shuffle_only_what_they_find(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["A", "a", "b", "c", "d", "e"], weights=[w, w, 3, 2, 2, 2], k=rng.randint(0, 30)))) for i, w in enumerate(rng.choices([0, 1, 2, 3], k=300))]
    rows += [(1000, "x x x"), (1000, "x y z x y z x x"), (1001, None), (1002, "  "), (None, "q " * 12), (1003, "x x x y y y y z z z"), (1004, "x y z " * 10)]
    held = {}
    for i, text in rows:
        held.setdefault(i, Counter()).update((text or "").lower().split())
    expected = {i: max(c.values()) / c.total() for i, c in held.items() if c.total() >= 10 and max(c.values()) / c.total() > 0.3}
    got = A.word_anomalies(spark.createDataFrame(rows, "id long, text string"))
    assert {r["id"]: r["share"] for r in got.collect()} == expected and 1000 in expected and None in expected and 20 < len(expected) < 250
    # words are shuffled for the ids found alone
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
