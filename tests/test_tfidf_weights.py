"""The weights of build_tfidf against a plain version, with few words broadcast and with repeated ids."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.operators import search as S


@pytest.mark.parametrize("most", [1_000_000, 5, 0])
def test_weights_of_frequent_and_rare_words(spark, monkeypatch, most):
    monkeypatch.setattr(S, "BROADCAST_WORDS", most)
    rng = random.Random(3)
    rows = [(k, " ".join(f"word{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(30)))) for k in range(40)]
    rows += [(7, rows[7][1]), (None, "word1 only"), (100, None)]
    memories = spark.createDataFrame(rows, "id long, text string")
    counts, totals = Counter(), {}
    for i, text in rows:
        words = (text or "").split()
        totals[i] = len(words)
        counts.update((i, w) for w in words)
    df = Counter(w for _, w in counts)
    want = {(i, w): round(n / totals[i] * math.log(len(rows) / df[w]), 9) for (i, w), n in counts.items()}
    out = S.build_tfidf(memories)
    got = [((r["id"], r["term"]), round(r["weight"], 9)) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    queries = spark.createDataFrame([(1, "word1 word2 word30"), (2, "word39 only")], "query_id long, text string")
    once = memories.filter("id is not null and id <> 7")
    full = S.top_k(S.tfidf_scores(queries, S.build_tfidf(once)).withColumn("score", F.round("score", 9)), 3).collect()
    quick = S.tfidf_search(queries, once, 3).collect()
    assert sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in quick) == sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in full)


def test_words_are_counted_in_their_row(spark):
    plan = S.build_tfidf(spark.createDataFrame([(1, "alpha beta")], "id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "LogicalRDD" not in plan  # the counts are written once, with no shuffle of words before
