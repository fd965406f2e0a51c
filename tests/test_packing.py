"""Packing of units against a plain fold over the units."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from loomtext.operators import chunk as K
from loomtext.operators.packing import Rule, openings


def folded(sizes, rule, flags):
    """One unit after the other: where chunks open, and how many units they repeat."""
    out, tokens, units = [], 0, 0
    for i, n in enumerate(sizes):
        full = tokens + n > rule.budget and flags[i] and units >= rule.least
        if i == 0 or full or units >= rule.max_units:
            back, held = 0, 0
            while back < min(i, rule.overlap, units) and held + sizes[i - back - 1] <= rule.overlap:
                held += sizes[i - back - 1]
                back += 1
            out.append((i, back))
            tokens, units = n + held, back + 1
        else:
            tokens, units = tokens + n, units + 1
    return out


def test_openings_equal_a_fold():
    rng = random.Random(1)
    for _ in range(600):
        sizes = [rng.choice([0, 1, 1, 2, 3, 9, 40]) if rng.random() < 0.5 else 1 for _ in range(rng.randrange(60))]
        rule = Rule(rng.choice([-1, 0, 1, 5, 20]), rng.choice([1, 2, 7, 2**31 - 1]), rng.choice([0, 1, 3]), rng.choice([0, 0, 1, 4, 15]))
        for flags in ([True] * len(sizes), [rng.random() < 0.3 for _ in sizes]):
            opens, backs = openings(np.array(sizes, np.int64), rule, np.array(flags, bool))
            assert list(zip(opens.tolist(), backs.tolist())) == folded(sizes, rule, flags)
        opens, backs = openings(np.array(sizes, np.int64), rule)
        assert list(zip(opens.tolist(), backs.tolist())) == folded(sizes, rule, [True] * len(sizes))


def test_chunks_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (None, "a b c d e f g"), (5, "é日 🙂, (x) y. z"), (5, "a b c")]
    got = K.chunk_fixed(spark.createDataFrame(rows, "doc_id long, text string"), 3, overlap=1).collect()
    assert sorted(((r["doc_id"], r["chunk_no"], r["text"], r["tokens"]) for r in got), key=str) == sorted(
        [(4, 1, "one", 1), (None, 1, "a b c", 3), (None, 2, "c d e", 3), (None, 3, "e f g", 3), (5, 1, "é日 🙂,", 2), (5, 2, "🙂, (x)", 3), (5, 3, "y. z", 2), (5, 1, "a b c", 3)], key=str
    )
    assert K.chunk_fixed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_given_and_flagged(spark):
    docs = spark.createDataFrame([(1, "One. Two. Three. Four."), (2, "Alone.")], "doc_id long, text string")
    cuts = spark.createDataFrame([(1, [2, 9, 0, 2])], "doc_id long, cuts array<int>")
    got = {(r["doc_id"], r["chunk_no"]): r["text"] for r in K.chunk_at_boundaries(docs, cuts).collect()}
    assert got == {(1, 1): "One. Two.", (1, 2): "Three. Four.", (2, 1): "Alone."}


def test_time_is_linear_in_the_units(spark):
    def took(n):
        words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit("w"), x.cast("string"))), " ")
        docs = spark.range(1).select(F.col("id").alias("doc_id"), words.alias("text"))
        began = time.time()
        rows = K.chunk_fixed(docs, 64, overlap=16).agg(F.count("*").alias("n"), F.max("tokens").alias("most"), F.max("chunk_no").alias("last")).first()
        assert rows["n"] == rows["last"] == -(-(n - 64) // 48) + 1 and rows["most"] == 64
        return time.time() - began

    took(1000)
    assert took(1_000_000) < 40  # a growing state took minutes for a tenth of it


def test_token_counts_without_regular_expressions(spark):
    texts = ["", "a.b,c!?;:()[]{}\"'", "x\ty\nz   é", "..", "don't (stop)", "日本。 🙂!"]
    marks = re.compile(r"""[.,!?;:()\[\]{}"']""")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.T.count_tokens(F.col("t"), "word").alias("w"), K.T.count_tokens(F.col("t"), "simple").alias("s")).collect()
    for r in rows:
        words = len(re.findall(r"[^ \t\n\x0b\f\r]+", r["t"]))
        assert r["w"] == words + len(marks.findall(r["t"])) // 2
        assert r["s"] == words + len(marks.findall(r["t"])) + r["t"].count("\n") + r["t"].count("\t")
