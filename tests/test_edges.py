"""Edges of words in the patterns of propositions."""

import random
import re

from pyspark.sql import functions as F

from loomtext.functions import features as X
from loomtext.functions import text as T

PATTERNS = [*X.SUBJECTS, *X.PREDICATES, *X.RELATIONS, *X.DATES, X.ENTITY, "|".join(X.SUBJECTS), "|".join(X.PREDICATES), "|".join(X.DATES), r"(?i)\b(is|are|was|were|has|have|had|will|can)\b"]


def test_edges_look_to_one_side_and_find_the_same(spark):
    rng = random.Random(7)
    parts = ["the ", "The", "is", "IS ", "was ", "has", "_", "é", "ö ", "belongs to", " ", "Ab", "Cd ", "walked", "ing", "s", "1", "12/3/2024", " 2024-01-02", "May 3, 2024", ".", ",", "\n", "located", "I", "he "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select("s", *[F.regexp_extract_all("s", F.lit(T.ascii_edges(p)), F.lit(0)).alias(f"p{k}") for k, p in enumerate(PATTERNS)])
    for r in found.collect():
        for k, p in enumerate(PATTERNS):
            assert r[f"p{k}"] == [m[0] for m in re.finditer(p, r["s"], re.ASCII)], (p, r["s"])
    assert not any("|(?<=" in T.ascii_edges(p) for p in PATTERNS)
