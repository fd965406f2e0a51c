"""The estimate of coherence by minimum hashes, against the lambdas that its aggregates stand for."""

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import summarize as Z


def test_minimum_hashes_are_aggregated_by_row(spark):
    df = spark.createDataFrame([(1, 1, "a b c"), (1, 1, "a b d e"), (2, 1, ""), (3, 2, None)], "id long, group long, text string")
    # by the lambdas that the aggregates stand for
    sets = df.select("group", F.array_distinct(T.words(F.lower("text"))).alias("w")).filter(F.size("w") > 0)
    least = sets.select(*[F.array_min(F.transform("w", (lambda k: lambda x: F.xxhash64(F.lit(k), x))(k))) for k in range(Z.ESTIMATES)]).collect()
    alike = sum(a == b for a, b in zip(*least)) / Z.ESTIMATES
    out = Z.mean_jaccard(df, estimate=True)
    assert {r["group"]: r["coherence"] for r in out.collect()} == {1: alike / 3, 2: 1.0}
    # by lambdas it took no aggregate of minima; the plan's text is cut after some of them
    assert "min(xxhash64(" in out._jdf.queryExecution().optimizedPlan().toString()
