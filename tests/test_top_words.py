"""Keywords and sentiment in a row, against plain versions."""

from collections import Counter

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import analyze as A
from loomtext.operators import summarize as Z

TEXTS = ["", "a bb", "Good good, (good) bad. Words words wordy!", "{odd} été été's 'tis .... ((((", "beta alpha gamma delta omega sigma sigma", None]


def plain(texts, k=5):
    c = Counter()
    for t in texts:
        for w in (t or "").lower().split():
            if len(w.encode()) > 3 and (bare := w.strip(""".,!?;:"'()[]""")):
                c[bare] += 1
    return [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:k]]


def test_keywords_of_rows_and_of_repeated_ids(spark):
    rows = [*enumerate(TEXTS), (2, "wordy wordy wordy."), (None, "nobody"), (None, "nobody else")]
    df = spark.createDataFrame(rows, "id long, text string")
    of = {i: [t for j, t in rows if j == i] for i in {i for i, _ in rows}}
    want = {i: plain(t) for i, t in of.items() if plain(t)}
    assert {r["id"]: r["keywords"] for r in A.keywords(df).collect()} == want
    now = F.to_timestamp(F.lit("2024-03-01"))
    got = Z.analyze_memory(df.withColumns({"created_at": now, "updated_at": now}), now).collect()
    assert len(got) == len(rows) and all(r["keywords"] == (want.get(r["id"], []) if r["id"] is not None else []) for r in got)


def test_analysis_of_single_ids_is_not_shuffled(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    now = F.to_timestamp(F.lit("2024-03-01"))
    a = Z.analyze_memory(df.withColumns({"created_at": now, "updated_at": now}), now)
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    want = {r["id"]: r["s"] for r in df.select("id", T.sentiment(F.col("text")).alias("s")).collect() if r["id"] != 5}
    assert {r["id"]: r["sentiment"] for r in a.collect() if r["id"] != 5} == want
