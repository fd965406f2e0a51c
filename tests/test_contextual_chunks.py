"""chunk_contextual makes its chunks once, and gives them the places that position_context gives."""

from loomtext.functions.embed import embedder, letter_counts
from loomtext.operators import chunk as K
from loomtext.operators import structure as D


def test_contextual_chunks_are_made_once(spark):
    text = "One two three. However, four five six? Seven eight nine. Ten of ten words here. Next is a list."
    docs = spark.createDataFrame([(1, text), (2, "Alone."), (3, "")], "doc_id long, text string")
    out = D.chunk_contextual(docs, 4, embedder(letter_counts))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    columns = ["doc_id", "chunk_no", "at", "band", "before", "after"]
    want = D.position_context(K.chunk_semantic(docs, 4, embed=embedder(letter_counts)))
    rows = out.collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(tuple(r) for r in want.select(columns).collect()) and len(rows) > 3
    assert all(r["vector"] == [float(r["text"].lower().count(x)) for x in "abcdefghijklmnop"] for r in rows)
