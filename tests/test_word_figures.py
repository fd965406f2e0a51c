"""Figures of words made in a row's own Arrow map, against the column functions they stand for."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import features as X
from loomtext.functions import text as T
from loomtext.operators import chunk as K

TEXTS = ["", " ", "a", "The cats, (the cats) {ate} tree-like pies... Pie! the end.", "e ee eye bcd étude İi", "'tis 'tis .. {} ()", "One two. One two. One two three four?", "\n\n# head\n- x * y <li> <h1 ``` a``` b||||", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_figures_equal_the_column_functions(spark):
    docs = spark.createDataFrame([(k, 1, t, 7) for k, t in enumerate(TEXTS) if t is not None], "doc_id long, chunk_no int, text string, tokens int")
    c = F.col("text")
    want = {r["doc_id"]: r for r in docs.select("doc_id", T.word_count(c).alias("n"), K.repeated_share(c).alias("within"), X.informativeness(c).alias("relevance"), (T.flesch(c) / 100).alias("readability"), F.size(K.keywords_of(c)).alias("keys")).collect()}
    got = {r["doc_id"]: r for r in K.assess_chunks(docs, docs).collect()}
    sizes = {r["doc_id"]: (r["n_words"], len(r["keys"])) for r in K._measured(docs).collect()}
    for k, w in want.items():
        assert sizes[k] == (w["n"], w["keys"])
        assert got[k]["relevance"] == pytest.approx(w["relevance"]) and got[k]["readability"] == pytest.approx(w["readability"])
    # two chunks each, so that coherence shows the repeated share
    both = docs.unionByName(docs.withColumn("chunk_no", F.lit(2)))
    near = {r["doc_id"]: r["integrity"] for r in K.assess_chunks(docs, both).collect()}
    for r in K.assess_chunks(docs, both).collect():
        assert r["coherence"] == pytest.approx(0.7 * want[r["doc_id"]]["within"] + 0.3 * near[r["doc_id"]])
        assert near[r["doc_id"]] == (1.0 if want[r["doc_id"]]["keys"] else 0.0)


def test_neighbours_share_words_and_sentences(spark):
    rows = [(1, 1, "Alpha beta gamma. Same here.", 5), (1, 2, "Same here. Same here. Beta!", 5), (1, 3, "", 0), (2, 1, "Alone.", 1)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string, tokens int")
    got = {(r["doc_id"], r["chunk_no"]): (round(r["similarity"], 6), r["shared"], r["redundant"]) for r in K.adjacent_features(chunks).collect()}
    # alpha beta gamma same here / same here beta
    assert got == {(1, 1): (0.6, 1, False), (1, 2): (0.0, 0, False)}


def test_chunks_are_read_once(spark):
    docs = spark.createDataFrame([(1, "One two. Three four.")], "doc_id long, text string")
    chunks = K.chunk_sentence(docs, 2)
    p = plan(K.assess_chunks(docs, chunks))
    # the documents are read for their own figures and for the chunks, the chunks once
    assert p.count("LogicalRDD") + p.count("LocalRelation") == 2
