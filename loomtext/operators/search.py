"""Top-k retrieval: many queries at once over many memories.

Queries and memories are DataFrames ``(query_id, text)`` and ``(id, text)``;
results are ``(query_id, id, score, rank)``, ordered by score, then id.
Top-k search by words asks an inverted index in shards, stored or made on the
way, which keeps k per query and shard (``inverted``); top-k search by vectors
sends blocks of queries over the memories and keeps k per query and task.
Scores of all pairs (``keyword_scores`` and the like) are equi-joins on words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.shared import BROADCAST_IDS, Scratch

from . import inverted
from .words import of_ids, repeated_ids, word_counts

#: Queries that are broadcast at a time.
QUERY_BLOCK = 4096
#: Words that are broadcast with their idf, at most.
BROADCAST_WORDS = 1_000_000
#: Cells of a matrix of memories or of scores that a task works on.
CELLS = 2_000_000


def top_k(scored: DataFrame, k: int | Column, *within: str) -> DataFrame:
    """The k best rows per group, ranked; Spark cuts each partition to k rows before it shuffles."""
    order = Window.partitionBy(*(within or ("query_id",))).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_scores(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """score = how many query words, with repeats, the memory holds."""
    asked = queries.select("query_id", F.explode(T.clean_words(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    held = memories.select("id", F.explode(F.array_distinct(T.clean_words(F.col("text")))).alias("word"))
    return held.join(asked, "word").groupBy("query_id", "id").agg(F.sum("times").alias("score"))


class Best:
    """The k best (query, id, score) of what a task has seen; equal scores by id."""

    def __init__(self, n_queries: int, k: int):
        self.n, self.k = n_queries, k
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def take(self, ids: np.ndarray, score: np.ndarray, least: float | None) -> None:
        """score: one row a query, one column an id."""
        wanted = np.ones(score.shape, bool) if least is None else score > least
        if score.shape[1] > self.k:  # all that reach the k-th best, so that ids decide among equals
            wanted &= score >= np.partition(score, score.shape[1] - self.k, axis=1)[:, [score.shape[1] - self.k]]
        i, j = np.nonzero(wanted)
        q, d, s = (np.concatenate(x) for x in zip(self.rows, (i, ids[j], score[i, j])))
        order = np.lexsort((d, -s, q))
        first = np.searchsorted(q[order], np.arange(self.n))
        keep = order[np.arange(len(order)) - first[q[order]] < self.k]
        self.rows = q[keep], d[keep], s[keep]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        q, d, s = self.rows
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(d), pa.array(s)], ["query_id", "id", "score"])


def word_search(asked: DataFrame, rows: DataFrame, k: int, shares: bool) -> DataFrame:
    """The k best rows (id, words ARRAY<LONG>, norm) for each query of asked (query_id, word, weight).

    Score: the sum over shared words of the query's weight times 1 (or, with
    shares, the word's share of the row's words), over the row's norm.
    """
    return top_k(inverted.search(asked, inverted.postings(rows, shares), k), k)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _asked(queries: DataFrame, words: Column) -> DataFrame:
    """(query_id, word, times): word hashes of the queries."""
    return queries.select("query_id", F.explode(_hashed(words)).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))


def keyword_search(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    asked = _asked(queries, T.clean_words(F.col("text"))).select("query_id", "word", F.col("times").cast("double").alias("weight"))
    rows = memories.select("id", F.array_distinct(_hashed(T.clean_words(F.col("text")))).alias("words"), F.lit(1.0).alias("norm"))
    return word_search(asked, rows, k, shares=False).withColumn("score", F.col("score").cast("long"))


def substring_search(query: str, memories: DataFrame, k: int) -> DataFrame:
    """Memories that hold the query: 1.0 if equal, 0.9 at the start, else 0.8 (all its words are there)."""
    low, asked = F.lower("text"), query.lower()
    parts = asked.split()
    share = sum(F.contains(low, F.lit(w)).cast("int") for w in parts) / len(parts) if parts else None
    score = F.when(low == asked, 1.0).when(low.startswith(asked), 0.9).otherwise(0.8 * share if parts else F.lit(0.1))
    found = memories.filter(F.contains(low, F.lit(asked))).select("id", score.alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k)


def _with_idf(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """counted (id, total, word, tf) with the idf of its words, of a written idf (word, df, idf).

    The most frequent words, up to BROADCAST_WORDS, are broadcast, and most rows
    hold one of them; only rows of rarer words are shuffled, to be joined.
    """
    often = idf.filter("df > 1").groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count("*").alias("n")).collect()  # a row for each power of two
    least, held = 2**63 - 1, 0
    for r in sorted(often, key=lambda r: -r["power"]):
        held += r["n"]
        if held > BROADCAST_WORDS:
            break
        least = 2 ** r["power"]
    known = F.broadcast(idf.filter(F.col("df") >= least).select("word", "idf"))
    near = counted.join(known, "word").select("id", "total", "word", "tf", "idf")
    rest = counted.join(known.select("word"), "word", "left_anti").join(idf.filter(F.col("df") < least), "word")
    return near.unionByName(rest.select("id", "total", "word", "tf", "idf"))


def _idf(scratch: Scratch, held: DataFrame, n: DataFrame) -> DataFrame:
    """(word, df, idf), written, of held (word): a row for each memory that holds a word."""
    df = held.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(n))  # one row
    return scratch.keep(df.select("word", "df", F.ln(F.col("n_memories") / F.col("df")).alias("idf")))


def _counted(rows: DataFrame) -> DataFrame:
    """(id, total, word, tf) of rows (id, words), counted in the row; rows of one id and as many words count together, by a shuffle."""
    repeated = repeated_ids(rows)
    if repeated is None:
        return word_counts(rows)
    together = word_counts(of_ids(rows, repeated, True)).groupBy("id", "total", "word").agg(F.sum("tf").cast("int").alias("tf"))
    return word_counts(of_ids(rows, repeated, False)).unionByName(together.select("id", "total", "word", "tf"))


def build_tfidf(memories: DataFrame, min_bytes: int = 2) -> DataFrame:
    """(id, term, weight): share of the memory's words times ln(N / memories that hold the term)."""
    scratch = Scratch(memories.sparkSession, "build-tfidf")
    words = memories.select("id", T.clean_words(F.col("text"), min_bytes).alias("words"))
    counted = scratch.keep(_counted(words))
    idf = _idf(scratch, counted.select("word"), memories.agg(F.count("*").alias("n_memories")))
    return _with_idf(counted, idf).select("id", F.col("word").alias("term"), (F.col("tf") / F.col("total") * F.col("idf")).alias("weight"), "idf")


def tfidf_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Cosine of raw query counts times idf with the memory weights, over terms the index knows."""
    terms = index.groupBy("term").agg(F.first("idf").alias("idf"))
    asked = queries.select("query_id", F.explode(T.clean_words(F.col("text"), 2)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    asked = asked.join(terms, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("q"))
    q_norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    norms = index.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = index.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    scored = dots.join(norms, "id").join(q_norm, "query_id").select("query_id", "id", F.try_divide("dot", F.col("norm") * F.col("q_norm")).alias("score"))
    return scored.filter("score > 0")


def stored_tfidf(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index for top-k search, written once in the shared folder: postings in shards and (word, idf), by word hash."""
    scratch = Scratch(memories.sparkSession, "tfidf")
    rows = scratch.keep(memories.select("id", _hashed(T.clean_words(F.col("text"), 2)).alias("words")))
    counted = _counted(rows)
    idf = _idf(scratch, counted.select("word"), rows.agg(F.count("*").alias("n_memories")))
    weight = F.col("tf") / F.col("total") * F.col("idf")
    norms = scratch.keep(_with_idf(counted, idf).groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm")))
    norms = F.broadcast(norms) if norms.count() <= BROADCAST_IDS else norms
    index = scratch.keep(inverted.postings(rows.join(norms, "id").filter("norm > 0"), shares=True))
    scratch.drop_all_but(index, idf)
    return index, idf


def search_tfidf(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """Top-k over a stored index: of the memories, only the postings of the queries' words are shuffled."""
    postings, idf = index
    asked = _asked(queries, T.clean_words(F.col("text"), 2)).join(idf, "word").withColumn("q", F.col("times") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("query_id")))
    # a row's weight of a word is its share times the idf
    asked = asked.withColumn("q_norm", norm).filter("q_norm > 0").select("query_id", "word", (F.col("q") * F.col("idf") / F.col("q_norm")).alias("weight"))
    return top_k(inverted.search(asked, postings, k), k)


def tfidf_search(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    return search_tfidf(queries, stored_tfidf(memories), k)


def fast_search(queries: DataFrame, memories: DataFrame, k: int, scope: Column | None = None) -> DataFrame:
    """top_k of fast_scores, with a memory counted once for each word it holds."""
    rows = memories.select("id", (scope if scope is not None else F.lit(True)).alias("inside"), _hashed(T.words(F.lower("text"))).alias("words"), F.lit(1.0).alias("norm"))
    asked = _asked(queries, T.words(F.lower("text")))
    n = memories.agg(F.count("*").alias("n_memories"))
    # only the queries' words are counted
    df = rows.select(F.explode(F.array_distinct("words")).alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "word").join(F.broadcast(n))  # one row
    weighted = weighted.select("query_id", "word", (F.col("times") * F.ln(F.col("n_memories") / (1 + F.col("df")))).alias("weight"))
    return word_search(weighted, rows.filter("inside"), k, shares=True)


def fast_scores(queries: DataFrame, memories: DataFrame, scope: Column | None = None, df_mode: str = "documents") -> DataFrame:
    """Sum over query words of tf * ln(N / (1 + postings)), words uncleaned.

    scope limits the memories that may be found, not N and the postings.
    df_mode "occurrences" counts a posting for each occurrence of a word.
    """
    words = memories.select("*", T.words(F.lower("text")).alias("words"))
    n = words.agg(F.count("*").alias("n_memories"))
    counted = words.select("id", (scope if scope is not None else F.lit(True)).alias("inside"), F.size("words").alias("total"), F.explode("words").alias("term")).groupBy("id", "inside", "term", "total").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg((F.count("*") if df_mode == "documents" else F.sum("tf")).alias("df"))
    asked = queries.select("query_id", F.explode(T.words(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    hits = counted.filter("inside").join(asked.join(df, "term"), "term").join(F.broadcast(n))  # one row
    value = F.col("times") * F.col("tf") / F.col("total") * F.ln(F.col("n_memories") / (1 + F.col("df")))
    return hits.groupBy("query_id", "id").agg(F.sum(value).alias("score")).filter("score > 0")


# --- vectors --------------------------------------------------------------


def _nearest(batches: Iterator[pa.RecordBatch], block, k: int, metric: str, least: float | None) -> Iterator[pa.RecordBatch]:
    ids_q, q = block.value
    best = Best(len(ids_q), k)
    step = max(1, CELLS // len(ids_q))
    for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
        sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(sizes == q.shape[1])
        if not len(rows):
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
        v = np.array(batch.column(1).take(pa.array(rows)).flatten(), np.float64).reshape(-1, q.shape[1])
        score = q @ v.T
        if metric == "cosine":
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
            score = np.divide(score, norms, out=np.zeros_like(score), where=norms > 0)
        elif metric == "euclidean":
            score = 1 / (1 + np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * score)))
        best.take(ids, score, least)
    yield best.batch(ids_q)


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", min_score: float | None = None) -> DataFrame:
    """Up to k best vectors per query and partition; (query_id, vector) and (id, vector) come in, both with long ids.

    Queries are sent in blocks of QUERY_BLOCK, so what is broadcast is bounded.
    """
    spark, out, held = queries.sparkSession, None, []

    def scored() -> DataFrame:
        block = (np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64))
        return vectors.select("id", "vector").mapInArrow(partial(_nearest, block=spark.sparkContext.broadcast(block), k=k, metric=metric, least=min_score), "query_id long, id long, score double")

    for row in queries.select("query_id", "vector").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            out = scored() if out is None else out.unionByName(scored())
            held = []
    if held:
        out = scored() if out is None else out.unionByName(scored())
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, score double")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", min_score: float | None = None) -> DataFrame:
    return top_k(vector_scores(queries, vectors, k, metric, min_score), k)


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = 0.1, memories: DataFrame | None = None) -> DataFrame:
    """Nearest vectors; queries without a vector fall back to the TF-IDF search of their text, if memories are given."""
    if memories is None:
        return knn(queries, vectors, k, "cosine", min_score)
    found = knn(queries.filter("vector is not null"), vectors, k, "cosine", min_score)
    return found.unionByName(tfidf_search(queries.filter("vector is null").select("query_id", "text"), memories, k).select(found.columns))


def hybrid_merge(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """The first k/2 + 1 lexical rows, then the semantic ones, each id once, cut at k."""
    both = lexical.filter(F.col("rank") <= k // 2 + 1).withColumn("source", F.lit(0)).unionByName(semantic.withColumn("source", F.lit(1)))
    first = Window.partitionBy("query_id", "id").orderBy("source", "rank")
    order = Window.partitionBy("query_id").orderBy("source", "rank", "id")
    once = both.withColumn("seen", F.row_number().over(first)).filter("seen = 1").drop("seen", "score")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_id", "id", "source", F.col("place").alias("rank"))


def two_stage_search(queries: DataFrame, memories: DataFrame, k: int, rerank: Column) -> DataFrame:
    """3k fast candidates, reordered by a score over (text, score), cut at k."""
    first = fast_search(queries, memories, 3 * k).drop("rank")
    scored = first.join(memories.select("id", "text"), "id").withColumn("score", rerank).select("query_id", "id", "score")
    return top_k(scored, k)


def merge_results(parts: list[DataFrame], k: int) -> DataFrame:
    """Rows of several collections by score (null counts as 0), cut at k per query."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "collection", "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merge_dedup(local: DataFrame, remote: DataFrame, k: int) -> DataFrame:
    """Both lists, the local row of an id first; the k best by score."""
    both = local.withColumn("source", F.lit(0)).unionByName(remote.withColumn("source", F.lit(1)))
    first = Window.partitionBy("query_id", "id").orderBy("source")
    once = both.withColumn("seen", F.row_number().over(first)).filter("seen = 1").drop("seen")
    return top_k(once, k)


def scoped_search(queries: DataFrame, memories: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, cube_id, id, score, rank): keyword_search of queries in memories (id, cube_id, text), for each pair (query_id, cube_id).

    A word and its cube make one key, so memories of other cubes never reach a score.
    """
    pairs = Scratch(queries.sparkSession, "pairs").keep(pairs.select("query_id", "cube_id").withColumn("pair", F.monotonically_increasing_id()))
    words = queries.select("query_id", F.explode(T.clean_words(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    asked = words.join(pairs, "query_id").select(F.col("pair").alias("query_id"), F.xxhash64("word", "cube_id").alias("word"), F.col("times").cast("double").alias("weight"))
    held = F.transform(F.array_distinct(T.clean_words(F.col("text"))), lambda w: F.xxhash64(w, F.col("cube_id")))
    found = word_search(asked, memories.select("id", held.alias("words"), F.lit(1.0).alias("norm")), k, shares=False)
    found = found.withColumnRenamed("query_id", "pair").join(pairs, "pair")
    return found.select("query_id", "cube_id", "id", F.col("score").cast("long").alias("score"), "rank")


def search_cubes(queries: DataFrame, memories: DataFrame, cubes: DataFrame, k: int) -> DataFrame:
    """k keyword results for each query and cube, all cubes in one job; unknown cubes drop out."""
    cubes = cubes.select("cube_id").distinct()
    inside = memories.join(cubes, "cube_id", "left_semi").select("id", "cube_id", "text")
    listed = cubes.agg(F.collect_list("cube_id").alias("cubes"))
    each = queries.select("query_id").distinct().join(F.broadcast(listed)).select("query_id", F.explode("cubes").alias("cube_id"))  # one row
    return scoped_search(queries, inside, each, k)


def retrieve_for_messages(messages: DataFrame, memories: DataFrame, users: DataFrame, cubes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(query_id, cube_id, id, score, rank): for each message (query_id, user_id, text) the k best memories of every cube its user may read."""
    active = users.filter("is_active").select("user_id")
    reads = cubes.filter("is_active").select("cube_id", F.col("owner_id").alias("user_id")).unionByName(links.select("cube_id", "user_id").join(cubes.filter("is_active").select("cube_id"), "cube_id", "left_semi")).distinct()
    allowed = messages.join(active, "user_id", "left_semi").join(reads, "user_id").select("query_id", "cube_id")
    return scoped_search(messages.select("query_id", "text"), memories.select("id", "cube_id", "text"), allowed, k)


def memory_type_scope(memories: DataFrame, kind: str | None = None) -> DataFrame:
    """Memories of one type (a filter on a column that tables can be partitioned by); all without a type."""
    return memories if kind is None else memories.filter(F.col("memory_type") == kind)


def replace_working_memory(memories: DataFrame, fresh: DataFrame) -> DataFrame:
    """The working memories of the cubes in fresh are exchanged for those; all else stays."""
    mine = F.col("memory_type") == "WorkingMemory"
    others = memories.filter(~F.coalesce(mine, F.lit(False))).unionByName(memories.filter(mine).join(fresh.select("cube_id").distinct(), "cube_id", "left_anti").select(memories.columns))
    return others.unionByName(fresh.withColumn("memory_type", F.lit("WorkingMemory")).select(memories.columns))


def hydrate(results: DataFrame, memories: DataFrame) -> DataFrame:
    return results.join(memories, "id")


def working_memory(memories: DataFrame, n: int = 100) -> DataFrame:
    """The n newest memories of each cube."""
    order = Window.partitionBy("cube_id").orderBy(F.desc("updated_at"), "id")
    return memories.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def merge_working_memory(old: DataFrame, new: DataFrame, top: int, extra: int) -> DataFrame:
    """(user_id, pos, text): old rows, then new ones; each text once, the first; cut at top + extra per user."""
    both = old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))
    once = both.groupBy("user_id", "text").agg(F.min(F.struct("part", "pos")).alias("at"))
    order = Window.partitionBy("user_id").orderBy("at", "text")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top + extra).select("user_id", "text", "place")


def evidence_budget(evidence: DataFrame, k: int) -> DataFrame:
    """(query_id, evidence_id) with how many results each evidence may bring: max(1, k / n)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return evidence.withColumn("quota", F.greatest(F.floor(F.lit(k) / n), F.lit(1)))


def evidence_search(evidence: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(query_id, evidence_id, id, score, rank): for each evidence (query_id, evidence_id, text) its share of the k results."""
    numbered = Scratch(evidence.sparkSession, "evidence").keep(evidence.select("query_id", "evidence_id", "text").withColumn("nth", F.monotonically_increasing_id()))
    quotas = evidence_budget(numbered.select("query_id", "evidence_id", "nth"), k)
    found = keyword_search(numbered.select(F.col("nth").alias("query_id"), "text"), memories, k).withColumnRenamed("query_id", "nth")
    return found.join(quotas, "nth").filter("rank <= quota").select("query_id", "evidence_id", "id", "score", "rank")


def build_context(results: DataFrame, memories: DataFrame, prompt: str) -> DataFrame:
    """One prompt per query: the base text and its numbered memories in rank order."""
    listed = results.join(memories.select("id", "text"), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("m"))
    lines = F.transform("m", lambda m: F.concat(m["rank"].cast("string"), F.lit(". "), m["text"]))
    return listed.select("query_id", F.concat(F.lit(prompt + "\n\n"), F.array_join(lines, "\n")).alias("prompt"))
