"""A word index in shards of memories, and exact top-k search that prunes by block maxima.

A map cuts its rows into shards of ``SHARD`` memories and turns each around: one
row per shard and word, with the memories that hold it, their weights, and the
largest weight in each run of ``RUN`` memories.  Building needs no shuffle; stored
once, the table is asked again and again.

A search joins the queries' words with the index, so only their rows are read on,
and deals these by shard.  In a shard, a query adds up the run maxima of its words,
scores the most promising runs whole, and then only those runs whose sum of maxima
reaches its k-th best score so far.  No other memory of the shard can be among the
k best, so the result is exact.  k rows a query and shard are shuffled to be ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.plans.shared import Scratch

SHARD, RUN = 4096, 8
#: Queries of a task at a time; up to this many of their words (16 bytes each) are broadcast.
QUERIES, BROADCAST_WORDS = 2048, 1_000_000
#: Runs that are scored before any are left out.
FIRST_RUNS = 8
#: Scores count as equal to this many decimals, wherever a memory stands.
DECIMALS = 12
POSTINGS = "shard long, word long, docs array<int>, ids array<long>, weights array<double>, runs array<int>, counts array<int>, tops array<double>"
FOUND = "query_id long, id long, score double"


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _turned(shard: int, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, norms: np.ndarray, shares: bool) -> pa.RecordBatch:
    """One row per word of a shard's rows."""
    doc = np.repeat(np.arange(len(ids)), sizes)
    order = np.lexsort((doc, words))
    word, doc = words[order], doc[order]
    at = _starts(word, doc)
    tf = np.diff(np.append(at, len(word)))
    word, doc = word[at], doc[at]
    weight = tf / sizes[doc] if shares else np.ones(len(doc))
    weight = np.divide(weight, norms[doc], out=np.zeros(len(doc)), where=norms[doc] > 0)
    by_word, by_run = _starts(word), _starts(word, doc // RUN)
    tops = np.maximum.reduceat(weight, by_run) if len(by_run) else np.zeros(0)
    per_word, per_run = np.append(by_word, len(word)), np.append(np.searchsorted(by_run, by_word), len(by_run))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(by_word), shard, np.int64)),
            pa.array(word[by_word].astype(np.int64)),
            _lists(doc, per_word, pa.int32()),
            _lists(ids[doc], per_word, pa.int64()),
            _lists(weight, per_word, pa.float64()),
            _lists(doc[by_run] // RUN, per_run, pa.int32()),
            _lists(np.diff(np.append(by_run, len(word))), per_run, pa.int32()),
            _lists(tops, per_run, pa.float64()),
        ],
        ["shard", "word", "docs", "ids", "weights", "runs", "counts", "tops"],
    )


def _turn(batches: Iterator[pa.RecordBatch], shares: bool, size: int) -> Iterator[pa.RecordBatch]:
    part, n, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def built() -> pa.RecordBatch:
        ids, words, sizes, norms = (np.concatenate(x) for x in zip(*held))
        return _turned(part << 32 | n, ids, words, sizes, norms, shares)

    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            piece = batch.slice(lo, size)
            if rows and rows + piece.num_rows > size:
                yield built()
                n, held, rows = n + 1, [], 0
            sizes = pc.list_value_length(piece.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            norms = piece.column(2).fill_null(0.0).to_numpy(zero_copy_only=False)
            held.append((piece.column(0).to_numpy(zero_copy_only=False), piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, norms))
            rows += piece.num_rows
    if held:
        yield built()


def postings(rows: DataFrame, shares: bool, shard: int = SHARD) -> DataFrame:
    """The index of rows (id, words ARRAY<LONG>, norm): a word weighs 1 (or, with shares, its share of the row's words), over the norm."""
    return rows.filter("id is not null").select(F.col("id").cast("long").alias("id"), "words", F.col("norm").cast("double").alias("norm")).mapInArrow(partial(_turn, shares=shares, size=shard), POSTINGS)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """The rows of one shard that the queries' words have brought together."""

    def __init__(self, table: pa.Table):
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = lambda name: table.column(name).combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.docs, self.ids, self.weights = flat("docs"), flat("ids"), flat("weights")
        self.runs, self.counts, self.tops = flat("runs"), flat("counts").astype(np.int64), flat("tops")
        self.run_sizes = sizes("runs")
        self.run_starts = np.cumsum(self.run_sizes) - self.run_sizes
        self.starts = np.cumsum(self.counts) - self.counts  # of each run's memories
        self.n_runs = int(self.runs.max(initial=0)) + 1
        asked = sizes("queries")
        row, query, weight = np.repeat(np.arange(table.num_rows), asked), flat("queries"), flat("q")
        order = np.argsort(query, kind="stable")
        self.row, self.query, self.weight = row[order], query[order], weight[order]
        self.scored = self.held = 0  # memories looked at, memories that hold words asked for

    def _score(self, runs: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of one memory each, scores) in the marked runs; at: the runs of the query's words."""
        keep = runs[self.runs[at]]
        counts = self.counts[at[keep]]
        places = _spread(self.starts[at[keep]], counts)
        self.scored += len(places)
        docs, found = np.unique(self.docs[places], return_inverse=True)
        scores = np.bincount(found, self.weights[places] * np.repeat(weight[keep], counts), len(docs))
        one = np.zeros(len(docs), np.int64)
        one[found] = places
        return one, np.round(scores, DECIMALS)

    def search(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best memories of each query with a score over 0, equal scores by id."""
        out: list[tuple] = []
        firsts = _starts(self.query)
        for a, b in zip(firsts, np.append(firsts[1:], len(self.query))):
            rows, q = self.row[a:b], self.weight[a:b]
            at = _spread(self.run_starts[rows], self.run_sizes[rows])
            weight = np.repeat(q, self.run_sizes[rows])
            self.held += int(self.counts[at].sum())
            bound = np.bincount(self.runs[at], np.maximum(0.0, self.tops[at] * weight), self.n_runs)
            first = np.zeros(self.n_runs, bool)
            n = min(max(FIRST_RUNS, -(-k // RUN)), self.n_runs)
            first[np.argpartition(bound, self.n_runs - n)[self.n_runs - n :]] = True
            places, scores = self._score(first, at, weight)
            least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
            rest = ~first & (bound > 0) & (bound >= least - 10.0**-DECIMALS)
            if rest.any():
                more, scores_2 = self._score(rest, at, weight)
                places, scores = np.concatenate([places, more]), np.concatenate([scores, scores_2])
            ids = self.ids[places]
            good = scores > 0
            ids, scores = ids[good], scores[good]
            best = np.lexsort((ids, -scores))[:k]
            out.append((np.full(len(best), self.query[a]), ids[best], scores[best]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))


def _shard_search(k: int):
    def found(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(c) for c in Shard(table).search(k)], ["query_id", "id", "score"])

    return found


def matched(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The index rows of words of asked (query_id, word, weight), each with the queries (of one bucket) that ask for it."""
    asked = Scratch(asked.sparkSession, "asked").keep(asked)
    size = asked.agg(F.count("*").alias("words"), F.count_distinct("query_id").alias("queries")).first()
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-size["queries"] // QUERIES)))).alias("bucket")
    by_word = asked.groupBy("word", bucket).agg(F.collect_list(F.struct("query_id", "weight")).alias("a")).select("word", "bucket", F.col("a.query_id").alias("queries"), F.col("a.weight").cast("array<double>").alias("q"))
    return index.join(F.broadcast(by_word) if size["words"] <= BROADCAST_WORDS else by_word, "word")


def search(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): up to k best rows of each shard for each query of asked (query_id, word, weight)."""
    return matched(asked, index).groupBy("shard", "bucket").applyInArrow(_shard_search(k), FOUND)
