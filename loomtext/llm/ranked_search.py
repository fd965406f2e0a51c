"""Ranked lexical search of all documents for each of a set of items, by bags.

Terms are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, with A-Z
lower-cased.  N documents hold a term, L terms in all; a document has n terms,
and a term tf times; df documents hold a term.  A term weighs
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, a document has
``m = 10 + (90 * n * N) div L``, and its score for an item is the sum of
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the item's distinct
terms, in whole numbers.

1. A map over the texts restricts each document to the items' vocabulary: its
   bag, the 64-bit hashes of these terms with their tf.  N, L and df come from
   the bags.  If the vocabulary has more than ``MAX_TERMS`` terms, the bags keep
   all terms, which changes no score.
2. Documents whose hashed bag and m are equal are grouped, and the grouping
   compares the bags themselves: a class.  Copies, also such that differ only
   in other words, are scored once.
3. Classes and items meet in buckets of a bounded number of terms; a task
   multiplies its classes' weighted terms with its items and keeps the best
   ``k`` classes of each item, by score and smallest id.  A class that isn't among
   the ``k`` best has ``k`` classes before it, each with a document that comes
   before all of its own, so nothing is lost.
4. The ``k`` best classes of an item expand to their members by ascending id, at
   most ``k`` of them, and the item's ``k`` best documents are ranked.

Edge cases: a null or empty text has no terms, counts in nothing and is never
found; an item without terms has no rows; a null id comes before all others
among equal scores; each row of items is an item of its own, also where ids
repeat or are null; rows that repeat an id are documents of their own; equal
scores are ranked by ascending id; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .stage import Scratch, small_batches

K_BEST, MAX_TERMS = 10, 4_000_000
#: Terms of the classes, and of the items, that a task scores at a time.
BUCKET_TERMS, BLOCK_TERMS = 1_000_000, 200_000
#: Cells (8 bytes) of the matrices that a task multiplies at a time.
CELLS = 4_000_000
#: Sums of whole numbers below this are exact in doubles.
EXACT = 2**53
#: More classes than this aren't broadcast, nor are more of their terms.
BROADCAST_TERMS = 2_000_000
#: Where a null id stands among the others.
NO_ID = -(2**63)


def _words(docs: K.Docs) -> K.Words:
    return K.Words(docs, lower=True, separators=K.PUNCTUATION)


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(id, n, terms, tfs) of documents (id, text) that have terms; terms ascend."""
    kept = None if vocabulary is None else vocabulary.value
    for batch in batches:
        for docs in K.slices(batch.column(1)):
            words = _words(docs)
            n = words.counts()
            hashes, doc = words.hashes.view(np.int64), words.doc
            if kept is not None:
                at = np.searchsorted(kept, hashes)
                known = np.flatnonzero(kept[np.minimum(at, len(kept) - 1)] == hashes) if len(kept) else np.zeros(0, np.int64)
                hashes, doc = hashes[known], doc[known]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
            tfs = np.diff(np.append(first, len(doc)))
            offsets = np.searchsorted(doc[first], np.arange(docs.n + 1))
            bags = [K.lists(pa.array(hashes[first]), offsets), K.lists(pa.array(tfs.astype(np.int32)), offsets)]
            some = pa.array(np.flatnonzero(n))
            columns = [batch.column(0).slice(docs.first, docs.n), pa.array(n.astype(np.int64)), *bags]
            yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], ["id", "n", "terms", "tfs"])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as (values, offsets)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def _score(classes: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The k best classes of each item; classes (bucket, block, class, m, least, terms, tfs), items (..., item, terms, weights)."""
    names = ["item", "class", "score"]
    terms, starts = _flat(items.column("terms"))
    weights, _ = _flat(items.column("weights"))
    vocabulary, column = np.unique(terms, return_inverse=True)
    weight = np.zeros(len(vocabulary), np.int64)
    weight[column] = weights
    n_items = items.num_rows
    most = int(np.diff(starts).max(initial=0)) * int(weight.max(initial=0)) * 1_000_000
    kind = np.float64 if most < EXACT else np.int64
    asked = np.zeros((len(vocabulary), n_items), kind)
    asked[column, np.repeat(np.arange(n_items), np.diff(starts))] = 1
    held, at = _flat(classes.column("terms"))
    tfs = _flat(classes.column("tfs"))[0].astype(np.int64)
    m = classes.column("m").to_numpy()
    least = classes.column("least").to_numpy()
    where = np.minimum(np.searchsorted(vocabulary, held), max(0, len(vocabulary) - 1))
    known = vocabulary[where] == held if len(vocabulary) else np.zeros(len(held), bool)
    row = np.repeat(np.arange(classes.num_rows), np.diff(at))
    impact = weight[where] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row])) if len(vocabulary) else tfs
    found: list[list[np.ndarray]] = [[], [], []]
    step = max(1, CELLS // max(1, len(vocabulary) + n_items))
    for lo in range(0, classes.num_rows, step):
        hi = min(lo + step, classes.num_rows)
        inside = slice(at[lo], at[hi])
        dense = np.zeros((hi - lo, len(vocabulary)), kind)
        good = known[inside]
        dense[row[inside][good] - lo, where[inside][good]] = impact[inside][good]
        scores = (dense @ asked).astype(np.int64)
        for i in range(n_items):
            some = np.flatnonzero(scores[:, i])
            if len(some) > k:  # all that the k-th best score leaves in
                bar = np.partition(scores[some, i], len(some) - k)[len(some) - k]
                some = some[scores[some, i] >= bar]
            best = some[np.lexsort((least[lo:hi][some], -scores[some, i]))[:k]]
            found[0].append(np.full(len(best), i))
            found[1].append(best + lo)
            found[2].append(scores[best, i])
    item, chosen, score = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)
    order = np.lexsort((least[chosen], -score, item))
    item, chosen, score = item[order], chosen[order], score[order]
    first = np.searchsorted(item, item)
    top = np.arange(len(item)) - first < k
    return pa.table([items.column("item").take(pa.array(item[top])), classes.column("class").take(pa.array(chosen[top])), pa.array(score[top])], names=names)


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _best(key, classes: pa.Table, items: pa.Table, k: int) -> pa.Table:
    return _score(classes, items, k)


def search(docs: DataFrame, items: DataFrame, k: int = K_BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_terms: int = MAX_TERMS, bucket_terms: int = BUCKET_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item id, rank, id, score) of the k best documents of each row of items."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ranked-search")
    asked = scratch.keep(items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    read = asked.select("item", "text").mapInArrow(partial(_bags, vocabulary=None), "item long, n long, terms array<long>, tfs array<int>")
    item_terms = scratch.keep(read.select("item", F.explode("terms").alias("term")))
    vocabulary = item_terms.select("term").distinct()
    known = None
    if vocabulary.limit(max_terms + 1).count() <= max_terms:  # 8 bytes a term
        hashes = vocabulary.toArrow().column("term").to_numpy()
        known = spark.sparkContext.broadcast(np.sort(hashes))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bags = scratch.keep(source.mapInArrow(partial(_bags, vocabulary=known), "id long, n long, terms array<long>, tfs array<int>"))
    total = bags.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms"), F.sum(F.size("terms").cast("long")).alias("held")).first()
    n_docs, n_terms = total["n_docs"], max(1, total["n_terms"] or 0)

    df = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = item_terms.join(df.select("term", weight.alias("weight")), "term").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    n_blocks = max(1, -(-item_terms.count() // block_terms))
    weighted = weighted.select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block"))

    m = F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {n_terms}L")
    bags = bags.filter(F.size("terms") > 0).select("id", m.alias("m"), "terms", "tfs").withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    bag = ["hash", "m", "terms", "tfs"]
    # equal hashes meet, equal bags become one; the smallest id counts where scores are equal
    classes = bags.groupBy(*bag).agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least"))
    classes = scratch.keep(classes.withColumn("class", F.monotonically_increasing_id()))
    n_buckets = max(1, -(-(total["held"] or 0) // bucket_terms))
    left = classes.select(F.pmod("hash", F.lit(n_buckets)).alias("bucket"), F.explode(_up_to(n_blocks)).alias("block"), "class", "m", "least", "terms", "tfs")
    right = weighted.withColumn("bucket", F.explode(_up_to(n_buckets)))
    near = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(partial(_best, k=k), "item long, class long, score long")

    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "least")
    near = near.join(classes.select("class", "least"), "class")
    near = scratch.keep(near.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k).select("item", "class", "score"))
    hit = scratch.keep(classes.join(near.select("class").distinct(), "class", "left_semi").select("class", *bag))
    size = hit.agg(F.sum(F.size("terms").cast("long")).alias("n")).first()["n"] or 0
    members = bags.join(F.broadcast(hit) if size <= BROADCAST_TERMS else hit, bag).select("class", "id")
    by_id = Window.partitionBy("class").orderBy(F.col("id").asc_nulls_first())
    members = members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k).select("class", "id")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    ranked = near.join(members, "class").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = asked.select("item", F.col("id").alias("item_id")).join(ranked, "item")
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col if id_col != item_col else "found_id"), "score")
