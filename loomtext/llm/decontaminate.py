"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased, so punctuation and line
breaks don't matter; in Han, Kana and Thai, which are written without spaces,
each character is a word.

1. Items are taken in blocks of at most ``BLOCK_GRAMS`` n-grams, so what is
   broadcast has a proven bound; a usual test set is one block.
2. A first map over the documents counts in how many of them each of the
   block's n-grams occurs (summed per batch, then by Spark).
3. Of each ``spread`` n-grams in a row in an item, the rarest is a seed.  Every
   stretch of n + spread - 1 unchanged words therefore holds a seed, even if
   the whole stretch is common.
4. A second map finds the seeds in the documents; each hit names an item and a
   region; local alignment (match +2, mismatch -1, gap -1, over words) scores
   the region.  score = alignment score / that of the item with itself.

A pair of document and item counts at score >= ``threshold``.  Texts are never
shuffled.

Edge cases: null or empty texts hold nothing; an item of fewer than n words
matches nothing (it tells no leak from everyday words); null ids of documents
and items are carried as null; each row of docs and of items is looked at by
itself, also where ids repeat, so such rows give one result row each; of several
places of an item in a document the best counts, the first of equals; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .stage import small_batches

GRAM, SPREAD, THRESHOLD = 3, 3, 0.4
BLOCK_GRAMS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_FILTER_BITS = 20
#: Cells of the alignment matrices that are worked on at once.
CELLS = 1 << 19


def _words(docs: K.Docs) -> K.Words:
    return K.Words(docs, lower=True, separators=K.PUNCTUATION, characters=True)


class Lookup:
    """Places of hashes in a sorted table of distinct ones, most misses settled by a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(hashes >> K.U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are in the table, their places in it)."""
        which = np.flatnonzero(self.bits[(hashes >> K.U64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[which])
        hit = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes[which]) if len(self.hashes) else np.zeros(len(which), bool)
        return which[hit], at[hit]


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """The local alignment score of each item with its region, many pairs at a time."""
    scores = np.zeros(len(items), np.int32)
    order = np.lexsort(([len(r) for r in regions], [len(x) for x in items]))
    at = 0
    while at < len(order):
        width = longest = to = 0
        while at + to < len(order):
            k = order[at + to]
            wider = max(width, len(regions[k]))
            if to and (to + 1) * wider > CELLS:
                break
            width, longest, to = wider, max(longest, len(items[k])), to + 1
        part = order[at : at + to]
        at += to
        # padding differs between the two sides, so it never matches
        left, right = np.full((to, longest), 1, np.uint64), np.full((to, width), 2, np.uint64)
        for i, k in enumerate(part):
            left[i, : len(items[k])], right[i, : len(regions[k])] = items[k], regions[k]
        above, slope, best = np.zeros((to, width + 1), np.int32), np.arange(width + 1, dtype=np.int32), np.zeros(to, np.int32)
        for i in range(longest):
            row = np.zeros_like(above)
            step = np.where(right == left[:, i : i + 1], MATCH, MISMATCH)
            np.maximum(above[:, :-1] + step, above[:, 1:] + GAP, out=row[:, 1:])
            np.maximum(row, 0, out=row)
            above = np.maximum.accumulate(row - GAP * slope, axis=1) + GAP * slope
            np.maximum(best, above.max(axis=1), out=best)
        scores[part] = best
    return scores


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in K.slices(batch.column(1)):
            words = _words(docs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(docs.first, docs.n), K.lists(K.long_array(words.hashes), words.per_doc)], ["item_id", "words"])


def _frequencies(batches: Iterator[pa.RecordBatch], grams) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(grams.value)
    counts = np.zeros(len(lookup.hashes), np.int64)
    for batch in batches:
        for docs in K.slices(batch.column(0)):
            words = _words(docs)
            at, hashes = words.grams(GRAM)
            which, gram = lookup.find(hashes)
            pairs = np.unique(words.doc[at[which]] * len(counts) + gram)
            counts += np.bincount(pairs % len(counts), minlength=len(counts)) if len(pairs) else 0
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])


def _score(batches: Iterator[pa.RecordBatch], block, threshold: float) -> Iterator[pa.RecordBatch]:
    seeds, first, item_of, place_of, ids, items = block.value
    lookup = Lookup(seeds)
    sizes = np.array([len(x) for x in items], np.int64)
    for batch in batches:
        found = []
        for docs in K.slices(batch.column(1)):
            words = _words(docs)
            at, hashes = words.grams(GRAM)
            which, seed = lookup.find(hashes)
            many = first[seed + 1] - first[seed]
            entry = np.repeat(first[seed] - np.cumsum(many) + many, many) + np.arange(many.sum())
            item, begin = item_of[entry], np.repeat(at[which], many) - place_of[entry]
            doc = np.repeat(words.doc[at[which]], many)
            # neighbouring diagonals share a region
            pad = np.maximum(4, sizes[item] // 4)
            region = pd.DataFrame({"doc": doc, "item": item, "band": (begin - words.per_doc[doc]) // pad, "begin": begin, "pad": pad})
            region = region.groupby(["doc", "item", "band"], as_index=False, sort=False).agg(begin=("begin", "min"), pad=("pad", "first"))
            if not len(region):
                continue
            doc, item = region["doc"].to_numpy(), region["item"].to_numpy()
            lo = np.maximum(words.per_doc[doc], region["begin"].to_numpy() - region["pad"].to_numpy())
            hi = np.minimum(words.per_doc[doc + 1], region["begin"].to_numpy() + sizes[item] + 2 * region["pad"].to_numpy())
            region["score"] = align([items[k] for k in item], [words.hashes[a:b] for a, b in zip(lo, hi)]) / (MATCH * sizes[item])
            region["word"] = lo - words.per_doc[doc]
            best = region.sort_values(["doc", "item", "score", "word"], ascending=[True, True, False, True]).drop_duplicates(["doc", "item"])
            found.append(best[best["score"] >= threshold].assign(doc=lambda x: x["doc"] + docs.first))  # noqa: B023
        if found:
            rows = pd.concat(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows["doc"])), pa.array([ids[k] for k in rows["item"]], pa.int64()), pa.array(rows["score"].to_numpy(float)), pa.array(rows["word"].to_numpy(np.int64))], ["doc_id", "item_id", "score", "near_word"])


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items' ids and word hashes, in blocks of at most BLOCK_GRAMS words (or one longer item)."""
    ids, words, held = [], [], 0
    for row in items.toLocalIterator():
        if held and held + len(row["words"]) > BLOCK_GRAMS:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row["item_id"])
        words.append(np.array(row["words"], np.int64).view(np.uint64))
        held += len(row["words"])
    if ids:
        yield ids, words


def _grams(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, place) of every n-gram of the items."""
    flat = np.concatenate(items)
    sizes = np.array([len(x) for x in items])
    starts = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(items)), np.maximum(0, sizes - GRAM + 1))
    place = np.arange(len(item)) - np.repeat(np.cumsum(np.maximum(0, sizes - GRAM + 1)) - np.maximum(0, sizes - GRAM + 1), np.maximum(0, sizes - GRAM + 1))
    at = starts[item] + place
    return K.spans_hash(flat, at, at + GRAM), item, place


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, spread: int = SPREAD) -> DataFrame:
    """(id, item id, score, near_word) of every document that holds a test item or an edited copy of one."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(_item_words, "item_id long, words array<long>").filter(F.size("words") >= GRAM)
    schema = "doc_id long, item_id long, score double, near_word long"
    out = None
    for ids, held in _blocks(words):
        hashes, item, place = _grams(held)
        grams, code = np.unique(hashes, return_inverse=True)
        counted = source.select("text").mapInArrow(partial(_frequencies, grams=spark.sparkContext.broadcast(grams)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(grams), np.int64)
        found = counted.toArrow()  # at most one row (16 bytes) for each n-gram of the block
        frequency[found.column("gram").to_numpy()] = found.column("n").to_numpy()
        table = pd.DataFrame({"item": item, "place": place, "code": code, "n": frequency[code], "hash": hashes})
        seed = np.zeros(len(table), bool)
        rank = np.empty(len(table), np.int64)
        rank[np.lexsort((table["hash"], table["n"]))] = np.arange(len(table))
        last = np.concatenate([item[1:] != item[:-1], [True]])
        if len(table) >= spread:
            rarest = np.argmin(np.lib.stride_tricks.sliding_window_view(rank, spread), axis=1)
            inside = np.flatnonzero(item[spread - 1 :] == item[: len(item) - spread + 1])
            seed[inside + rarest[inside]] = True
        few = np.bincount(item, minlength=len(held))[item] < spread
        seed |= few & last | few & (place == 0)
        entries = table[seed].sort_values(["code", "item", "place"])
        codes, first = np.unique(entries["code"], return_index=True)
        block = (grams[codes], np.append(first, len(entries)), entries["item"].to_numpy(), entries["place"].to_numpy(), ids, held)
        found = source.mapInArrow(partial(_score, block=spark.sparkContext.broadcast(block), threshold=threshold), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})
