"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks.

A window is ``window`` consecutive words of one document.  A word goes when a
window over it has the same words as a window that starts earlier (smaller id,
or same document and earlier start).

Documents are parsed into factors against every block of the corpus:

1. Blocks are content-defined.  Each window's anchor is its smallest 8-word
   gram (leftmost of equals); a block is a maximal run of windows that share
   one anchor.  Equal passages are cut into equal blocks wherever they stand,
   so a block of a document either occurs in the reference index as a whole
   or lies at the end of a copied passage.
2. The reference index holds, for each (anchor, block) hash, the first place
   it occurs.  The parse takes every block that has an earlier equal, and
   greedily goes on with the next block while it follows in the reference as
   well; such a factor is at least one window long, and all its windows are
   repeats (``factors`` lists them with their place in the reference).
   Matches thus grow by blocks, not by single words: the words at the ends are
   what step 3 looks at.
3. At factor boundaries - blocks that are the first of their kind while their
   anchor also occurs in other blocks - the windows are compared one by one,
   by their hash.  A window's equal has the same anchor, so no other window
   can have an earlier equal.

Blocks and windows are compared inside a task first, in runs of about
``RUN_BLOCKS``.  What goes to one key in a shuffle is at most one row a run
for a block, a window or an anchor: if an anchor has several blocks in a run
(a line that very many texts go around), these are dealt by block, and one
row tells the anchor's task that it has several.

One map forms the runs and writes both what they settle and what they leave to
the shuffle, so a run is never formed twice: another order of the rows in a
second scan (input behind a shuffle, a stage done again) would form other runs.

The result is exact up to collisions of 64-bit hashes.  Texts are shuffled
once, by id, and read from that one exchange by both joins.

Edge cases: null or empty text has no words (its digest is that of the empty
string); rows with a null id come before all others and keep a null id; each
row is a document of its own: rows that repeat an id, or have none, aren't
earlier than one another, so they don't remove each other's words, only
their own repeats and those of smaller ids (rows with equal ids are told apart
by a 64-bit hash of their text, so equal rows get equal results); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .stage import Scratch, small_batches

WINDOW, ANCHOR = 20, 8
#: Blocks, and windows at boundaries, are compared within runs of this many before they are shuffled.
RUN_BLOCKS = 1 << 20
_NO_ID = np.iinfo(np.int64).min
_PLACES = "id long, tie long, start int, n int"
_PARSED = f"{_PLACES}, key long, block long, settled boolean, ref_id long, ref_start int"


def blocks(words: K.Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window's start in the document, number of windows, anchor hash, block hash)."""
    at, _ = words.grams(window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width = window - anchor + 1
    gram_at, gram = words.grams(anchor)
    by_word = np.full(len(words) + width, 2**64 - 1, np.uint64)
    by_word[gram_at] = gram
    smallest = at + np.argmin(np.lib.stride_tricks.sliding_window_view(by_word, width)[at], axis=1)
    new = np.ones(len(at), bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    doc = words.doc[at[first]]
    return doc, at[first] - words.per_doc[doc], last - first + 1, by_word[smallest[first]], K.spans_hash(words.hashes, at[first], at[last] + window)


class Run:
    """Things of one run that are alike (equal keys), ordered by id, document and start.

    later: has an earlier equal in the run; ref: the earliest of its equals.
    """

    def __init__(self, ids: np.ndarray, ties: np.ndarray, start: np.ndarray, *keys: np.ndarray):
        self.order = np.lexsort((start, ties, ids, *reversed(keys)))
        i, t, s = (x[self.order] for x in (ids, ties, start))
        self.new = np.ones(len(i), bool)  # in this order: the first of its keys
        if len(i):
            self.new[1:] = np.logical_or.reduce([k[self.order][1:] != k[self.order][:-1] for k in keys])
        own = self.new.copy()  # the first of its keys in its document
        own[1:] |= (i[1:] != i[:-1]) | (t[1:] != t[:-1])
        places = np.arange(len(i))
        lead, mine = (np.maximum.accumulate(np.where(x, places, 0)) for x in (self.new, own))
        smaller = i > i[lead]
        self.later, self.ref = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
        self.later[self.order] = smaller | (s != s[mine])
        self.ref[self.order] = self.order[np.where(smaller, lead, mine)]


def _runs(batches: Iterator[pa.RecordBatch], window: int, anchor: int, run_blocks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of many documents: id, tie, start, n, anchor, block; and the run they make."""

    def run(parts: list) -> tuple:
        columns = [np.concatenate(x) for x in zip(*parts)]
        return *columns, Run(*columns[:3], *columns[4:])

    parts, held = [], 0
    for batch in batches:
        ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for docs in K.slices(batch.column(2)):
            doc, *rest = blocks(K.Words(docs, lower=False), window, anchor)
            parts.append((ids[docs.first + doc], ties[docs.first + doc], *rest))
            held += len(doc)
            if held >= run_blocks:
                yield run(parts)
                parts, held = [], 0
    if held:
        yield run(parts)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _heads(ids, ties, start, n, anchors, block, run: Run) -> pa.Table:
    """The first of each kind of block of a run, each under the key that it is compared by."""
    a, b = anchors[run.order], block[run.order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    group, at = np.cumsum(first) - 1, np.flatnonzero(first)
    several = (b[at] != b[np.append(at[1:], len(a)) - 1])[group]
    settled = np.zeros(len(a), bool)
    settled[run.order] = several
    k = ~run.later
    key = np.where(settled[k], K.mix(anchors[k] ^ K.mix(block[k])), anchors[k])
    witness = a[first & several]  # tells that an anchor has several blocks
    more = np.zeros(len(witness), np.int64)
    return pa.table(
        [
            *(pa.array(np.concatenate([x[k], more])) for x in (ids, ties)),
            *(_ints(np.concatenate([x[k], more])) for x in (start, n)),
            K.long_array(np.concatenate([key, witness])),
            K.long_array(np.concatenate([block[k], witness])),
            pa.array(np.concatenate([settled[k], more == 0])),
        ],
        ["id", "tie", "start", "n", "key", "block", "settled"],
    )


def _local_factors(ids, ties, start, n, run: Run) -> pa.Table:
    """Blocks with an earlier equal in their run, joined while the next one follows in the reference as well."""
    k = np.flatnonzero(run.later)
    k = k[np.lexsort((start[k], ties[k], ids[k]))]
    ref = run.ref[k]
    i, t, s, m, ri, rt, rs = ids[k], ties[k], start[k], n[k], ids[ref], ties[ref], start[ref]
    new = np.ones(len(k), bool)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + m[:-1])
    new[1:] |= (ri[1:] != ri[:-1]) | (rt[1:] != rt[:-1]) | (rs[1:] != rs[:-1] + m[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(m, first) if len(first) else m
    return pa.table([pa.array(i[first]), pa.array(t[first]), _ints(s[first]), _ints(sums), pa.array(ri[first]), _ints(rs[first])], ["id", "tie", "start", "n", "ref_id", "ref_start"])


def _parse_runs(batches: Iterator[pa.RecordBatch], window: int, anchor: int, run_blocks: int) -> Iterator[pa.RecordBatch]:
    """Of each run: the blocks to be compared with other runs' (ref_id null), and the factors found in it (key null)."""
    for ids, ties, start, n, anchors, block, run in _runs(batches, window, anchor, run_blocks):
        parts = [_heads(ids, ties, start, n, anchors, block, run), _local_factors(ids, ties, start, n, run)]
        yield from pa.concat_tables(parts, promote_options="default").to_batches(1 << 16)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists of (start, n): the lists' offsets, starts, ns; null is an empty list."""
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    flat = pc.list_flatten(column)
    return np.concatenate([[0], np.cumsum(sizes)]), flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def _boundary_windows(batches: Iterator[pa.RecordBatch], window: int, run_blocks: int) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks named beside each text: hash, id, tie, start, later.

    A window with an earlier equal in its run is settled (later); its hash is
    exchanged for a value of its own, so that no common window makes a hot key.
    """

    def run(parts: list) -> Iterator[pa.RecordBatch]:
        ids, ties, start, hashes = (np.concatenate(x) for x in zip(*parts))
        later = Run(ids, ties, start, hashes).later
        hashes[later] = K.mix(hashes[later] ^ K.mix(ids[later].view(np.uint64) ^ K.mix(ties[later].view(np.uint64) ^ K.mix(start[later].astype(np.uint64)))))
        table = pa.table([K.long_array(hashes), pa.array(ids), pa.array(ties), _ints(start), pa.array(later)], ["hash", "id", "tie", "start", "later"])
        yield from table.to_batches(1 << 16)

    parts, held = [], 0
    for batch in batches:
        offsets, start, n = _spans(batch.column(3))
        ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for docs in K.slices(batch.column(2)):
            words = K.Words(docs, lower=False)
            lo, hi = offsets[docs.first], offsets[docs.first + docs.n]
            doc = np.repeat(np.arange(docs.n), np.diff(offsets[docs.first : docs.first + docs.n + 1]))
            ns = n[lo:hi]
            place = np.repeat(start[lo:hi], ns) + np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
            doc = np.repeat(doc, ns)
            at = place + words.per_doc[doc]
            parts.append((ids[docs.first + doc], ties[docs.first + doc], place, K.spans_hash(words.hashes, at, at + window)))
            held += len(doc)
            if held >= run_blocks:
                yield from run(parts)
                parts, held = [], 0
    if held:
        yield from run(parts)


def _remove(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, start, n = _spans(batch.column(2))
        for docs in K.slices(batch.column(1)):
            words = K.Words(docs, lower=False, hashed=False)
            lo, hi = offsets[docs.first], offsets[docs.first + docs.n]
            doc = np.repeat(np.arange(docs.n), np.diff(offsets[docs.first : docs.first + docs.n + 1]))
            begin = words.per_doc[doc] + start[lo:hi]
            end = np.minimum(begin + n[lo:hi] - 1 + window, words.per_doc[doc + 1])
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.minimum(begin, end), 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=docs.n)
            raw, texts = docs.data.tobytes(), []
            for i in range(docs.n):
                a, b = words.per_doc[i], words.per_doc[i + 1]
                if removed[i]:
                    texts.append(b" ".join(raw[words.starts[k] : words.ends[k]] for k in a + np.flatnonzero(~gone[a:b])))
                else:
                    texts.append(b" ".join(raw[docs.offsets[i] : docs.offsets[i + 1]].split()))
            columns = {
                "id": batch.column(0).slice(docs.first, docs.n),
                "n_words": pa.array(words.counts().astype(np.int64)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
            }
            if with_text:
                columns["kept_text"] = pa.array([x.decode("utf-8") for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _parse(source: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """(factors, blocks at factor boundaries): places, the factors' with where they copy from."""
    small_batches(source.sparkSession)
    scratch = Scratch(source.sparkSession, "substring-dedup")
    parsed = scratch.keep(source.mapInArrow(partial(_parse_runs, window=window, anchor=anchor, run_blocks=RUN_BLOCKS), _PARSED))
    heads = parsed.filter("key is not null").select("id", "tie", "start", "n", "key", "block", "settled").repartition("key")
    equal = Window.partitionBy("key", "block").orderBy("id", "tie", "start")
    alike = Window.partitionBy("key")
    judged = heads.select("*", F.first(F.struct("id", "start")).over(equal).alias("ref"))
    judged = judged.select("*", (F.max("settled").over(alike) | (F.min("block").over(alike) != F.max("block").over(alike))).alias("several"))
    later = F.col("id") > F.col("ref.id")
    marks = judged.filter("n > 0").withColumn("later", later).filter("later or several")
    marks = marks.select("id", "tie", "start", "n", "later", F.col("ref.id").alias("ref_id"), F.col("ref.start").alias("ref_start"))
    local = parsed.filter("ref_id is not null").select("id", "tie", "start", "n", F.lit(True).alias("later"), "ref_id", "ref_start")
    found = scratch.keep(marks.unionByName(local))
    scratch.drop(parsed)
    return found.filter("later").drop("later"), found.filter("not later").select("id", "tie", "start", "n")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, start, words, ref_id, ref_start): every factor, and the place in the reference it copies; starts count words."""
    found, _ = _parse(_source(docs, id_col, text_col), window, anchor)
    named = lambda c: F.when(F.col(c) != F.lit(int(_NO_ID)), F.col(c))
    return found.select(named("id").alias(id_col), "start", (F.col("n") + window - 1).alias("words"), named("ref_id").alias("ref_id"), "ref_start")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (and kept_text if asked for)."""
    source = _source(docs, id_col, text_col)
    found, boundary = _parse(source, window, anchor)

    place = F.struct("start", "n")
    texts = source.repartition("id", "tie")
    boundary = boundary.groupBy("id", "tie").agg(F.collect_list(place).alias("blocks"))
    windows = texts.join(boundary.hint("shuffle_hash"), ["id", "tie"]).select("id", "tie", "text", "blocks").mapInArrow(partial(_boundary_windows, window=window, run_blocks=RUN_BLOCKS), "hash long, id long, tie long, start int, later boolean")
    repeats = windows.withColumn("id_0", F.min("id").over(Window.partitionBy("hash"))).filter("later or id > id_0").select("id", "tie", "start", F.lit(1).alias("n"))
    spans = found.select("id", "tie", "start", "n").unionByName(repeats).groupBy("id", "tie").agg(F.collect_list(place).alias("spans"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = texts.join(spans.hint("shuffle_hash"), ["id", "tie"], "left").select("id", "text", "spans").mapInArrow(partial(_remove, window=window, with_text=with_text), schema)
    return out.withColumn("id", F.when(F.col("id") != F.lit(int(_NO_ID)), F.col("id"))).withColumnRenamed("id", id_col)
