"""Secret scans: candidate strings, then a random forest that drops false positives.

1. A map over the documents takes every run of at least ``MIN_LENGTH``
   characters ``[A-Za-z0-9+/_=-]`` with a digit in it, or with at least two
   changes between small and capital letters, with the words beside it.
2. Two statistics of all documents: how often one character class follows
   another (a fixed 63 x 63 table, summed map-side), and the words of at least
   four characters that occur in ``MIN_DOCS`` documents or more (the
   dictionary; a grouped count by word hash).
3. Features: length, shares of digits, capitals and hex digits, entropy, class
   changes, mean log-probability of the character transitions, the share that
   dictionary words cover, and hashed neighbouring words and path (the
   document's source).
4. A random forest is trained on labelled findings and scores every candidate.
   Findings may be given as (id, start, label) rows; by default rules label
   the plain cases: a credential word with an assignment before the string is
   1, plain numbers, parts of addresses and mostly dictionary words are 0; a
   string of dictionary words behind a credential word stays without a label.
   What the first rule looks at - credential words and the assignment - is no
   feature, so the forest learns what such strings look like, finds ones that
   no such word announces, and drops announced ones that look like none.
   Training takes at most about ``TRAIN_ROWS`` labelled findings: all of a kind
   up to half of that (more if the other kind has fewer), beyond it drawn by
   hash.  Both kinds weigh the same in the forest, so rare secrets aren't
   outvoted; everything else is computed on all rows.

Edge cases: null or empty text has no candidates; null ids and sources are
carried as they are; rows that repeat an id give their findings again; with
labels of fewer than two kinds no forest is trained and the score is the label
(0 where there is none); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .stage import Scratch, small_batches

MIN_LENGTH, MIN_DOCS, WORD_BYTES = 12, 5, 4
TRAIN_ROWS, TREES, DEPTH, HASHED = 20_000, 20, 5, 64
LEFT, RIGHT = 48, 24  # bytes of context

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "+/_=-"]] = True
_RUN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_CASE = np.zeros(256, np.int8)
_CASE[0x61:0x7B], _CASE[0x41:0x5B] = 1, 2
_CLASS = np.full(256, 62, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = np.arange(26), np.arange(26, 52), np.arange(52, 62)
_CREDENTIAL = re.compile(r"(?i)(token|secret|passw\w*|pwd|api[_-]?key|private[_-]?key|access[_-]?key|credential)s?[\"']?\s*[:=]\s*[\"']?$")
#: Neighbouring words that the labelling rule looks at; they are no feature.
_ANNOUNCING = "^(tokens?|secrets?|passw.*|pwds?|api|key|keys|private|access|credentials?)$"
_WORD = re.compile(r"[^\W\d_]+")

FOUND = "id {kind}, path string, start long, length long, sha256 string, before string, after string, label int, digits double, capitals double, hex double, entropy double, changes double, codes array<int>, pieces array<long>, piece_sizes array<int>"
NUMBERS = ["length", "digits", "capitals", "hex", "entropy", "changes", "transition", "covered"]


def _entropy(s: str) -> float:
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def _hashes(words: list[str]) -> np.ndarray:
    found = [w.hashes for w in K.words(pa.array([" ".join(words)]), lower=True)] if words else []
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def describe(candidate: str, left: str, right: str) -> dict:
    """What one candidate and its surroundings show."""
    pieces = [p for p in re.findall("[A-Za-z]+", candidate) if len(p) >= WORD_BYTES]
    codes = _CLASS[np.frombuffer(candidate.encode(), np.uint8)]
    kinds = np.digitize(codes, [26, 52, 62])
    credential = bool(_CREDENTIAL.search(left))
    numeric = candidate.isdigit()
    in_address = left.endswith(("@", ".", "://")) or right.startswith(("@", "."))
    n = len(candidate)
    return {
        "length": n,
        "sha256": hashlib.sha256(candidate.encode()).hexdigest(),
        "before": ([""] + _WORD.findall(left.lower()))[-1],
        "after": (_WORD.findall(right.lower()) + [""])[0],
        "label": 1 if credential and not numeric else 0 if numeric or in_address else None,
        "digits": sum(c.isdigit() for c in candidate) / n,
        "capitals": sum(c.isupper() for c in candidate) / n,
        "hex": sum(c in "0123456789abcdefABCDEF" for c in candidate) / n,
        "entropy": _entropy(candidate),
        "changes": float((kinds[1:] != kinds[:-1]).mean()),
        "codes": codes.tolist(),
        "pieces": _hashes(pieces).view(np.int64).tolist(),
        "piece_sizes": [len(p) for p in pieces],
    }


def _candidates(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for docs in K.slices(batch.column(2)):
            data = docs.data
            run = _RUN[data]
            head = run.copy()
            head[1:] &= ~run[:-1]
            cuts = docs.offsets[:-1][docs.offsets[:-1] < len(data)]
            head[cuts] |= run[cuts]
            tail = np.zeros(len(data), bool)
            tail[:-1] = run[:-1] & (~run[1:] | head[1:])
            if len(data):
                tail[-1] = run[-1]
            starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            case = _CASE[data]
            turns = np.concatenate([[0, 0], np.cumsum((case[1:] != case[:-1]) & (case[1:] > 0) & (case[:-1] > 0))]) if len(data) else np.zeros(1, np.int64)
            good = (ends - starts >= MIN_LENGTH) & ((digits[ends] > digits[starts]) | (turns[ends] - turns[np.minimum(starts + 1, len(data))] >= 2))
            points = np.concatenate([[0], np.cumsum(K.code_points(data))])
            raw = data.tobytes()
            for a, b in zip(starts[good].tolist(), ends[good].tolist()):
                doc = int(np.searchsorted(docs.offsets, a, "right")) - 1
                lo, hi = docs.offsets[doc], docs.offsets[doc + 1]
                left, right = raw[max(lo, a - LEFT) : a].decode("utf-8", "ignore"), raw[b : min(hi, b + RIGHT)].decode("utf-8", "ignore")
                k = docs.first + doc
                rows.append({"id": batch.column(0)[k].as_py(), "path": batch.column(1)[k].as_py(), "start": int(points[a] - points[lo])} | describe(raw[a:b].decode(), left, right))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(63 * 63, np.int64)
    for batch in batches:
        for docs in K.slices(batch.column(0)):
            codes = _CLASS[docs.data]
            inside = np.ones(len(codes), bool)
            inside[docs.offsets[:-1][docs.offsets[:-1] < len(codes)]] = False  # a document's first character follows nothing
            at = np.flatnonzero(inside)
            counts += np.bincount(codes[at - 1] * 63 + codes[at], minlength=63 * 63)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pair", "n"])


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for docs in K.slices(batch.column(0)):
            words = K.Words(docs, lower=True, separators=K.PUNCTUATION)
            long = words.ends - words.starts >= WORD_BYTES
            order = np.lexsort((words.doc[long], words.hashes[long]))
            h, d = words.hashes[long][order], words.doc[long][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            parts.append(h[new])
        if parts:
            hashes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([K.long_array(hashes), pa.array(n)], ["word", "n"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate with its features; one row for each place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "secret-scan")
    text = docs.select(F.col(text_col).alias("text"))
    schema = FOUND.format(kind=docs.schema[id_col].dataType.simpleString())
    found = docs.select(id_col, F.col(path_col).cast("string"), text_col).mapInArrow(partial(_candidates, schema=to_arrow_schema(spark.createDataFrame([], schema).schema)), schema)
    found = scratch.keep(found.withColumn("n", F.monotonically_increasing_id()))

    pairs = text.mapInArrow(_transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = np.ones((63, 63))
    for row in pairs.collect():  # at most 63 * 63 rows
        table[row["pair"] // 63, row["pair"] % 63] += row["n"]
    log_p = np.log2(table / table.sum(axis=1, keepdims=True)).ravel()

    @F.pandas_udf("double")
    def transition(codes):
        sizes, flat = codes.str.len().to_numpy(), np.concatenate(codes.to_numpy())
        ends = np.cumsum(sizes)
        steps = np.append(log_p[flat[:-1].astype(np.int64) * 63 + flat[1:]], 0.0)
        steps[ends - 1] = 0.0  # from one string to the next
        return pd.Series(np.add.reduceat(steps, ends - sizes) / (sizes - 1))

    words = text.mapInArrow(_dictionary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS).select("word")
    pieces = found.select("n", F.explode(F.arrays_zip("pieces", "piece_sizes")).alias("p")).select("n", F.col("p.pieces").alias("word"), F.col("p.piece_sizes").alias("size"))
    covered = pieces.join(words, "word").groupBy("n").agg(F.sum("size").alias("covered"))
    out = found.join(covered, "n", "left").withColumn("covered", F.coalesce("covered", F.lit(0)) / F.col("length")).withColumn("transition", transition("codes"))
    out = out.withColumn("label", F.when((F.col("covered") >= 0.5) & F.col("label").isNull(), 0).when((F.col("covered") >= 0.5) & (F.col("label") == 1), None).otherwise(F.col("label")))
    return scratch.keep(out.drop("codes", "pieces", "piece_sizes", "n"))


def vectors(found: DataFrame) -> DataFrame:
    """Adds the feature vector of the forest."""
    named = found.withColumns({"before_word": F.when(F.col("before").rlike(_ANNOUNCING), "").otherwise(F.coalesce("before", F.lit(""))), "after_word": F.coalesce("after", F.lit("")), "path_name": F.coalesce("path", F.lit(""))})
    hashed = FeatureHasher(inputCols=["before_word", "after_word", "path_name"], outputCol="words", numFeatures=HASHED).transform(named)
    return VectorAssembler(inputCols=[*NUMBERS, "words"], outputCol="features").transform(hashed).drop("before_word", "after_word", "path_name", "words")


def draw_training(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about so many labelled rows: all of a kind up to half of them or what the other kind leaves free."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    total, drawn = sum(counts.values()), F.lit(False)
    for label, n in counts.items():
        room = max(train_rows // 2, train_rows - (total - n))
        fits = F.lit(True) if n <= room else F.pmod(F.xxhash64("sha256", "start", "id"), F.lit(1 << 40)) < int(room / n * (1 << 40))
        drawn = drawn | ((F.col("label") == label) & fits)
    return labelled.filter(drawn)


def train_forest(found: DataFrame, train_rows: int = TRAIN_ROWS):
    """A forest from the labelled rows of vectors(), or None if those drawn are all of one kind."""
    drawn = draw_training(found.filter("label is not null"), train_rows)
    counts = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    weight = F.lit(None).cast("double")
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, sum(counts.values()) / len(counts) / n).otherwise(weight)
    rows = drawn.select("features", weight.alias("weight"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", weightCol="weight").fit(rows)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per candidate: id, start (code points), length, sha256, label, score, is_secret."""
    found = candidates(docs, id_col, text_col, path_col)
    if labels is not None:
        given = labels.select(F.col(id_col).alias("id"), "start", F.col("label").alias("given")).dropDuplicates(["id", "start"])
        found = found.join(given, ["id", "start"], "left").withColumn("label", F.coalesce("given", "label")).drop("given")
    found = vectors(found)
    forest = train_forest(found, train_rows)
    if forest is None:
        scored = found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    else:
        scored = forest.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "start", "length", "sha256", "label", "score", (F.col("score") >= 0.5).alias("is_secret"))
