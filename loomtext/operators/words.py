"""Words of a row counted in its row: Arrow maps over a column words ARRAY<STRING>, which need no shuffle.

What is asked of a word (its length, its marks, its syllables) is worked out once
for each different word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomtext.functions import features as X
from loomtext.functions import text as T
from loomtext.plans.shared import Scratch, bounded, small_batches

#: Marks that may stand around a word, without and with braces.
MARKS = """.,!?;:"'()[]"""
BRACED = MARKS + "{}"


def coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, code of each word, the different words)."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    return np.repeat(np.arange(len(words)), sizes), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary


def _trimmed(words: pa.Array, marks: str) -> tuple[np.ndarray, pa.Array]:
    """(code of each word without marks at its edges, the different ones)."""
    d = pc.utf8_trim(words, characters=marks).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _different(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of a row's different words; codes are below n."""
    both = np.sort(row * max(n, 1) + code)  # np.unique would hash, which is slower
    both = both[np.diff(both, prepend=-1) > 0]
    return both // max(n, 1), both % max(n, 1)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, code, words = coded(batch.column("words"))
        n = batch.num_rows
        count = lambda at: np.bincount(at, minlength=n)
        groups = pc.count_substring_regex(words, "[aeiouy]+").to_numpy(zero_copy_only=False).astype(np.int64)
        syllables = np.maximum(groups - (_flags(pc.ends_with(words, "e")) & (groups > 1)), 1)
        to, bare = _trimmed(words, BRACED)
        sized = _flags(pc.greater(pc.binary_length(bare), 2))
        key = ~_flags(pc.is_in(bare, pa.array(T.STOP_WORDS[:20]))) & sized
        each = to[code]
        long = sized[each]
        d_row, d_code = _different(row[long], each[long], len(bare))
        is_key = key[d_code]
        hashes = pd.util.hash_array(bare.to_numpy(zero_copy_only=False)).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count(d_row[is_key]))).astype(np.int32)), pa.array(hashes[d_code[is_key]], pa.int64()))
        to, bare = _trimmed(words, MARKS)
        telling = _flags(pc.greater(pc.binary_length(bare), 3)) & ~_flags(pc.is_in(bare, pa.array(X.DULL)))
        each = to[code]
        t = telling[each]
        t_row, _ = _different(row[t], each[t], len(bare))
        sums = np.bincount(row, syllables[code], n) if len(row) else np.zeros(n)
        made = [count(row), sums, count(row[long]), count(d_row), count(row[t]), count(t_row)]
        kept = [batch.column(c) for c in batch.schema.names if c != "words"]
        names = [c for c in batch.schema.names if c != "words"]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x.astype(np.int64)) for x in made], keys], [*names, *FIGURES, "keys"])


#: Of a row's lower-cased words: how many; their syllables; those of more than two bytes, and the different ones; the telling ones, and the different ones.
FIGURES = ("n_words", "syllables", "n_long", "n_long_different", "n_telling", "n_telling_different")


def word_figures(rows: DataFrame) -> DataFrame:
    """rows with FIGURES and keys (hashes of the different keywords, as chunk.keywords_of takes them) in place of words, the lower-cased words."""
    small_batches(rows.sparkSession)
    kept = [f for f in rows.schema if f.name != "words"]
    made = [S.StructField(c, S.LongType()) for c in FIGURES]
    return rows.mapInArrow(_figures, S.StructType([*kept, *made, S.StructField("keys", S.ArrayType(S.LongType()))]))


def _top(batches: Iterator[pa.RecordBatch], k: int, min_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, code, words = coded(batch.column("words"))
        n = batch.num_rows
        to, bare = _trimmed(words, MARKS)
        place = np.empty(len(bare), np.int64)
        place[pc.sort_indices(bare).to_numpy(zero_copy_only=False)] = np.arange(len(bare))
        named = lambda found: np.bincount(row, _flags(pc.is_in(bare, pa.array(found)))[to][code], n) if len(row) else np.zeros(n)
        lexicon = [named(found).astype(np.int64) for found in (T.POSITIVE, T.NEGATIVE)]
        # a word's bytes count with its marks
        good = (_flags(pc.greater(pc.binary_length(words), min_bytes)) & _flags(pc.greater(pc.binary_length(bare), 0))[to])[code]
        both = np.sort(row[good] * max(len(bare), 1) + to[code][good])
        at = np.flatnonzero(np.diff(both, prepend=-1) > 0)
        times = np.diff(np.append(at, len(both)))
        r, c = both[at] // max(len(bare), 1), both[at] % max(len(bare), 1)
        order = np.lexsort((place[c], -times, r))
        r, c = r[order], c[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        offsets = np.append(0, np.cumsum(np.bincount(r[best], minlength=n)))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), bare.take(pa.array(c[best])))
        names = [x for x in batch.schema.names if x != "words"]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], lists, *[pa.array(x) for x in lexicon]], [*names, "keywords", "positive", "negative"])


def top_words(rows: DataFrame, k: int, min_bytes: int) -> DataFrame:
    """rows with keywords, positive and negative in place of words, the lower-cased words.

    keywords: a row's k most frequent words of more than min_bytes bytes, then
    rid of the marks at their edges; ties by word.  The others count its words
    of the sentiment lexicon.
    """
    small_batches(rows.sparkSession)
    kept = [f for f in rows.schema if f.name != "words"]
    made = [S.StructField("keywords", S.ArrayType(S.StringType())), S.StructField("positive", S.LongType()), S.StructField("negative", S.LongType())]
    return rows.mapInArrow(partial(_top, k=k, min_bytes=min_bytes), S.StructType([*kept, *made]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, code, words = coded(batch.column("words"))
        n = max(len(words), 1)
        both = np.sort(row * n + code)
        at = np.flatnonzero(np.diff(both, prepend=-1) > 0)
        tf = np.diff(np.append(at, len(both)))
        row, code = both[at] // n, both[at] % n
        total = pc.fill_null(pc.list_value_length(batch.column("words")), 0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), total, words.take(pa.array(code)), pa.array(tf.astype(np.int32))], ["id", "total", "word", "tf"])


def word_counts(rows: DataFrame) -> DataFrame:
    """(id, total, word, tf) of rows (id, words ARRAY): how often a row holds a word, and its words in all; rows of one id stay apart."""
    small_batches(rows.sparkSession)
    schema = S.StructType([rows.schema["id"], S.StructField("total", S.IntegerType()), S.StructField("word", rows.schema["words"].dataType.elementType), S.StructField("tf", S.IntegerType())])
    return rows.select("id", "words").mapInArrow(_counts, schema)


def repeated_ids(df: DataFrame) -> DataFrame | None:
    """(found): the ids of more than one row, or None if there are none."""
    found = Scratch(df.sparkSession, "repeated").keep(df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("found")))
    return None if found.isEmpty() else bounded(found)


def of_ids(df: DataFrame, found: DataFrame, inside: bool) -> DataFrame:
    return df.join(found, F.col("id").eqNullSafe(F.col("found")), "left_semi" if inside else "left_anti")
