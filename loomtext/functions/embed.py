"""Vectors from a user's function, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EmbedFn = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embedder(embed_fn: EmbedFn, column: str = "vector", text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A function that adds a column of vectors to rows with a text.

    embed_fn takes an iterator of batches of texts and gives batches of arrays
    of floats, so a model is loaded once a task; it is run by Spark on every
    partition.  A null text is given as it is.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embed_fn(batches)

    return lambda df: df.withColumn(column, run(F.col(text_col)))


def letter_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A small embed_fn: how often a to p occur in the lower-cased text."""
    letters = "abcdefghijklmnop"
    for texts in batches:
        low = pa.array(texts.fillna("").str.lower(), pa.string())
        counts = [pc.count_substring(low, x).to_numpy(zero_copy_only=False) for x in letters]
        yield pd.Series(list(np.stack(counts, axis=1).astype("float32")), index=texts.index)
