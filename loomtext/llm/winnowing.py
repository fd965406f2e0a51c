"""Document fingerprints by winnowing.

A text is read as its characters (code points) without white space, A-Z
lower-cased.  Every ``gram`` of them in a row has a 64-bit rolling hash; of each
``window`` hashes in a row the smallest is chosen, the rightmost of equals.  The
chosen hashes, each with the place of its first character in the text as it is
(white space counts there), are the fingerprint.

Two texts that share ``gram + window - 1`` characters in a row (white space
left out) both choose the same hash at the same place of the shared piece, since
the choice in a window depends on nothing outside it; the places tell where it
is (``shared_places``).  A shorter text has one window, a text of fewer than
``gram`` characters one gram, an empty one none.

The likeness of two fingerprints is the share of distinct hashes that both hold
among those that either holds, 1 if both have none.

``follow`` pairs each document with the next one in the order of descending ids,
the last one with the first.  Ids and hashes of texts alone are sorted first,
which tells the first document of each range; texts are then dealt by range, in
one shuffle, and each range also gets the first document of the next one.  A
task reads its range in order, with two documents of it in hand.

Edge cases: a null text is an empty one; null ids come last in descending order;
rows that repeat an id stand in descending order of a hash of their text, and
rows that are equal in both follow each other, as any order of them gives the
same result, and share a range; a single row is followed by itself; an empty
table gives an empty result; texts of any length are worked on whole; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .stage import small_batches

GRAM, WINDOW = 12, 19
#: Hexadecimal digits of a hash in a printed fingerprint (40 bits).
DIGITS = 10
#: Where a null id stands among the others.
NO_ID = -(2**63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def choose(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of every window (of all, if there are fewer), each once, in order."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    best, width = np.arange(n), 1

    def smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[right] <= hashes[left], right, left)

    while 2 * width <= window:  # best[i]: of the hashes i to i + width - 1
        best = smaller(best[:-width], best[width:])
        width *= 2
    if window > width:
        best = smaller(best[: n - window + 1], best[window - width :])
    return best[np.append(True, best[1:] != best[:-1])]


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text, by ascending place."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    begins = K.code_points(data)
    solid = ~_SPACE[data]
    first = np.flatnonzero(begins & solid)  # of each character, in the bytes as they are
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places = np.flatnonzero(solid[begins]) if len(first) < len(data) else np.arange(len(first))
    kept = _LOWER[data[solid]]
    starts = np.flatnonzero(K.code_points(kept))
    ends = np.append(starts[1:], len(kept))
    gram = min(gram, len(starts))
    hashes = K.spans_hash(K._BYTE[kept], starts[: len(starts) - gram + 1], ends[gram - 1 :])
    at = choose(hashes, window)
    return hashes[at], places[at]


def printed(hashes: np.ndarray, places: np.ndarray) -> str:
    """hash:place of each chosen gram, comma-joined."""
    cut = (hashes >> np.uint64(64 - 4 * DIGITS)).tolist()
    return ",".join(f"{h:0{DIGITS}x}:{p}" for h, p in zip(cut, places.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared among all distinct hashes."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shared_places(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """(place in a, place in b) of every hash that both fingerprints hold."""
    at: dict[int, list[int]] = {}
    for h, p in zip(b[0].tolist(), b[1].tolist()):
        at.setdefault(h, []).append(p)
    return [(p, q) for h, p in zip(a[0].tolist(), a[1].tolist()) for q in at.get(h, [])]


def _fingerprints(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t or "", gram, window) for t in batch.column(1).to_pylist()]
        offsets = np.append(0, np.cumsum([len(h) for h, _ in found]))
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        places = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), K.lists(K.long_array(hashes), offsets), K.lists(pa.array(places.astype(np.int64)), offsets)], ["id", "hashes", "places"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, hashes, places."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(partial(_fingerprints, gram=gram, window=window), "id long, hashes array<long>, places array<long>").withColumnRenamed("id", id_col)


def follow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(part, extra, id, text) over range partitions: within a part, in order, each row is followed by the next; extra rows only follow."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text"))
    order = [F.col("at").desc(), F.col("tie").desc()]
    ranges = rows.select("at", "tie").repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("part"))
    heads = sorted(((r["head"]["at"], r["head"]["tie"]) for r in ranges.agg(F.max(F.struct("at", "tie")).alias("head")).collect()), reverse=True)  # one row a range
    ups = np.array(heads[::-1], dtype=[("at", np.int64), ("tie", np.int64)])

    @F.pandas_udf("part int, before int")
    def place(at: pd.Series, tie: pd.Series) -> pd.DataFrame:
        """The part of a row, and the part before it if the row is the first of its part."""
        n = len(ups)
        key = np.empty(len(at), ups.dtype)
        key["at"], key["tie"] = at, tie
        found = np.searchsorted(ups, key, "left")  # heads that are smaller than the row
        part = n - 1 - found
        head = ups[np.minimum(found, n - 1)] == key
        return pd.DataFrame({"part": part, "before": np.where(head, (part - 1) % n, -1)})

    dealt = rows.withColumn("p", place("at", "tie"))
    own, more = F.struct(F.col("p.part").alias("part"), F.lit(False).alias("extra")), F.struct(F.col("p.before").alias("part"), F.lit(True).alias("extra"))
    dealt = dealt.select("id", "at", "tie", "text", F.explode(F.when(F.col("p.before") >= 0, F.array(own, more)).otherwise(F.array(own))).alias("p"))
    dealt = dealt.select("p.part", "p.extra", "id", "at", "tie", "text").repartitionById(max(1, len(heads)), F.col("part"))
    return dealt.sortWithinPartitions("part", "extra", *order).select("part", "extra", "id", "text")


def edited(text: str, following: str) -> str:
    """The text with the last third of its characters replaced by as many of the following text's first ones."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        out: list[tuple] = []
        for part, extra, i, text in zip(*(c.to_pylist() for c in batch.columns)):
            now = (part, extra, i, text, fingerprint(text, gram, window))
            if held and held[0] == part and not held[1]:
                _, _, at, own, mine = held
                new = edited(own, text)
                changed = fingerprint(new, gram, window)
                out.append((at, len(own), sha256(new.encode()).hexdigest(), printed(*mine), printed(*changed), likeness(mine[0], changed[0]), likeness(mine[0], now[4][0])))
            # of several extra rows, which are equal, the first one counts
            if not (held and held[0] == part and held[1]):
                held = now
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names)


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    small_batches(docs.sparkSession)
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return follow(docs, id_col, text_col, parts).mapInArrow(partial(_compare, gram=gram, window=window), schema).withColumnRenamed("id", id_col)
