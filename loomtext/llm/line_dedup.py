"""Line dedup with sharded minimal perfect hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  Keys of at least ``min_chars`` code points in at least
``min_docs`` documents stay only in the largest id that holds them.

1. Every document sends two 64-bit hashes of each distinct long key, already
   summed per Arrow batch; Spark sums them (map-side first), so a line that a
   third of the documents hold costs one row a batch.
2. Keys in enough documents are dealt into shards of at most ``SHARD_KEYS``
   expected keys; each shard becomes a minimal perfect hash over the first
   hash, with arrays of fingerprints (the second hash), counts and keepers.
3. Documents probe those arrays in a map; lines are never joined or shuffled.
   The arrays are broadcast, at most ``round_bytes`` of them at a time, which
   is checked against their measured size.  If that is all of them, one pass
   over the documents drops the lines.  Else each round is a pass of its own
   that gives only the places of the lines it drops, for documents that lose
   any; they are joined to the texts once, at the end, so no round writes or
   shuffles a text.

Edge cases: null or empty text is one empty line; each row is a document of
its own, also where ids repeat (all rows of the largest id keep the line); null
ids compare below every other id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .quality_rules import Lines, _within
from .stage import Scratch, small_batches

SHARD_KEYS = 1 << 16
ROUND_BYTES = 64 << 20
_NO_ID = np.iinfo(np.int64).min
_SECOND = K.mix(np.arange(1, 257, dtype=np.uint64) * K.U64(0xD1342543DE82EF95)) | K.U64(1)


# --- minimal perfect hash -------------------------------------------------


def build_mph(keys: np.ndarray, slack: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, the levels' bits) for distinct keys.

    On each level the keys still without a place hash into slack * n slots;
    those alone in their slot set its bit, the others go on.  A key's index is
    the number of set bits before its own, so indexes are 0..n-1.
    """
    sizes, bits = [], []
    level = 0
    while len(keys):
        size = max(64, int(slack * len(keys)) + 1)
        slot = _slots(keys, level, size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[slot]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (K.mix(keys + K.U64(level * 0x9E3779B97F4A7C15 % 2**64)) % K.U64(size)).astype(np.int64)


def index_mph(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Each key's index; for a key that was not built in, any index or -1."""
    out = np.full(len(keys), -1, np.int64)
    rest, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(rest):
            break
        place = base + _slots(keys[rest], level, int(size))
        hit = bits[place]
        out[rest[hit]] = ranks[place[hit]]
        rest, base = rest[~hit], base + int(size)
    return out


class Shard:
    """One shard's arrays, unpacked for probing."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.sizes.sum())).astype(bool)
        self.ranks = (np.cumsum(self.bits) - 1).astype(np.int32)
        self.prints = np.frombuffer(prints, np.uint64)
        self.counts = np.frombuffer(counts, np.int64)
        self.keepers = np.frombuffer(keepers, np.int64)

    def probe(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Each key's index, -1 where the key is not in the shard."""
        at = index_mph(first, self.sizes, self.bits, self.ranks)
        return np.where((at >= 0) & (self.prints[at] == second), at, -1)


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    first = keys["h1"].to_numpy(np.int64).view(np.uint64)
    sizes, bits = build_mph(first)
    at = index_mph(first, sizes, bits, np.cumsum(bits) - 1)
    arrays = []
    for name in ("h2", "n_docs", "keeper"):
        a = np.empty(len(at), np.int64)
        a[at] = keys[name].to_numpy(np.int64)
        arrays.append(a.tobytes())
    return pd.DataFrame([[int(keys["shard"].iloc[0]), sizes.tobytes(), np.packbits(bits).tobytes(), *arrays]], columns=["shard", "sizes", "bits", "prints", "counts", "keepers"])


# --- keys of lines --------------------------------------------------------


class Keys:
    """Keys of a slice's lines: which are long enough, and their two hashes."""

    def __init__(self, docs: K.Docs, min_chars: int):
        self.lines, data = Lines(docs), docs.data
        words = K.Words(docs, lower=False, hashed=False)
        a, b = np.searchsorted(words.starts, self.lines.starts), np.searchsorted(words.starts, self.lines.ends)
        full = np.flatnonzero(b > a)
        start, end = words.starts[a[full]], words.ends[b[full] - 1]
        long = _within(K.code_points(data), start, end) >= min_chars
        self.line, start, end = full[long], start[long], end[long]
        low = K._LOWER[data]
        self.first = K.spans_hash(K._BYTE[low], start, end)
        self.second = K.spans_hash(_SECOND[low], start, end)
        self.doc = self.lines.doc[self.line]


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, first, second, owner = _numbers(batch.column(0)), [], [], []
        for docs in K.slices(batch.column(1)):
            keys = Keys(docs, min_chars)
            first.append(keys.first)
            second.append(keys.second)
            owner.append(keys.doc + docs.first)
        if not first:
            continue
        rows = pd.DataFrame({"h1": np.concatenate(first).view(np.int64), "h2": np.concatenate(second).view(np.int64), "owner": np.concatenate(owner)}).drop_duplicates()
        rows["keeper"] = ids[rows["owner"].to_numpy()]
        out = rows.groupby(["h1", "h2"], sort=False).agg(n_docs=("owner", "size"), keeper=("keeper", "max")).reset_index()
        yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def _lost(keys: Keys, ids: np.ndarray, shards: dict[int, Shard], n_shards: int) -> np.ndarray:
    """For each line of a slice whether one of these shards drops it; ids of the slice's documents."""
    dropped = np.zeros(len(keys.lines.starts), bool)
    shard_of = (keys.first >> K.U64(32)) % K.U64(n_shards)
    for k in np.unique(shard_of):
        if int(k) in shards:
            mine, shard = np.flatnonzero(shard_of == k), shards[int(k)]
            at = shard.probe(keys.first[mine], keys.second[mine])
            mine, at = mine[at >= 0], at[at >= 0]
            lost = shard.keepers[at] != ids[keys.doc[mine]]
            dropped[keys.line[mine[lost]]] = True
    return dropped


def _unpacked(shards) -> dict[int, Shard]:
    return {r["shard"]: Shard(r["sizes"], r["bits"], r["prints"], r["counts"], r["keepers"]) for r in shards.value}


def _kept(docs: K.Docs, lines: Lines, dropped: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    raw, out = docs.data.tobytes(), {"n_lines": [], "n_dropped": [], "kept_sha256": []}
    for i in range(docs.n):
        a, b = lines.per_doc[i], lines.per_doc[i + 1]
        gone = int(dropped[a:b].sum())
        kept = raw[docs.offsets[i] : docs.offsets[i + 1]] if not gone else b"\n".join(raw[lines.starts[k] : lines.ends[k]] for k in range(a, b) if not dropped[k])
        out["n_lines"].append(b - a)
        out["n_dropped"].append(gone)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
    columns = [ids.slice(docs.first, docs.n), *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())]
    return pa.RecordBatch.from_arrays(columns, ["id", *out])


def _drop(batches: Iterator[pa.RecordBatch], shards, n_shards: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """All in one pass: documents (id, text) without the lines that the shards drop."""
    unpacked = _unpacked(shards)
    for batch in batches:
        ids = _numbers(batch.column(0))
        for docs in K.slices(batch.column(1)):
            keys = Keys(docs, min_chars)
            yield _kept(docs, keys.lines, _lost(keys, ids[docs.first :], unpacked, n_shards), batch.column(0))


def _marks(batches: Iterator[pa.RecordBatch], shards, n_shards: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """One round: (id, tie, places of the lines dropped) of documents (id, tie, text) that lose any."""
    unpacked = _unpacked(shards)
    for batch in batches:
        ids = _numbers(batch.column(0))
        for docs in K.slices(batch.column(2)):
            keys = Keys(docs, min_chars)
            gone = np.flatnonzero(_lost(keys, ids[docs.first :], unpacked, n_shards))
            doc = keys.lines.doc[gone]
            who, first = np.unique(doc, return_index=True)
            rows = pa.array(docs.first + who)
            places = K.lists(pa.array((gone - keys.lines.per_doc[doc]).astype(np.int32)), np.append(first, len(gone)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), places], ["id", "tie", "places"])


def _drop_marked(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(2)
        for docs in K.slices(batch.column(1)):
            lines = Lines(docs)
            dropped = np.zeros(len(lines.starts), bool)
            for i in range(docs.n):
                if (places := marks[docs.first + i].as_py()) is not None:
                    dropped[lines.per_doc[i] + np.array(places, np.int64)] = True
            yield _kept(docs, lines, dropped, batch.column(0))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the keys that lose lines."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(partial(_count, min_chars=min_chars), "h1 long, h2 long, n_docs long, keeper long")
    return found.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, round_bytes: int = ROUND_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept_sha256 of the lines that stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    keys = scratch.keep(repeated_lines(docs, id_col, text_col, min_chars, min_docs))
    n_shards = max(1, -(-keys.count() // shard_keys))
    shard = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(n_shards)).cast("long")
    # two keys that differ but share h1 (chance about 2**-64 a pair) can't both be built in: the larger h2 stays
    one = keys.groupBy("h1").agg(F.max(F.struct("h2", "n_docs", "keeper")).alias("k")).select("h1", "k.*")
    arrays = scratch.keep(one.withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shard, "shard long, sizes binary, bits binary, prints binary, counts binary, keepers binary"))
    sizes = arrays.select("shard", sum(F.length(c) for c in arrays.columns[1:]).alias("bytes")).orderBy("shard").collect()
    rounds, room = [[]], round_bytes
    for r in sizes:
        if rounds[-1] and r["bytes"] > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(r["shard"])
        room -= r["bytes"]
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    schema = "id long, n_lines long, n_dropped long, kept_sha256 string"

    def held(part: list[int]):
        return spark.sparkContext.broadcast([r.asDict() for r in arrays.filter(F.col("shard").between(part[0], part[-1])).collect()] if part else [])

    probe = {"n_shards": n_shards, "min_chars": min_chars}
    if len(rounds) == 1:
        out = source.select("id", "text").mapInArrow(partial(_drop, shards=held(rounds[0]), **probe), schema)
    else:
        marks = None
        for part in rounds:
            # written before the next round's arrays are sent, so one round's are held at a time
            arrays_now = held(part)
            found = scratch.keep(source.mapInArrow(partial(_marks, shards=arrays_now, **probe), "id long, tie long, places array<int>"))
            arrays_now.unpersist()
            marks = found if marks is None else marks.unionByName(found)
        # rows with equal ids are told apart by a hash of their text; equal rows lose the same lines
        marks = marks.groupBy(F.coalesce("id", F.lit(int(_NO_ID))).alias("key"), "tie").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        keyed = source.withColumn("key", F.coalesce("id", F.lit(int(_NO_ID))))
        out = keyed.join(marks, ["key", "tie"], "left").select("id", "text", "places").mapInArrow(partial(_drop_marked, min_chars=min_chars), schema)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept_sha256")
