"""Similarity joins over one collection, and the groups they make.

Pairs are ``(a, b, score)`` with a < b.  Candidates come from equi-joins (rare
words, vector blocks, hash buckets, time buckets), never from a cross join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomtext.functions import text as T
from loomtext.plans.shared import Scratch, stored_batches

#: Vectors of a tile of the exact cosine join, and word sets of one of the Jaccard join.
BLOCK, SET_BLOCK = 2000, 2048
#: A block holds many tiles, as each row goes to every block: at most so many rows, and so many pairs of blocks where tiles allow.
LARGEST, TASKS = 16384, 64
#: Above this threshold the prefix filter leaves few words to join.
PREFIX_FROM = 0.8
#: Sets of a band differ in size by this factor at most; a block of a band holds about so many words at most,
#: as each set goes to all blocks of sizes that its own allows.
BAND, MOST_WORDS, LEAST_WORDS = 1.3, 6_000_000, 200_000
#: Tasks that write blocks, and that read pairs of them, at most.
MOST_FILES, MOST_TASKS = 200, 20_000
#: Words with a column of their own in a tile's product, and the least and most columns that the others share.
OWN_COLUMNS, SHARED_COLUMNS = 512, (256, 8192)
#: A tile with this share of candidates is counted whole, with words that this share of its pairs
#: have as a matrix product, so many at a time; words of candidates are looked up so many at a time.
MANY, DENSE_SHARE, COLUMNS, EXPANDED = 0.02, 0.01, 1024, 4_000_000
#: LSH join: the chance to find a pair at the threshold, and what dealing a vector to a bucket
#: and working on a bucket cost, in cells of a product.
RECALL, MAX_BITS, ROW_COST, BUCKET_COST = 0.9, 20, 200, 100_000
#: Vectors that a task of the LSH join holds (about) and looks at together, and pairs that it gives back together.
LSH_ROWS, LSH_BATCH, PAIRS = 200_000, 8192, 100_000


def token_jaccard_pairs(df: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """Pairs of (id, text) whose lower-cased word sets have a Jaccard similarity above the threshold.

    From PREFIX_FROM on: two such sets share one of their first n - ceil(t * n)
    + 1 words in order of rising document frequency (the prefix filter), so
    only those words are joined.  A hit is dropped if the sets' sizes, or the
    words left after it in both, rule the pair out; at the first word that a
    pair shares neither does, if it is one.  Below, most words are in a prefix,
    so blocks of sets of like size are written once, and each two whose sizes allow
    a pair are read by a task.
    A task bounds the words that the pairs of a tile share by a matrix product
    and looks the few pairs up that the bound leaves.
    """
    # 64-bit word hashes: smaller to shuffle and quicker to intersect than strings
    sets = df.select("id", F.array_distinct(F.transform(T.words(F.lower("text")), lambda w: F.xxhash64(w))).alias("words")).filter(F.size("words") > 0)
    if threshold < PREFIX_FROM:
        placed, blocks, met = _sized_blocks(sets, threshold)
        work = sorted(((blocks[i][4] * blocks[j][4], i, j) for i, js in enumerate(met) for j in js if i <= j), reverse=True)
        return _block_pairs("word-sets", placed.select("id", "words", "block"), len(blocks), [(i, j) for _, i, j in work], _set_pairs(threshold, strict))
    each = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    df_ = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.join(df_, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    prefix = ranked.select("id", "n", F.posexplode(F.slice("w", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n")) + 1).cast("int"))).alias("k", "w")).select("id", "n", (F.col("n") - F.col("k")).alias("rest"), "w.word")
    other = prefix.toDF("b", "n_b", "rest_b", "word")
    possible = F.least("rest_a", "rest_b") >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = prefix.toDF("a", "n_a", "rest_a", "word").join(other, "word").filter("a < b").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).filter(possible).select("a", "b").distinct()
    full = pairs.join(sets.toDF("a", "words_a"), "a").join(sets.toDF("b", "words_b"), "b")
    # the outer explode keeps the planner from working the intersection out again for the filter
    shared = full.select("a", "b", (F.size("words_a") + F.size("words_b")).alias("n"), F.explode_outer(F.array(F.size(F.array_intersect("words_a", "words_b")))).alias("shared"))
    full = shared.withColumn("score", F.col("shared") / (F.col("n") - F.col("shared")))
    return full.filter(F.col("score") > threshold if strict else F.col("score") >= threshold).select("a", "b", "score")


def _sized_blocks(sets: DataFrame, threshold: float) -> tuple[DataFrame, list[tuple], list[list[int]]]:
    """sets with their block, the blocks (band, slot, least and largest size, words), and those that each may have pairs with."""
    banded = sets.withColumn("band", F.floor(F.log(F.size("words").cast("double")) / math.log(BAND)).cast("int"))
    bands = sorted(banded.groupBy("band").agg(F.sum(F.size("words")).alias("words"), F.min(F.size("words")).alias("low"), F.max(F.size("words")).alias("high")).collect())
    room = min(MOST_WORDS, max(LEAST_WORDS, sum(x["words"] for x in bands) // 11))
    slots = {x["band"]: -(-x["words"] // room) for x in bands}
    blocks = [(x["band"], k, x["low"], x["high"], x["words"] / slots[x["band"]]) for x in bands for k in range(slots[x["band"]])]
    met = [[j for j, (_, _, lo, hi, _) in enumerate(blocks) if max(low, lo) * threshold <= min(high, hi)] for _, _, low, high, _ in blocks]
    firsts, n = [], 0
    for band, many in slots.items():
        firsts.append((band, many, n))
        n += many
    many = sets.sparkSession.createDataFrame(firsts, "band int, slots long, first long")
    placed = banded.join(F.broadcast(many), "band").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), "slots")).cast("int"))
    return placed, blocks, met


def _sized_units(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, words) with the pairs (i, j) of blocks in which their block is read with those that it may have pairs with."""
    placed, _, met = _sized_blocks(sets, threshold)
    rows = [(i, [(min(i, j), max(i, j), i <= j, i >= j) for j in js]) for i, js in enumerate(met)]
    meets = sets.sparkSession.createDataFrame(rows, "block int, meets array<struct<i:int,j:int,left:boolean,right:boolean>>")
    return placed.join(F.broadcast(meets), "block").select("id", "words", F.explode("meets").alias("u")).select("id", "words", "u.*")


def _block_pairs(name: str, placed: DataFrame, n: int, units: list[tuple[int, int]], pairs: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b, score) of the pairs of blocks (units).  Rows (id, data, block) of n blocks are written once,
    and a task reads the two blocks of its unit, so no row is shuffled or written for each block that its own meets."""
    spark, schema = placed.sparkSession, "a long, b long, score double"
    if not units:
        return spark.createDataFrame([], schema)
    scratch = Scratch(spark, name)
    folder = scratch.path(scratch.keep(placed.repartition(min(n, MOST_FILES), "block"), by="block"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from pairs(_both_blocks(folder, *units[k]))

    # ranges, so that units are spread evenly over the tasks
    return spark.range(len(units)).repartitionByRange(min(len(units), MOST_TASKS), "id").groupBy("id").applyInArrow(unit, schema)


def _both_blocks(folder: str, i: int, j: int) -> Iterator[pa.RecordBatch]:
    """The rows of two blocks, marked as left or right ones, or as both if it is one block."""
    for block, left, right in [(i, True, True)] if i == j else [(i, True, False), (j, False, True)]:
        for batch in stored_batches(f"{folder}/block={block}"):
            side = lambda x: pa.array(np.full(batch.num_rows, x))
            yield pa.RecordBatch.from_arrays([*batch.columns, side(left), side(right)], [*batch.schema.names, "left", "right"])


def _set_pairs(threshold: float, strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a left and a right set of a unit above the threshold, given back a tile at a time."""
        held = list(batches)
        if not held:
            return
        unit = pa.Table.from_batches(held)
        ids, left, right = unit.column("id").to_numpy(), np.array(unit.column("left")), np.array(unit.column("right"))
        column = unit.column("words").combine_chunks()
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        # words as ranks, the most frequent first
        _, words, counts = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        words, first = rank[words], np.cumsum(size) - size
        by_size = np.argsort(size, kind="stable")
        i, j = by_size[left[by_size]], by_size[right[by_size]]
        itself = left.all() and right.all()  # a block with itself
        for k in range(0, len(i), SET_BLOCK):
            for m in range(k if itself else 0, len(j), SET_BLOCK):
                rows, columns = i[k : k + SET_BLOCK], j[m : m + SET_BLOCK]
                low, high = max(size[rows[0]], size[columns[0]]), min(size[rows[-1]], size[columns[-1]])
                if low * threshold > high:
                    continue
                x, y, shared = _shared(_Sets(rows, size, first, words), _Sets(columns, size, first, words), threshold, len(counts))
                score = shared.astype(np.float64)
                score /= size[rows[x]] + size[columns[y]] - score
                hit = score > threshold if strict else score >= threshold
                a, b, s = ids[rows[x[hit]]], ids[columns[y[hit]]], score[hit]
                if itself:
                    one = a < b if k == m else a != b
                    a, b, s = a[one], b[one], s[one]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["a", "b", "score"])

    return pairs


class _Sets:
    """Some sets of a unit: their sizes, and the word (rank) and row of each of their places."""

    def __init__(self, which: np.ndarray, size: np.ndarray, first: np.ndarray, words: np.ndarray):
        self.size = size[which]
        self.first = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(which)), self.size)
        self.word = words[np.repeat(first[which] - self.first, self.size) + np.arange(len(self.row))]

    def matrix(self, columns: np.ndarray, n: int) -> np.ndarray:
        """How many words of each set have each column."""
        return np.bincount(self.row * n + columns, minlength=len(self.size) * n).reshape(-1, n).astype(np.float32)


def _shared(a: _Sets, b: _Sets, threshold: float, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, shared): the words that sets share, for all pairs that may reach the threshold.

    Rare words share columns, so a product of the matrices counts a pair's common words and
    perhaps some others, never too few.  Larger sets get more columns, so that these others are few.
    """
    typical = min(float(a.size.mean()), float(b.size.mean()))
    least, most = SHARED_COLUMNS
    n = int(min(most, max(least, typical * (1 + threshold) / threshold)))
    column = lambda word: np.where(word < OWN_COLUMNS, word, OWN_COLUMNS + word % n)
    bound = a.matrix(column(a.word), OWN_COLUMNS + n) @ b.matrix(column(b.word), OWN_COLUMNS + n).T
    share = threshold / (1 + threshold)
    needed = (a.size * share - 0.01).astype(np.float32)[:, None] + (b.size * share).astype(np.float32)[None, :]
    x, y = np.nonzero(bound >= needed)
    if len(x) > MANY * bound.size:
        return x, y, _all_shared(a, b, n_words)[x, y]
    held = np.sort(b.row * n_words + b.word)
    shared = np.zeros(len(x), np.int64)
    ends = np.cumsum(a.size[x])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, EXPANDED), "left"), len(x)))
    for p, q in zip(cuts[:-1], cuts[1:]):
        many = a.size[x[p:q]]
        pair = np.repeat(np.arange(q - p), many)
        word = a.word[np.repeat(a.first[x[p:q]] - np.cumsum(many) + many, many) + np.arange(len(pair))]
        key = y[p:q][pair] * n_words + word
        at = np.searchsorted(held, key)
        shared[p:q] = np.bincount(pair[held[np.minimum(at, len(held) - 1)] == key], minlength=q - p)
    return x, y, shared


def _all_shared(a: _Sets, b: _Sets, n_words: int) -> np.ndarray:
    """The number of words that each two sets share: frequent ones by a matrix product, others from their places."""
    sides = []
    for s in (a, b):
        order = np.argsort(s.word, kind="stable")
        sides.append((s.row[order], s.word[order]))
    (row_l, word_l), (row_r, word_r) = sides
    n_l, n_r = len(a.size), len(b.size)
    count_l, count_r = np.bincount(word_l, minlength=n_words), np.bincount(word_r, minlength=n_words)
    shared = np.zeros((n_l, n_r), np.float32)
    dense = np.flatnonzero(count_l * count_r >= max(1.0, DENSE_SHARE * n_l * n_r))
    place = np.full(n_words, -1)
    place[dense] = np.arange(len(dense))
    for start in range(0, len(dense), COLUMNS):
        parts = []
        for row, word, n in ((row_l, word_l, n_l), (row_r, word_r, n_r)):
            at = place[word] - start
            here = (at >= 0) & (at < COLUMNS)
            m = np.zeros((n, COLUMNS), np.float32)
            m[row[here], at[here]] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    rare = np.flatnonzero((place[word_l] < 0) & (count_r[word_l] > 0))
    first_r, many = np.cumsum(count_r) - count_r, count_r[word_l[rare]]
    ends = np.cumsum(many)
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, EXPANDED), "left")
    for p, q in zip(cuts, [*cuts[1:], len(rare)]):
        if p == q:
            continue
        k, m = rare[p:q], many[p:q]
        other = np.repeat(first_r[word_l[k]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        shared += np.bincount(np.repeat(row_l[k], m) * n_r + row_r[other], minlength=n_l * n_r).reshape(n_l, n_r)
    return shared


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    v = np.array(pc.list_flatten(a), np.float64).reshape(len(a), -1)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)


def _unit_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A unit's pairs above the threshold, given back a tile at a time."""
        held = list(batches)
        if not held:
            return
        unit = pa.Table.from_batches(held)
        ids, left, right = unit.column("id").to_numpy(), np.array(unit.column("left")), np.array(unit.column("right"))
        v = _vectors(unit.column("vector"))
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        itself = left.all() and right.all()  # a block with itself
        for k in range(0, len(i), BLOCK):
            for m in range(k if itself else 0, len(j), BLOCK):
                rows, columns = i[k : k + BLOCK], j[m : m + BLOCK]
                score = v[rows] @ v[columns].T
                x, y = np.nonzero(score > threshold)
                a, b, s = ids[rows[x]], ids[columns[y]], score[x, y]
                if itself:
                    one = a < b if k == m else a != b
                    a, b, s = a[one], b[one], s[one]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["a", "b", "score"])

    return pairs


def _blocks(n: int, tile: int) -> int:
    """Blocks of n rows: few, so that rows are repeated seldom, but with TASKS pairs where there are tiles enough."""
    many = math.ceil((math.sqrt(8 * TASKS + 1) - 1) / 2)
    return max(1, -(-n // LARGEST), min(-(-n // tile), many))


def _codes(v: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    planes = np.random.Generator(np.random.PCG64(5)).standard_normal((v.shape[1], tables * bits))
    return ((v @ planes) > 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))


def _bucket_pairs(ids: np.ndarray, v: np.ndarray, codes: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs above the threshold that share a bucket of the last table and none of an earlier one."""
    order = np.argsort(codes[:, -1], kind="stable")
    ids, v, codes = ids[order], v[order], codes[order]
    ends = np.append(np.flatnonzero(np.diff(codes[:, -1])) + 1, len(ids))
    held, n = [], 0
    for first, end in zip([0, *ends[:-1]], ends):
        for k in range(first, end, BLOCK):
            for m in range(k, end, BLOCK):
                rows, columns = slice(k, min(k + BLOCK, end)), slice(m, min(m + BLOCK, end))
                score = v[rows] @ v[columns].T
                x, y = np.nonzero(score > threshold)
                keep = (x < y) | (k != m)
                x, y = x[keep], y[keep]
                new = (ids[k + x] != ids[m + y]) & ~(codes[k + x, :-1] == codes[m + y, :-1]).any(axis=1)
                x, y = x[new], y[new]
                a, b = ids[k + x], ids[m + y]
                held.append((np.minimum(a, b), np.maximum(a, b), score[x, y]))
                n += len(a)
        if held and (n >= PAIRS or end == len(ids)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["a", "b", "score"])
            held, n = [], 0


def _lsh_pairs(vectors: DataFrame, n: int, threshold: float, tables: int, bits: int) -> DataFrame:
    """Vectors are written once, with their buckets; a task reads them for a table and a share of its buckets, and holds the rows of these.

    A pair comes from the first table that it shares a bucket of, so nothing is shuffled after the vectors.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "lsh-vectors")
    kind = np.int16 if bits < 16 else np.int32
    schema = S.StructType([vectors.schema["id"], vectors.schema["vector"], S.StructField("codes", S.BinaryType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LSH_BATCH):
                part = batch.slice(at, LSH_BATCH)
                codes = _codes(_vectors(pa.chunked_array([part.column(1)])), tables, bits).astype(kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([row.tobytes() for row in codes], pa.binary())], ["id", "vector", "codes"])

    folder = scratch.path(scratch.keep(vectors.select("id", "vector").mapInArrow(coded, schema)))
    shares = max(1, -(-n // LSH_ROWS), min(-(-n // BLOCK), -(-TASKS // tables)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            table, share = divmod(k, shares)
            held = []
            for batch in stored_batches(folder, LSH_BATCH):
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(-1, tables)
                mine = np.flatnonzero(codes[:, table] % shares == share)
                if len(mine):
                    of = batch.take(pa.array(mine))
                    held.append((of.column(0).to_numpy(), _vectors(pa.chunked_array([of.column(1)])), codes[mine, : table + 1]))
            if held:
                yield from _bucket_pairs(*(np.concatenate(c) for c in zip(*held)), threshold)

    units = tables * shares
    return spark.range(0, units, 1, min(units, MOST_TASKS)).mapInArrow(pairs, "a long, b long, score double")


def lsh_tables(threshold: float, bits: int, recall: float = RECALL) -> int:
    """Tables in which a pair at the threshold shares a bucket of so many hyperplanes with the given chance."""
    same_side = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    miss = 1 - same_side**bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if 0 < miss < 1 else 1


def lsh_bits(threshold: float, n: int, recall: float = RECALL) -> int:
    """Hyperplanes of a bucket with the least work for n vectors: rows dealt to buckets, buckets, and products in them."""

    def work(bits: int) -> float:
        return lsh_tables(threshold, bits, recall) * (ROW_COST * n + BUCKET_COST * min(n, 2**bits) + n * n / 2 ** (bits + 1))

    return min(range(1, MAX_BITS + 1), key=work)


def cosine_pairs(vectors: DataFrame, threshold: float, mode: str = "exact", tables: int | None = None, bits: int | None = None) -> DataFrame:
    """Pairs of (id, vector) with cosine above the threshold.

    exact: blocks of at most LARGEST vectors are written once and meet once each, in matrix
    products of tiles of BLOCK, and only pairs above the threshold come out.  lsh: pairs that share one of
    ``tables`` buckets of ``bits`` random hyperplanes, checked in products of
    tiles of one bucket.  By default a pair at the threshold is found with a
    chance of RECALL (closer ones with a higher one), with the bits that make
    the least work; a low threshold leaves little to save over exact.
    """
    schema = "a long, b long, score double"
    if mode == "exact":
        n = _blocks(vectors.count(), BLOCK)
        placed = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
        return _block_pairs("vector-blocks", placed, n, [(i, j) for i in range(n) for j in range(i, n)], _unit_pairs(threshold))
    n = vectors.count()
    bits = bits or lsh_bits(threshold, n)
    return _lsh_pairs(vectors, n, threshold, tables or lsh_tables(threshold, bits), bits)


def semantic_relationships(memories: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """(a, b, score, label) of related pairs of (id, text): by cosine of (id, vector) where there are vectors, else by shared words."""
    pairs = cosine_pairs(vectors, threshold) if vectors is not None else token_jaccard_pairs(memories, threshold)
    return pairs.withColumn("label", relationship_label(F.col("score")))


def relationship_label(score) -> F.Column:
    return F.when(score > 0.9, "near_duplicate").when(score > 0.8, "highly_similar").when(score > 0.7, "similar").otherwise("related")


def similarity_graph(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair as a weighted edge."""
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(ways).alias("way"), F.col("score").alias("weight")).select("way.src", "way.dst", "weight")


def temporal_pairs(df: DataFrame, hours: float = 24.0) -> DataFrame:
    """Pairs of (id, ts, group) in one group less than so many hours apart; score exp(-h / 24)."""
    width = hours * 3600
    timed = df.select("id", "group", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("bucket", F.floor(F.col("us") / (width * 1_000_000)))
    near = timed.select("id", "group", "us", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    pairs = timed.toDF("a", "group", "us_a", "bucket").join(near.toDF("b", "group", "us_b", "bucket"), ["group", "bucket"])
    apart = F.abs(F.col("us_a") - F.col("us_b")) / 3_600_000_000
    pairs = pairs.filter("a <> b").withColumn("h", apart).filter(F.col("h") < hours)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.exp(-F.col("h") / 24).alias("score")).distinct()


def duplicate_groups(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader): each id joins the first earlier leader it is paired with, or leads.

    The sequential rule as a fixpoint: an undecided id is a leader once no
    smaller neighbour is undecided or a leader; it is a member of its smallest
    leader neighbour once no undecided neighbour is smaller than that.
    """
    scratch = Scratch(ids.sparkSession, "groups")
    edges = scratch.keep(pairs.select(F.col("a").alias("low"), F.col("b").alias("id")))
    done = None
    open_ = scratch.keep(edges.select("id").distinct())
    while not open_.isEmpty():
        below = open_.join(edges, "id")
        undecided = below.join(open_.select(F.col("id").alias("low")), "low", "left_semi").groupBy("id").agg(F.min("low").alias("mu"))
        # ids without a smaller neighbour lead from the start
        leaders = edges.select(F.col("low").alias("id")).distinct().join(edges.select("id").distinct(), "id", "left_anti")
        if done is not None:
            leaders = leaders.unionByName(done.filter("id = leader").select("id"))
        led = below.join(leaders.select(F.col("id").alias("low")), "low", "left_semi").groupBy("id").agg(F.min("low").alias("ml"))
        state = open_.join(undecided, "id", "left").join(led, "id", "left")
        lead = F.when(F.col("ml").isNotNull() & (F.col("mu").isNull() | (F.col("ml") < F.col("mu"))), F.col("ml")).when(F.col("ml").isNull() & F.col("mu").isNull(), F.col("id"))
        state = scratch.keep(state.select("id", lead.alias("leader")))
        decided = state.filter("leader is not null")
        done = scratch.keep(decided if done is None else done.unionByName(decided))
        open_ = scratch.keep(state.filter("leader is null").select("id"))
    return ids.select("id").join(done, "id", "left").select("id", F.coalesce("leader", "id").alias("leader")) if done is not None else ids.select("id", F.col("id").alias("leader"))


def group_summary(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, members, similarity): groups of two or more; similarity = the least of member to leader."""
    scored = groups.filter("id <> leader").join(pairs.toDF("leader", "id", "score"), ["leader", "id"])
    return scored.groupBy("leader").agg((F.count("*") + 1).alias("members"), F.min("score").alias("similarity"))


def similar_pair_share(n: int, pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs")).withColumn("support", F.col("pairs") / max(1, math.comb(n, 2)))
