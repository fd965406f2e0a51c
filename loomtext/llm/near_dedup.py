"""Near-duplicate classes by min-max hashing, with every link confirmed on full sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with
fewer words, the whole sequence).  Documents whose sets reach the Jaccard
similarity 75/100 are linked; a component is what links reach.

1. One map hashes each document: set size, a 128-bit digest of the set, and
   bands.  Each of 80 permutations gives two signature values, its minimum
   and its maximum over the set, so 160 values cost 80 hash evaluations; both
   agree between two sets with chance J.  Four values make a band, 40 bands:
   a pair at J = 0.75 shares none with chance (1 - 0.75**4)**40 = 3e-7.
2. Equal digests are one class; only its smallest id goes on, so thousands of
   copies cost one row.
3. In each band bucket the smallest id is compared with all other members on
   full sets; links are contracted to components.  What is left are pairs of a
   bucket whose members still lie in different components, without the
   smallest id.  In buckets of at most ``SMALL`` members they are compared pair
   by pair.  The members of all larger buckets with one main component (the
   one with most members) are a family: the bands of a family's texts meet
   here, so that a pair is worked on once, not once a band.  Families are cut
   by set size into groups, of which only neighbouring ones can hold links,
   and these into blocks of about ``BLOCK`` texts; a task gets two blocks,
   counts all intersections as a product of incidence matrices and gives back
   only links that join components.  So no pair that shares a bucket is lost,
   while a large group costs no row for each pair; members of its main
   component are not compared with one another.

Edge cases: null or empty text has the empty set (n_shingles 0) and is linked
with nothing; rows with a null id are linked with nothing, component null,
kept true; rows that repeat an id are one node; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.plans.components import connected_components

from . import kernel as K
from .stage import Scratch, bounded, small_batches

SHINGLE = 5
PERMUTATIONS, ROWS = 80, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Buckets of more members are compared in blocks of about BLOCK texts.
SMALL, BLOCK = 64, 256
#: A block holds about this many shingles at most, and a matrix so many columns.
BLOCK_SHINGLES, COLUMNS = 400_000, 4096
#: Pairs are compared in runs of about this many bytes of text.
PAIR_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 2**31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_MIX = K.mix(np.arange(1, ROWS + BANDS + 1, dtype=np.uint64)) | K.U64(1)


def shingles(docs: K.Docs, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of a slice, repeats included, by document."""
    words = K.Words(docs, lower=True)
    at, hashes = words.grams(n)
    owner = words.doc[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = K.spans_hash(words.hashes, words.per_doc[short], words.per_doc[short + 1])
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, whole])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    return owner, hashes


def distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (owner, hash) pairs without repeats, sorted by both."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in K.slices(batch.column(1)):
            owner, hashes = distinct(*shingles(docs, n))
            sizes = np.bincount(owner, minlength=docs.n)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.zeros((2, len(hashes) + 1), np.uint64)
            np.cumsum(K.mix(hashes), out=sums[0, 1:])
            np.cumsum(K.mix(hashes ^ K.U64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            digest = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
            full = np.flatnonzero(sizes)
            bands = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                x, first = (hashes >> K.U64(32)).astype(np.uint32), bounds[full]
                per_band = ROWS // 2
                for p in range(PERMUTATIONS):
                    y = x * _A[p] + _B[p]
                    for which, ends in enumerate((np.minimum, np.maximum)):
                        value = ends.reduceat(y, first).astype(np.uint64) + K.U64(1)
                        bands[:, p // per_band] += K.mix(value * _MIX[2 * (p % per_band) + which])
                bands = K.mix(bands ^ _MIX[ROWS:])
            offsets = np.zeros(docs.n + 1, np.int64)
            offsets[full + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(docs.first, docs.n), pa.array(sizes.astype(np.int64)), K.long_array(digest[0]), K.long_array(digest[1]), K.lists(K.long_array(bands.ravel()), np.cumsum(offsets))],
                ["id", "n", "d1", "d2", "bands"],
            )


def _sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [(owner + docs.first, hashes) for docs in K.slices(pa.array(texts, pa.large_string())) for owner, hashes in [distinct(*shingles(docs, n))]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, text_a, text_b), the linked ones."""
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ends = np.cumsum([len(x or "") + len(y or "") for x, y in zip(left, right)]) // PAIR_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(left)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            (pa_, ha), (pb, hb) = _sets(left[lo:hi], n), _sets(right[lo:hi], n)
            size = np.bincount(pa_, minlength=hi - lo) + np.bincount(pb, minlength=hi - lo)
            pair, hashes = np.concatenate([pa_, pb]), np.concatenate([ha, hb])
            order = np.lexsort((hashes, pair))
            pair, hashes = pair[order], hashes[order]
            shared = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])], minlength=hi - lo)
            linked = (shared > 0) & (100 * shared >= percent * (size - shared))
            yield batch.select([0, 1]).slice(lo, hi - lo).filter(pa.array(linked))


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(partial(_confirm, n=n, percent=percent), "a long, b long")


def _unit_links(unit: pa.Table, n: int, percent: int) -> pa.Table:
    """Links between the left and the right rows of a unit that join different components."""
    left = np.array(unit.column("left").to_pylist(), bool)
    right = np.array(unit.column("right").to_pylist(), bool)
    ids, component = unit.column("id").to_numpy(), unit.column("component").to_numpy()
    owner, hashes = _sets(unit.column("text").to_pylist(), n)
    size = np.bincount(owner, minlength=len(ids))
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    column = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]])) if len(hashes) else hashes.astype(np.int64)
    shared = np.zeros((left.sum(), right.sum()), np.float32)
    row_l, row_r = np.cumsum(left) - 1, np.cumsum(right) - 1
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        o, c = owner[a:b], column[a:b] - start
        sides = []
        for mine, row in ((left, row_l), (right, row_r)):
            here = mine[o]
            m = np.zeros((mine.sum(), COLUMNS), np.float32)
            m[row[o[here]], c[here]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    both = size[i][:, None] + size[j][None, :] - shared
    linked = (shared > 0) & (100 * shared >= percent * both) & (component[i][:, None] != component[j][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for x, y in np.argwhere(linked):
        u, v = find(int(component[i[x]])), find(int(component[j[y]]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((ids[i[x]], ids[j[y]]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _by_blocks(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links in families: members has main (the family), id, n, component, each member once."""
    # sizes of linked sets differ by at most the factor 100 / percent, so their groups by one
    group = F.floor(F.ln(F.col("n")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    placed = members.withColumn("is_main", F.col("component") == F.col("main")).withColumn("group", group)
    sizes = placed.groupBy("main", "is_main", "group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = lambda which: F.map_from_entries(F.collect_list(F.when(which, F.struct("group", "blocks"))))
    placed = placed.join(sizes.groupBy("main").agg(blocks(F.col("is_main")).alias("main_blocks"), blocks(~F.col("is_main")).alias("blocks")), "main")
    own = F.pmod(F.xxhash64("id"), F.try_element_at(F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks")), F.col("group"))).cast("int")
    placed = placed.withColumn("own", own)

    def meets(others: str, step: int, kind: int, left: Column, right: Column, swap: bool) -> Column:
        """The units in which a member meets the blocks of the group step further; swap: those come first."""
        there = F.col("group") + F.lit(step)
        count = F.coalesce(F.try_element_at(others, there), F.lit(0))
        each = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        first, second = ((there, lambda k: k), (F.col("group"), lambda k: F.col("own"))) if swap else ((F.col("group"), lambda k: F.col("own")), (there, lambda k: k))
        return F.transform(each, lambda k: F.struct(F.lit(kind).alias("kind"), first[0].alias("g"), second[0].alias("h"), first[1](k).alias("i"), second[1](k).alias("j"), left.alias("left"), right.alias("right")))

    yes, no = F.lit(True), F.lit(False)
    near = range(-1, 2) if percent < 100 else range(1)
    same = F.col("group")
    outside = [F.transform(F.sequence(F.lit(0), F.try_element_at("blocks", same) - 1), lambda k: F.struct(F.lit(0).alias("kind"), same.alias("g"), same.alias("h"), F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") <= k).alias("left"), (F.col("own") >= k).alias("right")))]
    outside += [meets("blocks", step, 0, F.lit(step > 0), F.lit(step < 0), swap=step < 0) for step in near if step]
    outside += [meets("main_blocks", step, 1, yes, no, swap=False) for step in near]
    main = [meets("blocks", step, 1, no, yes, swap=True) for step in near]
    units = placed.select("main", "id", "component", F.explode(F.when(F.col("is_main"), F.concat(*main)).otherwise(F.concat(*outside))).alias("u")).select("main", "id", "component", "u.*")
    return units.join(texts, "id").groupBy("main", "kind", "g", "h", "i", "j").applyInArrow(lambda unit: _unit_links(unit, n, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, n: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.keep(source.mapInArrow(partial(_sketch, n=n), "id long, n long, d1 long, d2 long, bands array<long>"))
    classes = sketch.filter("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    named = scratch.keep(sketch.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))

    reps = named.filter("n > 0 and id = rep").select("id").distinct()
    entries = sketch.filter("n > 0").join(reps, "id", "left_semi").select("id", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("centre"), F.max("id").alias("last")).filter("centre.id <> last").select("bucket", F.col("centre.id").alias("centre"), F.col("centre.n").alias("centre_n"))
    buckets = scratch.keep(entries.join(shared, "bucket").filter("id <> centre"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else the sets' sizes rule a link out
    ids = scratch.keep(buckets.select("id").unionByName(buckets.select(F.col("centre").alias("id"))).distinct())
    texts = scratch.keep(source.join(bounded(ids), "id", "left_semi"))
    # an id that repeats with several texts has classes of its own; they are one node
    several = named.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("id")
    same_id = named.join(several, "id", "left_semi").filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    stars = buckets.filter(fits(F.col("n"), F.col("centre_n"))).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.keep(same_id.unionByName(_linked(stars, texts, n, percent)))
    component = scratch.keep(connected_components(links, "a", "b"))

    left = buckets.select("bucket", "id", "n").join(component.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    parts = left.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("components"), F.sum("m").alias("members"), F.max(F.struct("m", "component")).alias("main"))
    open_ = open_.filter("components > 1").select("bucket", "members", F.col("main.component").alias("main"))
    members = scratch.keep(left.join(open_, "bucket"))
    small = members.filter(F.col("members") <= SMALL).select("bucket", "id", "n", "component")
    other = small.toDF("bucket", "id_2", "n_2", "component_2")
    pairs = small.join(other, "bucket").filter("component < component_2").filter(fits(F.col("n"), F.col("n_2"))).select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
    large = members.filter(F.col("members") > SMALL).groupBy("main", "id", "n").agg(F.max("component").alias("component"))
    more = scratch.keep(_linked(pairs, texts, n, percent).unionByName(_by_blocks(large, texts, n, percent)))
    if not more.isEmpty():
        component = scratch.keep(connected_components(links.unionByName(more), "a", "b"))
    scratch.drop_all_but(named, component)
    out = named.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
