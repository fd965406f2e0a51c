"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents (in an order drawn
by hash).  In the ideal mix every source with blocks left is read at once, at
rates in the ratio of the target weights; when one ends, the others go on at
rates scaled up.  Block j of a source (from 0) is released at the slot in
which the ideal mix begins it, and due by the slot in which the ideal mix ends
it; with one phase and weight w these are floor(j / w) and ceil((j + 1) / w).
Each slot takes the released block that is due first.  Since the rates sum to
1, no block is late, so at every moment each source is less than one block
away from the ideal mix.  Weights are taken as exact fractions; nothing is
rounded to a period.

The slots follow one after the other, so one task works them out, from one row
a source, and writes one row a block; all else is joins on the block.  The
ranks of documents within their source are counted in hash buckets of about
``BUCKET_ROWS`` rows, so a source with a third of all rows needs no large
task.

Edge cases: a null source is a source of its own; text isn't looked at;
repeated rows, and rows of a null or repeated id, are documents of their own,
drawn by their place in the table as well; of blocks that are due at once, the
one of the source that is first by name goes first; sources without a target weight come
after all others, in proportion to their size; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import Scratch

BLOCK_ROWS, BUCKET_ROWS = 64, 20_000
#: Rows of a batch of the plan.
BATCH = 100_000


class IdealMix:
    """When the ideal mix has done so much of a source.

    At virtual time v a source with whole weight W has done min(n, W * v) of
    its n blocks, so all together have done F + A * v: F blocks of the sources
    that have ended, A the summed weights of the others.
    """

    def __init__(self, blocks: dict[str, int], weights: dict[str, float]):
        exact = {s: Fraction(weights[s]) for s in blocks}
        scale = math.lcm(*(w.denominator for w in exact.values()))
        self.whole = {s: int(w * scale) for s, w in exact.items()}
        active, ended = sum(self.whole.values()), 0
        # (end in virtual time, F, A) of each stretch between two ends
        self.ends, self.lines = [], []
        for end, s in sorted((Fraction(n, self.whole[s]), s) for s, n in blocks.items()):
            self.ends.append(end)
            self.lines.append((ended, active))
            ended, active = ended + blocks[s], active - self.whole[s]

    def time(self, source: str, j: int) -> tuple[int, int]:
        """The time at which j blocks of the source are done, as numerator and denominator."""
        w = self.whole[source]
        ended, active = self.lines[min(bisect.bisect_left(self.ends, Fraction(j, w)), len(self.lines) - 1)]
        return ended * w + active * j, w


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of all blocks, by earliest deadline first."""
    blocks = {s: n for s, n in blocks.items() if n > 0}
    if not blocks:
        return
    ideal = IdealMix(blocks, weights)
    waiting = [(0, s, 0) for s in sorted(blocks)]  # (release, source, block)
    ready: list[tuple[int, str, int]] = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            done, w = ideal.time(s, j + 1)
            heapq.heappush(ready, (-(-done // w), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j, slot
        if j + 1 < blocks[s]:
            begun, w = ideal.time(s, j + 1)
            heapq.heappush(waiting, (begun // w, s, j + 1))


def full_schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """The schedule of the sources with a target weight, then of the others in proportion to their size."""
    first = {s: n for s, n in blocks.items() if weights.get(s, 0) > 0}
    rest = {s: n for s, n in blocks.items() if s not in first}
    yield from schedule(first, weights)
    base = sum(first.values())
    for s, j, slot in schedule(rest, {s: float(n) for s, n in rest.items()}):
        yield s, j, base + slot


def _plan(batches: Iterator[pa.RecordBatch], weights: dict[str, float] | None, block_rows: int) -> Iterator[pa.RecordBatch]:
    sizes = {k: n for batch in batches for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    wanted = weights if weights is not None else {s: math.sqrt(n) for s, n in sizes.items()}
    slots = full_schedule({s: -(-n // block_rows) for s, n in sizes.items()}, wanted)
    while part := list(itertools.islice(slots, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64(), pa.int64()))], ["key", "block", "slot"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: id, source, block, slot, place (in the block); the mix is ordered by slot, place.

    weights: target weight by source ('' for null); by default the square
    root of each source's number of documents.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    # written, so that a row keeps its place, and its draw, in all that reads it
    nth = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("key"), F.xxhash64(id_col, nth).alias("draw"))
    rows = scratch.keep(rows)
    counts = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n")))
    buckets = max(1, -(-(counts.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS))
    bucketed = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("key", "bucket").agg(F.count("*").alias("m")).select("key", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("draw", "id")
    ranked = bucketed.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["key", "bucket"]).withColumn("rank", F.col("rank") + F.col("start"))
    placed = ranked.select("id", "source", "key", F.floor(F.col("rank") / block_rows).alias("block"), (F.col("rank") % block_rows).alias("place"))
    plan = scratch.keep(counts.coalesce(1).mapInArrow(partial(_plan, weights=weights, block_rows=block_rows), "key string, block long, slot long"))
    out = placed.join(plan, ["key", "block"])
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot", F.col("place").cast("long").alias("place"))
