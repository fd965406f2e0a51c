"""A Merkle manifest of a table, with every row's proof by Octopus multiproofs.

A leaf is the hash of a row's fields; ``H`` is the lower-case hex SHA-256 of
its inputs in a row, digests as hex text.  Within a source the leaves ascend by
id and every three consecutive nodes become their ``H`` (the last run may be
shorter, even one) until one is left, the source's subroot; the subroots, by
source, give the root in the same way.

1. Leaves (64 bytes each; texts go no further) are sorted by source and id over
   range partitions and packed into pages of ``PAGE`` leaves, the leaf
   partitions.  Running sums over the pages' runs of one source give each leaf
   its place in its tree, so a source with a third of all rows is many tasks'
   work.
2. A page hashes all nodes that lie in it and gives only the largest of them;
   these meet in groups of a subtree of ``3 ** STEP`` leaves, some levels a
   round, up to the subroots and then the root.  What is kept are the nodes
   that no page has whole: a few dozen a page.
3. For its leaves a page works out the smallest set of nodes that it lacks -
   at each level the children of its nodes' parents without its own nodes -
   and asks for them once, in one join.  With these it derives the inner nodes
   that its leaves share and folds and hashes each leaf's proof.

Edge cases: null fields count as ``-``; a null source is a source of its own
and the first; rows with a null id come first in their source; rows that repeat
an id are leaves of their own, in the order of their hashes; rows that are equal
have equal leaves but places of their own; an empty text differs from a null
one; long texts are hashed by the JVM and never leave it; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import Scratch, small_batches

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, PAGE, STEP = 3, 4096, 8
#: The tree of subroots, beside the sources' trees 0, 1, ...
UPPER = -1
NODES = "tree long, total long, level int, at long, digest string"
RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def sizes(total: int) -> list[int]:
    """Nodes of each level of a tree, from the leaves to the one at the top."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // RUN))
    return out


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row's fields, as 32 bytes."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for f, t in zip(fields, texts)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def largest_whole(digests: list[str], first: int, total: int) -> tuple[list[tuple[int, int, str]], str | None]:
    """Of the leaves first, first + 1, ...: the nodes they cover whose parent they don't, and the top if they cover it."""
    out = []
    for level, size in enumerate(levels := sizes(total)):
        end = first + len(digests)
        if level + 1 == len(levels):
            return out, digests[0] if digests else None
        lo, hi = -(-first // RUN), end // RUN if end < size else levels[level + 1]
        hi = max(lo, hi)
        # lo may lie behind the end, if the leaves begin and end within one run
        out += [(level, first + k, d) for k, d in enumerate(digests) if not RUN * lo <= first + k < RUN * hi]
        digests = [H(digests[RUN * p - first : min(RUN * p + RUN, size) - first]) for p in range(lo, hi)]
        first = lo
    return out, None


def missing(at: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, nodes) that proofs of the leaves `at` need and that these don't give."""
    for level, size in enumerate(sizes(total)[:-1]):
        parents = np.unique(at // RUN)
        run = (RUN * parents[:, None] + np.arange(RUN)).ravel()
        yield level, np.setdiff1d(run[run < size], at)
        at = parents


class Tree:
    """The nodes on and beside the ways from some leaves of a tree to its top."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], total: int):
        self.levels = sizes(total)
        self.nodes = [dict(own)]
        for level, (_, at) in enumerate(missing(np.array(sorted(own), np.int64), total)):
            held = self.nodes[level]
            parents = sorted({k // RUN for k in held})
            held.update((k, fetched[level, k]) for k in at.tolist())
            self.nodes.append({p: H(self.run(level, p)) for p in parents})
        (self.top,) = self.nodes[-1].values()
        # siblings from a node's level to the top, shared by the leaves under it
        self.beside = [{} for _ in self.nodes]
        self.beside[-1] = {0: ""}
        for level in range(len(self.nodes) - 2, -1, -1):
            for k in self.nodes[level]:
                run = self.run(level, k // RUN)
                del run[k % RUN]
                self.beside[level][k] = "".join(run) + self.beside[level + 1][k // RUN]

    def run(self, level: int, parent: int) -> list[str]:
        return [self.nodes[level][k] for k in range(RUN * parent, min(RUN * parent + RUN, self.levels[level]))]

    def fold(self, at: int, digest: str) -> str:
        """The top, recomputed from one leaf and its siblings."""
        for level in range(len(self.levels) - 1):
            run = self.run(level, at // RUN)
            run[at % RUN] = digest
            at, digest = at // RUN, H(run)
        return digest


def _hexes(packed: bytes) -> list[str]:
    return [packed[k : k + 32].hex() for k in range(0, len(packed), 32)]


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pages of consecutive rows (name, id, leaf, altered)."""
    part, page = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        names, ids, leaves, altered = zip(*held)
        begins = [0] + [k for k in range(1, len(names)) if names[k] != names[k - 1]]
        counts = np.diff([*begins, len(names)])
        row = [[part], [page], [[names[k] for k in begins]], [counts.tolist()], [list(ids)], [b"".join(leaves)], [b"".join(altered)]]
        types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "page", "names", "counts", "ids", "leaves", "altered"])

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        while len(held) >= size:
            held, rest = held[:size], held[size:]
            yield packed()
            held, page = rest, page + 1
    if held:
        yield packed()


def _segments(row: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(tree, its leaves, place of the first leaf here, begin, end in the page) of each run of one source."""
    at = 0
    for count, (_, tree, before, total) in zip(row["counts"], row["segments"]):
        yield tree, total, before, at, at + count
        at += count


def _row(batch: pa.RecordBatch, i: int) -> dict:
    row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
    row["segments"] = [tuple(s.values()) for s in row["segments"]]
    return row


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["tree", "total", "level", "at", "digest"])


def _whole_nodes(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = _row(batch, i)
            leaves = _hexes(row["leaves"])
            out, tops = [], []
            for tree, total, before, begin, end in _segments(row):
                nodes, top = largest_whole(leaves[begin:end], before, total)
                out += [(tree, total, *n) for n in nodes]
                if top is not None:
                    tops.append((tree, top))
            if tops:  # only the first and the last source of a page can lie in others too
                nodes, top = largest_whole([d for _, d in tops], tops[0][0], trees)
                top = [] if top is None else [(len(sizes(trees)) - 1, 0, top)]
                out += [(UPPER, trees, *n) for n in nodes + top]
            if out:
                yield _nodes(out)


def _climber(up_to: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        """All nodes of one subtree above those given."""
        tree, total = int(frame["tree"].iloc[0]), int(frame["total"].iloc[0])
        levels = sizes(total)
        known = [{} for _ in range(up_to + 1)]
        for level, at, digest in zip(frame["level"], frame["at"], frame["digest"]):
            known[level][at] = digest
        out = []
        for level in range(min(up_to, len(levels) - 1)):
            for p in {k // RUN for k in known[level]}:
                digest = H([known[level][k] for k in range(RUN * p, min(RUN * p + RUN, levels[level]))])
                known[level + 1][p] = digest
                out.append((tree, total, level + 1, p, digest))
        return pd.DataFrame(out, columns=["tree", "total", "level", "at", "digest"])

    return grow


def climb(scratch: Scratch, nodes: DataFrame, most: int) -> DataFrame:
    """nodes (each tree covered by nodes that don't overlap) and all nodes above them; most: leaves of the largest tree."""
    height, below, out = len(sizes(most)) - 1, 0, nodes
    while below < height:
        up_to = below + STEP
        block = F.expr(f"at div cast(power({RUN}, {up_to} - level) as bigint)")
        low = nodes.filter(F.col("level") < up_to)
        new = scratch.keep(low.withColumn("block", block).groupBy("tree", "block").applyInPandas(_climber(up_to), NODES))
        out = out.unionByName(new)
        nodes = nodes.filter(F.col("level") >= up_to).unionByName(new.filter(F.col("level") == up_to))
        below = up_to
    return out


def _requests(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row, out = _row(batch, i), []
            for tree, total, before, begin, end in _segments(row):
                for level, at in missing(np.arange(before, before + end - begin), total):
                    out += [(tree, level, k) for k in at.tolist()]
            for level, at in missing(np.array([s[0] for s in _segments(row)], np.int64), trees):
                out += [(UPPER, level, k) for k in at.tolist()]
            columns = [pa.array([row["part"]] * len(out), pa.int32()), pa.array([row["page"]] * len(out), pa.int32())]
            columns += [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "page", "tree", "level", "at"])


def _prove(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = _row(batch, i)
            fetched: dict[int, dict] = {}
            for f in row["fetched"] or []:
                fetched.setdefault(f["tree"], {})[f["level"], f["at"]] = f["digest"]
            leaves, altered = _hexes(row["leaves"]), _hexes(row["altered"])
            parts = []
            for tree, total, before, begin, end in _segments(row):
                parts.append((tree, before, begin, end, Tree(dict(enumerate(leaves[begin:end], before)), fetched.get(tree, {}), total)))
            upper = Tree({tree: t.top for tree, *_, t in parts}, fetched.get(UPPER, {}), trees)
            subroots, proofs, folded = [], [], []
            for tree, before, begin, end, t in parts:
                subroots += [t.top] * (end - begin)
                above = upper.beside[0][tree]
                for k in range(begin, end):
                    at = before + k - begin
                    proofs.append(H([t.beside[0][at], above]))
                    folded.append(upper.fold(tree, t.fold(at, altered[k])))
            n = len(leaves)
            columns = [leaves, subroots, [upper.top] * n, proofs, folded]
            arrays = [pa.array(row["ids"], pa.string()), *[pa.array(c, pa.string()) for c in columns], pa.array([f == upper.top for f in folded], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def merkle_manifest(docs: DataFrame, altered_text: Column | None = None, fields: tuple[str, ...] = FIELDS, page: int = PAGE) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    fields: the hashed columns, of which the first is the id, the second the
    source and the last the text.  altered_text: the texts whose leaves are
    folded with the original siblings (by default those of docs); the root
    verifies the rows in which nothing has changed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "merkle")
    id_col, source_col, *_, text_col = fields
    columns = [F.col(f) for f in fields]
    new_text = F.col("new_text")
    changed = F.col(text_col).isNotNull() & ~new_text.eqNullSafe(F.col(text_col)) | F.col(text_col).isNull() & new_text.isNotNull()
    read = docs.select(*columns, (F.col(text_col) if altered_text is None else altered_text).cast("string").alias("new_text"))
    leaves = read.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("name"),  # null first, then by bytes
        F.col(id_col).alias("id"),
        leaf_of(columns).alias("leaf"),
        F.when(changed, leaf_of([*columns[:-1], new_text])).alias("altered"),
    )
    # the number of a row only deals rows that are equal in all else over the partitions
    leaves = scratch.keep(leaves.withColumn("nth", F.monotonically_increasing_id()))
    order = [F.col("name"), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("nth")]
    placed = leaves.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    packed = placed.select("name", F.col("id").cast("string"), "leaf", F.coalesce("altered", "leaf"))
    pages = scratch.keep(packed.mapInArrow(partial(_pack, size=page), "part int, page int, names array<string>, counts array<int>, ids array<string>, leaves binary, altered binary"))

    runs = pages.select("part", "page", F.posexplode(F.arrays_zip("names", "counts")).alias("k", "run")).select("part", "page", "k", F.col("run.names").alias("name"), F.col("run.counts").alias("n"))
    own = Window.partitionBy("name").orderBy("part", "page")
    runs = runs.select("part", "page", "k", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("name")).alias("total"))
    runs = scratch.keep(runs.withColumn("new", (F.col("before") == 0).cast("long")))
    # one row a range partition
    bases = runs.groupBy("part").agg(F.sum("new").alias("new")).select("part", (F.sum("new").over(Window.orderBy("part")) - F.col("new")).alias("base"))
    tree = F.col("base") + F.sum("new").over(Window.partitionBy("part").orderBy("page", "k")) - 1
    segments = runs.join(bases, "part").select("part", "page", F.struct("k", tree.alias("tree"), "before", "total").alias("s"))
    segments = scratch.keep(segments.groupBy("part", "page").agg(F.array_sort(F.collect_list("s")).alias("segments")))
    numbers = runs.agg(F.sum("new").alias("trees"), F.max("total").alias("most")).first()
    trees, most = numbers["trees"] or 0, numbers["most"] or 0

    held = pages.join(segments, ["part", "page"])
    whole = scratch.keep(held.select("counts", "leaves", "segments").mapInArrow(partial(_whole_nodes, trees=trees), NODES))
    below = climb(scratch, whole.filter(F.col("tree") != UPPER), most)
    tops = below.filter("at = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    joined = tops.select(F.lit(UPPER).cast("long").alias("tree"), F.lit(trees).cast("long").alias("total"), F.lit(0).alias("level"), F.col("tree").alias("at"), "digest")
    above = climb(scratch, whole.filter(F.col("tree") == UPPER).unionByName(joined), trees)
    store = below.unionByName(above).select("tree", "level", "at", "digest")

    wanted = held.select("part", "page", "counts", "segments").mapInArrow(partial(_requests, trees=trees), "part int, page int, tree long, level int, at long")
    got = wanted.join(store, ["tree", "level", "at"]).groupBy("part", "page").agg(F.collect_list(F.struct("tree", "level", "at", "digest")).alias("fetched"))
    proved = held.join(got, ["part", "page"], "left").select("counts", "ids", "leaves", "altered", "segments", "fetched").mapInArrow(partial(_prove, trees=trees), f"id string, {RESULT}")
    return proved.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
