"""Graph operators over vertices ``(id, …)`` and edges ``(src, dst, type)``.

Iterative operators write each round to the shared folder and stop on an empty
frontier, so the plan never grows and a lost executor costs one round.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomtext.operators import adjacency, reach
from loomtext.operators.dealt import Dealt, column_of, dealt, kept_by_part, part_rows, places
from loomtext.plans.components import connected_components
from loomtext.plans.shared import Scratch, bounded

__all__ = ["connected_components", "degree", "traverse", "shortest_paths", "path_lengths", "all_paths", "communities", "pagerank", "triangles", "clustering", "profile", "verified_edges", "nodes_by_label", "relations", "update_nodes", "delete_nodes", "update_relations", "delete_relations", "betweenness"]


#: Triangles: edges of a task at most (about), bytes of its bit matrix, and paths of two edges looked at together.
TRIPLE_EDGES, BIT_BYTES, WEDGES = 4_000_000, 256 << 20, 4_000_000
#: Tasks that count in blocks, at most.
MOST_TASKS = 20_000


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def verified_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi")


def degree(vertices: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    ends = {"out": edges.select(F.col("src").alias("id")), "in": edges.select(F.col("dst").alias("id"))}
    ends["both"] = ends["out"].unionByName(ends["in"])
    counted = ends[direction].groupBy("id").agg(F.count("*").alias("n"))
    return vertices.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def nodes_by_label(vertices: DataFrame, label: str) -> DataFrame:
    """Vertices (id, labels ARRAY, ...) that carry the label."""
    return vertices.filter(F.array_contains("labels", label))


def relations(edges: DataFrame, src: int | None = None, dst: int | None = None, type: str | None = None) -> DataFrame:
    """Edges by their ends and type; what isn't given doesn't matter."""
    for column, value in (("src", src), ("dst", dst), ("type", type)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    return edges


def update_nodes(vertices: DataFrame, updates: DataFrame) -> DataFrame:
    """Merges properties (id, properties MAP) into those of the vertices; new values win, unknown ids are ignored."""
    fresh = updates.select("id", F.col("properties").alias("_fresh"))
    merged = F.when(F.col("_fresh").isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter("properties", lambda k, v: ~F.map_contains_key("_fresh", k)), "_fresh"))
    return vertices.join(fresh, "id", "left").withColumn("properties", merged).select(vertices.columns)


def delete_nodes(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices without the ids, and the edges without those that had an end there."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.select(edges.columns)


def update_relations(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Merges properties (src, dst, type, properties MAP) into those of the edges."""
    fresh = updates.select("src", "dst", "type", F.col("properties").alias("_fresh"))
    merged = F.when(F.col("_fresh").isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter("properties", lambda k, v: ~F.map_contains_key("_fresh", k)), "_fresh"))
    return edges.join(fresh, ["src", "dst", "type"], "left").withColumn("properties", merged).select(edges.columns)


def delete_relations(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges without those named by (src, dst, type)."""
    return edges.join(keys.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti").select(edges.columns)


def traverse(
    starts: DataFrame,
    edges: DataFrame,
    depth: int = 5,
    direction: str = "out",
    types: tuple[str, ...] | None = None,
    nodes: DataFrame | None = None,
    skip: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """(start, id, hops): nodes within 1..depth hops of each start, the start left out.

    types: only edges of these types are followed; nodes: only these ids are
    given back (they may be reached through others); skip and limit count each
    start's nodes by hops, then id.
    """
    scratch = Scratch(starts.sparkSession, "traverse")
    if types is not None:
        edges = edges.filter(F.col("type").isin(*types))
    steps = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "in" else edges.select("src", "dst")
    numbers = scratch.keep(reach.numbered(starts))
    given = numbers.select(F.col("id").alias("start"), "k")
    parts = [reach.expanded(given, first, hop, level) for first, hop, level in reach.levels(scratch, numbers, steps, depth, direction == "both")]
    found = parts[0] if parts else given.select("start", F.col("start").cast(steps.schema["dst"].dataType).alias("id"), F.lit(0).alias("hops")).limit(0)
    for part in parts[1:]:
        found = found.unionByName(part)
    if nodes is not None:
        found = found.join(nodes.select("id").distinct(), "id", "left_semi").select("start", "id", "hops")
    if skip or limit is not None:
        place = F.row_number().over(Window.partitionBy("start").orderBy("hops", "id"))
        found = found.withColumn("place", place).filter(F.col("place") > skip).filter(F.col("place") <= skip + limit if limit is not None else F.lit(True)).drop("place")
    return found


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, goal, length, path) for pairs joined by an undirected path, of at most depth steps if given; the smallest parents win."""
    scratch = Scratch(pairs.sparkSession, "paths")
    steps = scratch.keep(_directed(edges, "both"))
    goals = scratch.keep(pairs.select("start", "goal").distinct())
    seen = scratch.keep(goals.select("start", F.col("start").alias("id")).distinct().withColumn("path", F.array("id")))
    frontier, found = seen, scratch.keep(goals.filter("start = goal").join(seen, "start").select("start", "goal", "path"))
    for _ in itertools.count() if depth is None else range(depth):
        reached = frontier.withColumnRenamed("id", "src").join(steps, "src").groupBy("start", F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        frontier = scratch.keep(reached.join(seen, ["start", "id"], "left_anti").withColumn("path", F.concat("path", F.array("id"))).select("start", "id", "path"))
        if frontier.isEmpty():
            break
        found = found.unionByName(scratch.keep(frontier.join(goals.withColumnRenamed("goal", "id"), ["start", "id"]).select("start", F.col("id").alias("goal"), "path")))
        seen = seen.unionByName(frontier)
        open_ = goals.join(found.select("start", "goal"), ["start", "goal"], "left_anti")
        frontier = frontier.join(open_.select("start").distinct(), "start", "left_semi")
    return found.select("start", "goal", (F.size("path") - 1).alias("length"), "path")


def path_lengths(pairs: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, goal, length) for pairs joined by an undirected path, as shortest_paths gives them, without the paths.

    The search carries masks of starts (reach), and a goal's starts are a mask too, so
    rows of a start and goal are made only for the pairs that a level finds.
    """
    scratch = Scratch(pairs.sparkSession, "lengths")
    steps = edges.select("src", "dst")
    goals = pairs.select("start", "goal").filter("start is not null and goal is not null")
    numbers = scratch.keep(reach.numbered(goals.select(F.col("start").alias("id"))))
    numbered = goals.join(bounded(numbers.toDF("start", "k")), "start")
    words = numbered.groupBy("goal", F.expr("k div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 64 as int)))").alias("word"))
    wanted = scratch.keep(words.groupBy(F.col("goal").alias("id")).agg(F.collect_list(F.struct("w", "word")).alias("of")))
    found = scratch.keep(goals.filter("start = goal").distinct().withColumn("length", F.lit(0)))
    n = (wanted.select(F.explode("of").alias("o")).agg(F.sum(F.bit_count("o.word"))).first()[0] or 0) - found.count()
    for first, hop, level in reach.levels(scratch, numbers, steps, depth, mirrored=True):
        each = level.join(wanted, "id").select("id", "fresh", F.explode("of").alias("o")).withColumn("at", F.col("o.w") - first // 64)
        inside = each.filter((F.col("at") >= 0) & (F.col("at") < F.size("fresh"))).select("id", "o.w", F.expr("o.word & fresh[cast(at as int)]").alias("word")).filter("word <> 0")
        bits = inside.select("id", "w", F.expr("explode(filter(sequence(0, 63), b -> shiftright(word, b) & 1 = 1))").alias("bit"))
        hits = bits.select(F.col("id").alias("goal"), (F.col("w") * 64 + F.col("bit")).alias("k")).join(bounded(numbers.toDF("start", "k")), "k")
        hits = scratch.keep(hits.select("start", "goal", F.lit(hop).alias("length")))
        found = found.unionByName(hits)
        n -= hits.count()
        if not n:
            break
    return found


def all_paths(starts: DataFrame, edges: DataFrame, depth: int, goals: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(path): directed paths of 1..depth steps that use no edge twice.

    goals: only paths that end at one of these ids; limit: the first so many
    of each start and end, shorter ones first.  Each task follows its starts through
    the whole graph (adjacency), so no path is shuffled or written before the result;
    only of graphs that no task holds, paths are joined with edges, and each round but
    the last is written.  The number of paths itself grows with the degrees to the
    power of depth.
    """
    scratch = Scratch(starts.sparkSession, "all-paths")
    steps = scratch.keep(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    held = adjacency.written(scratch, steps)
    if held:
        out = adjacency.paths(starts, *held, steps.schema["src"].dataType, depth)
    else:
        out = _joined_paths(scratch, starts, steps, depth)
    out = out.withColumn("src", F.element_at("path", -1))
    if goals is not None:
        out = out.join(bounded(goals.select(F.col("id").alias("src")).distinct()), "src", "left_semi")
    if limit is not None:
        order = Window.partitionBy(F.element_at("path", 1), "src").orderBy(F.size("path"), "path")
        out = out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit)
    return out.select("path")


def _joined_paths(scratch: Scratch, starts: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    now, out = starts.select(F.array("id").alias("path"), F.col("id").alias("src")).distinct(), None
    for length in range(1, depth + 1):
        used = F.exists(F.sequence(F.lit(1), F.size("path") - 1), lambda k: (F.element_at("path", k) == F.col("src")) & (F.element_at("path", k + 1) == F.col("dst")))
        fresh = F.when(F.size("path") > 1, ~used).otherwise(True)
        now = now.join(steps, "src").filter(fresh).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
        if length < depth:  # nothing is searched on from the longest paths, the most by far
            now = scratch.keep(now)
        out = now if out is None else out.unionByName(now)
        if length < depth and now.isEmpty():
            break
    return out.select("path")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): synchronous label propagation, most frequent label, the smallest of equals."""
    scratch, spark = Scratch(edges.sparkSession, "communities"), edges.sparkSession
    edges = edges.select("src", "dst").filter("src is not null and dst is not null")
    n, kind = 2 * edges.count(), edges.schema["src"].dataType
    parts = max(1, min(reach.PARTS, round(math.sqrt(n / reach.FEW))), math.ceil(n / reach.MANY))
    graph = dealt(scratch, edges, parts, mirrored=True)
    nodes = scratch.keep(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    labels, folder = nodes.withColumn("community", F.col("id")), None
    state = S.StructType([S.StructField("id", kind), S.StructField("community", kind), S.StructField("part", S.IntegerType())])
    for _ in range(rounds):
        folder = kept_by_part(scratch, labels, parts) if folder is None else scratch.path(labels)
        labels = scratch.keep(spark.range(0, parts, 1, parts).mapInArrow(partial(_voted, graph=graph, folder=folder), state), by="part")
    return labels.select("id", "community")


def _voted(batches: Iterator[pa.RecordBatch], graph: Dealt, folder: str) -> Iterator[pa.RecordBatch]:
    """(id, community, part): the nodes of a part with the label that most of their neighbours have, the smallest of equals."""
    for part in (k for batch in batches for k in batch.column(0).to_pylist()):
        ids = names = None
        votes = [np.zeros((2, 0), np.int32)]  # node, label
        for p, edges in graph.into(part):
            if not edges:
                continue
            held = part_rows(folder, p, "id", "community")
            label, names = places(column_of(held, "community"), names)
            src = np.concatenate([pc.index_in(x, value_set=column_of(held, "id")).to_numpy() for x, _ in edges])
            dst, ids = places(pa.concat_arrays([y for _, y in edges]), ids)
            once = np.unique(dst * len(held) + src)  # an edge counts once
            votes.append(np.stack([once // len(held), label[once % len(held)]]).astype(np.int32))
        if ids is None:
            continue
        node, label = np.concatenate(votes, axis=1)
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        key, many = np.unique(node * np.int64(len(names)) + rank[label], return_counts=True)
        node, label = key // len(names), key % len(names)
        order = np.lexsort((label, -many, node))
        best = order[np.append(True, node[order][1:] != node[order][:-1])]
        at = np.argsort(rank)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(node[best])), names.take(pa.array(at[label[best]])), pa.array(np.full(len(best), part, np.int32))], ["id", "community", "part"])


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    scratch = Scratch(vertices.sparkSession, "pagerank")
    nodes = scratch.keep(vertices.select("id").distinct())
    n = max(1, nodes.count())
    steps = edges.select("src", "dst").distinct()
    shares = scratch.keep(steps.join(steps.groupBy("src").agg(F.count("*").alias("out")), "src"))
    ranks = scratch.keep(nodes.withColumn("rank", F.lit(1.0 / n)))
    sinks = nodes.join(shares.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    for _ in range(rounds):
        loose = ranks.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        got = shares.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        fresh = nodes.join(got, "id", "left").join(F.broadcast(loose))  # one row
        ranks = scratch.keep(fresh.select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank")))
    return ranks


def _simple(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): nodes are dealt into colours, and the edges among each three colours make a task.

    Edges are written once in blocks of two colours, and a task reads those of its
    colours; a triangle is counted where the task's colours are just its own.
    """
    return _triangles(_coloured(edges, "triangles"), edges)


def _coloured(edges: DataFrame, name: str) -> Dealt:
    n = edges.count()
    colours = max(math.ceil(math.sqrt(9 * n / TRIPLE_EDGES)), min(6, 1 + n // 50_000))
    return dealt(Scratch(edges.sparkSession, name), edges.select("src", "dst").filter("src <> dst"), colours, mirrored=True)


def _triangles(graph: Dealt, edges: DataFrame) -> DataFrame:
    threes = list(itertools.combinations_with_replacement(range(graph.parts), 3))
    count = _closed(graph.parts)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for three in (threes[k] for batch in batches for k in batch.column(0).to_pylist()):
            held = []
            for p, q in sorted(set(itertools.combinations(three, 2))):
                colour = lambda c, n: pa.array(np.full(n, c, np.int32))
                held += [pa.RecordBatch.from_arrays([a, b, colour(p, len(a)), colour(q, len(a))], ["a", "b", "p", "q"]) for a, b in graph.block(p, q)]
            if held:
                unit = three[0] * graph.parts**2 + three[1] * graph.parts + three[2]
                yield from count((pa.scalar(unit),), pa.Table.from_batches(held)).to_batches()

    found = edges.sparkSession.range(0, len(threes), 1, min(len(threes), MOST_TASKS)).mapInArrow(closed, f"id {edges.schema['src'].dataType.simpleString()}, n long")
    return found.groupBy("id").agg(F.sum("n").alias("triangles"))


def _degrees(graph: Dealt, edges: DataFrame) -> DataFrame:
    """(id, d): the different neighbours of each node, counted in blocks."""
    blocks = list(itertools.combinations_with_replacement(range(graph.parts), 2))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q in (blocks[k] for batch in batches for k in batch.column(0).to_pylist()):
            if held := list(graph.block(p, q)):
                coded = pa.concat_arrays([x for side in (0, 1) for x in [e[side] for e in held]]).dictionary_encode()
                ends, n = np.sort(coded.indices.to_numpy().astype(np.int64).reshape(2, -1), axis=0), len(coded.dictionary)
                once = np.unique(ends[0] * n + ends[1])
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(once // n, minlength=n) + np.bincount(once % n, minlength=n))], ["id", "d"])

    found = edges.sparkSession.range(0, len(blocks), 1, min(len(blocks), MOST_TASKS)).mapInArrow(counted, f"id {edges.schema['src'].dataType.simpleString()}, d long")
    return found.groupBy("id").agg(F.sum("d").alias("d"))


def _closed(colours: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def count(key: tuple, edges: pa.Table) -> pa.Table:
        """(id, n): the triangles among the edges (a, b, and their colours p, q) that have the unit's colours."""
        unit = key[0].as_py()
        own = np.array([unit // colours**2, unit // colours % colours, unit % colours])
        coded = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks().dictionary_encode()
        ends, n = coded.indices.to_numpy().reshape(2, -1), len(coded.dictionary)
        colour = np.zeros(n, np.int64)
        colour[ends[0]], colour[ends[1]] = edges.column("p").to_numpy(), edges.column("q").to_numpy()
        # from the end of lower degree on: no node has many following ones
        place = np.empty(n, np.int64)
        place[np.argsort(np.bincount(ends.ravel(), minlength=n), kind="stable")] = np.arange(n)
        x, y = np.minimum(place[ends[0]], place[ends[1]]), np.maximum(place[ends[0]], place[ends[1]])
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        once = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]  # an edge counts once
        x, y = x[once], y[once]
        last = np.searchsorted(x, x, "right")  # of the edges of x
        later = last - np.arange(len(x)) - 1
        bits, keys = (np.zeros((n, -(-n // 8)), np.uint8), None) if n * n <= 8 * BIT_BYTES else (None, x * n + y)
        if bits is not None:
            np.bitwise_or.at(bits, (x, y >> 3), np.left_shift(1, y & 7).astype(np.uint8))
        ends_at, tally = np.cumsum(later), np.zeros(n, np.int64)
        by_place = np.empty(n, np.int64)
        by_place[place] = colour
        cuts = np.searchsorted(ends_at, np.arange(0, int(ends_at[-1]), WEDGES), "left") if len(x) else []
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            if a == b:
                continue
            m = later[a:b]
            first = np.repeat(np.arange(a, b), m)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m)
            v, w = y[first], y[second]  # v before w
            if bits is not None:
                hit = np.flatnonzero(bits[v, w >> 3] >> (w & 7) & 1)
            else:
                at = np.searchsorted(keys, v * n + w)
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == v * n + w)
            found = np.stack([x[first[hit]], v[hit], w[hit]])
            found = found[:, (np.sort(by_place[found], axis=0) == own[:, None]).all(axis=0)]
            tally += np.bincount(found.ravel(), minlength=n)
        tally = tally[place]
        some = np.flatnonzero(tally)
        return pa.table({"id": coded.dictionary.take(pa.array(some)), "n": tally[some]})

    return count


def clustering(edges: DataFrame) -> DataFrame:
    """(id, coefficient): triangles over possible ones among its neighbours."""
    graph = _coloured(edges, "clustering")
    both = _degrees(graph, edges).join(_triangles(graph, edges), "id", "left")
    return both.select("id", F.coalesce(F.try_divide(2 * F.coalesce("triangles", F.lit(0)), F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("coefficient"))


def profile(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(figure, value): node and edge counts, mean, largest and smallest degree.

    Where the tables have them, the 20 most frequent labels and edge types too,
    as "label:..." and "type:...".
    """
    d = degree(vertices, edges).agg(F.count("*").cast("double").alias("nodes"), F.avg("degree").alias("avg_degree"), F.max("degree").cast("double").alias("max_degree"), F.min("degree").cast("double").alias("min_degree"))
    e = edges.agg(F.count("*").cast("double").alias("edges"))
    out = d.join(e).unpivot([], ["nodes", "edges", "avg_degree", "max_degree", "min_degree"], "figure", "value")  # one row each
    if "labels" in vertices.columns:
        out = out.unionByName(_most_frequent(vertices.select(F.explode("labels").alias("x")), "label:"))
    if "type" in edges.columns:
        out = out.unionByName(_most_frequent(edges.select(F.col("type").alias("x")), "type:"))
    return out


def _most_frequent(df: DataFrame, kind: str, k: int = 20) -> DataFrame:
    top = df.groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(k)
    return top.select(F.concat(F.lit(kind), F.col("x").cast("string")).alias("figure"), F.col("n").cast("double").alias("value"))


def betweenness(starts: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """(id, score): shortest paths from the given starts that run through a node, by Brandes' sums.

    Each task searches from its starts through the whole graph (adjacency), and only
    the nodes' scores are shuffled.  Of graphs that no task holds, all starts go level by
    level at once: a first pass counts the shortest paths to each node, a second one,
    from the farthest level back, adds up how much of them each node carries.  With all
    nodes as starts the score is exact (each pair of ends counts in both directions);
    with a sample of them it estimates the exact one times starts / nodes.
    """
    scratch = Scratch(starts.sparkSession, "betweenness")
    both = direction == "both"
    ends = scratch.keep(_simple(edges).toDF("src", "dst") if both else _directed(edges, direction).filter("src <> dst"))
    held = adjacency.written(scratch, ends)
    if held:
        out = adjacency.carried(starts, *held, ends.schema["src"].dataType, both)
    else:
        out = _joined_betweenness(scratch, starts, _directed(ends, "both") if both else ends)
    every = _directed(edges, "both").select(F.col("src").alias("id")).unionByName(starts.select("id")).distinct()
    return every.join(out.groupBy("id").agg(F.sum("score").alias("score")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _joined_betweenness(scratch: Scratch, starts: DataFrame, steps: DataFrame) -> DataFrame:
    steps = scratch.keep(steps)
    level = scratch.keep(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("paths", F.lit(1.0)))
    seen, levels = level.select("start", "id"), [level]
    while True:
        reached = level.withColumnRenamed("id", "src").join(steps, "src").groupBy("start", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = scratch.keep(reached.join(seen, ["start", "id"], "left_anti").select("start", "id", "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = scratch.keep(seen.unionByName(level.select("start", "id")))
    carried, out = None, None
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:])):
        below = lower.withColumn("carried", F.lit(0.0)) if carried is None else lower.join(carried, ["start", "id"], "left").withColumn("carried", F.coalesce("carried", F.lit(0.0)))
        below = below.select("start", F.col("id").alias("dst"), F.col("paths").alias("to_there"), "carried")
        via = upper.withColumnRenamed("id", "src").join(steps, "src").join(below, ["start", "dst"])
        carried = scratch.keep(via.groupBy("start", F.col("src").alias("id")).agg(F.sum(F.col("paths") / F.col("to_there") * (1 + F.col("carried"))).alias("carried")))
        through = carried.filter("id <> start").groupBy("id").agg(F.sum("carried").alias("score"))
        out = through if out is None else out.unionByName(through)
    return starts.select("id", F.lit(0.0).alias("score")) if out is None else out
