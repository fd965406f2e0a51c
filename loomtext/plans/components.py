"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; component = its smallest node.

    Every round links each node's larger neighbours, then its smaller ones, to
    the smallest node it knows (large star, small star); rounds grow with the
    logarithm of the longest path.  Each half round is a grouped minimum and an
    equi-join, so a node with very many edges costs no single task: minima are
    taken map-side first, and the adaptive planner splits the join.  Edges are
    written to the shared folder between rounds.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src")
        small = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()
        after = scratch.keep(small)
        scratch.drop(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
