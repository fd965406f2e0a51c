"""Ordered scans in which one group is many tasks' work.

``stretches`` sorts a table by group and order over range partitions and writes it,
so each group lies in one or more stretches (group, partition), whole tasks' work
each.  What a row needs from other stretches is little: the nearest few rows before
or after its own, and the sums of all stretches before.  Only the first group of a
partition goes on from an earlier one, so these pieces are at most one row a
partition, and are broadcast to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.plans.shared import Scratch

STRETCH = "stretch"
#: Groups whose totals are broadcast, at most.
BROADCAST_GROUPS = 200_000


def stretches(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with the number of each row's range partition, written once.  order must tell the rows of a group apart."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *group, *order).withColumn(STRETCH, F.spark_partition_id())
    return Scratch(spark, "ordered").keep(placed)


def _inside(group: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*group, STRETCH).orderBy(*order)


def _across(group: list[str]) -> Window:
    """Over one row a stretch."""
    return Window.partitionBy(*group).orderBy(STRETCH)


def _carried(rows: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the columns of carry, of which there is at most one row a partition."""
    names = [*group, STRETCH]
    renamed = carry.withColumnsRenamed({c: f"_{c}" for c in names})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return rows.join(F.broadcast(renamed), same, "left").drop(*[f"_{c}" for c in names])


def neighbours(rows: DataFrame, group: list[str], order: list[str], columns: list[str], back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows of stretches() with prev1, prev2, ... and next1, ...: structs of the columns of the rows before and after in their group, or null."""
    out, inside, value = rows, _inside(group, order), F.struct(*columns)
    for n, name, step, last_first in ((back, "prev", F.lag, True), (ahead, "next", F.lead, False)):
        if not n:
            continue
        place = "_from_start" if last_first else "_from_end"
        turned = inside if last_first else Window.partitionBy(*group, STRETCH).orderBy(*[F.desc(c) for c in order])
        at_edge = Window.partitionBy(*group, STRETCH).orderBy(*[F.desc(c) for c in order]) if last_first else inside
        # the n rows of each stretch next to the other one, nearest first
        edge = rows.withColumn("_k", F.row_number().over(at_edge)).filter(F.col("_k") <= n)
        edge = edge.groupBy(*group, STRETCH).agg(F.array_sort(F.collect_list(F.struct("_k", value.alias("v")))).alias("edge"))
        # a stretch has a row at least, so n of them have enough
        frame = _across(group).rowsBetween(-n, -1) if last_first else _across(group).rowsBetween(1, n)
        parts = F.collect_list("edge").over(frame)
        near = F.slice(F.flatten(F.reverse(parts) if last_first else parts), 1, n)
        carry = edge.select(*group, STRETCH, F.transform(near, lambda x: x["v"]).alias("_near")).filter(F.size("_near") > 0)
        out = _carried(out, carry, group).withColumn(place, F.row_number().over(turned))
        for k in range(1, n + 1):
            beyond = F.get("_near", F.lit(k) - F.col(place))
            out = out.withColumn(f"{name}{k}", F.when(F.col(place) > k, step(value, k).over(inside)).otherwise(beyond))
        out = out.drop("_near", place)
    return out


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Rows of stretches() with the sum of value over the rows before them in their group (0 for the first)."""
    valued = rows.withColumn("_v", value)
    sums = valued.groupBy(*group, STRETCH).agg(F.sum("_v").alias("_sum"))
    before = F.sum("_sum").over(_across(group).rowsBetween(Window.unboundedPreceding, -1))
    carry = sums.select(*group, STRETCH, before.alias("_before")).filter("_before is not null")
    inside = F.sum("_v").over(_inside(group, order).rowsBetween(Window.unboundedPreceding, -1))
    out = _carried(valued, carry, group)
    return out.withColumn(name, F.coalesce(inside, F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_v", "_before")


def with_totals(rows: DataFrame, group: list[str], **totals: Column) -> DataFrame:
    """Rows with aggregates of their whole group, worked out by partial sums; broadcast for up to BROADCAST_GROUPS groups."""
    found = Scratch(rows.sparkSession, "totals").keep(rows.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()]))
    renamed = found.withColumnsRenamed({c: f"_{c}" for c in group})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    return rows.join(F.broadcast(renamed) if found.count() <= BROADCAST_GROUPS else renamed, same).drop(*[f"_{c}" for c in group])
