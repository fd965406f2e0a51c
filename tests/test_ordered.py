"""Ordered scans over stretches against plain loops: hot groups, stretches of one row, many groups."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtext.operators import analyze as A
from loomtext.operators import ordered as O

ROWS = "g string, k int, v int"


def fixture(kind):
    rng = random.Random(5)
    if kind == "hot":  # one group has 90 % of the rows
        rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), k, rng.randrange(50)) for k in range(3000)]
    elif kind == "small":
        rows = [(f"g{rng.randrange(150)}", k, rng.randrange(9)) for k in range(400)]
    else:
        rows = [(rng.choice(["a", None]), k, None if k % 3 == 0 else k) for k in range(7)]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    groups = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((k, v))
    return groups


@pytest.mark.parametrize("kind,parts", [("hot", 16), ("small", 7), ("tiny", 20), ("hot", 1)])
def test_neighbours_and_sums(spark, kind, parts):
    rows = fixture(kind)
    table = O.stretches(spark.createDataFrame(rows, ROWS), ["g"], ["k"], parts)
    if kind == "hot" and parts > 1:
        sizes = table.filter("g = 'hot'").groupBy(O.STRETCH).count().collect()
        assert len(sizes) >= 12 and max(r["count"] for r in sizes) < 600  # a hot group is many tasks' work
    found = O.neighbours(table, ["g"], ["k"], ["k", "v"], back=2, ahead=3)
    found = O.running_sum(found, ["g"], ["k"], F.coalesce("v", F.lit(0)), "before")
    found = O.with_totals(found, ["g"], n=F.count("*"), most=F.max("v"))
    got = {}
    for r in found.collect():
        near = [r[c] and tuple(r[c]) for c in ("prev1", "prev2", "next1", "next2", "next3")]
        got[r["g"], r["k"]] = (*near, r["before"], r["n"], r["most"])
    want = {}
    for g, held in in_order(rows).items():
        at = lambda i, held=held: held[i] if 0 <= i < len(held) else None
        for i, (k, _) in enumerate(held):
            want[g, k] = (at(i - 1), at(i - 2), at(i + 1), at(i + 2), at(i + 3), sum(v or 0 for _, v in held[:i]), len(held), max((v for _, v in held if v is not None), default=None))
    assert got == want


def test_empty_tables(spark):
    empty = O.stretches(spark.createDataFrame([], ROWS), ["g"], ["k"])
    assert O.running_sum(O.neighbours(empty, ["g"], ["k"], ["v"], 1, 1), ["g"], ["k"], F.col("v"), "s").count() == 0
    none = spark.createDataFrame([], "group string, id int, ts timestamp, text string")
    assert A.related_runs(none).count() == A.regular_creation(none).count() == A.time_gap_anomalies(none).count() == 0


def test_analyses_of_a_hot_group(spark):
    """Gaps, runs and evictions of a group with nearly all rows, over the partitions of the session."""
    rng = random.Random(6)
    start, t = datetime(2024, 1, 1), 0.0
    rows = []
    for k in range(800):
        t += rng.choice([1, 1, 1, 2, 60])
        rows.append(("hot" if k % 40 else "other", k, start + timedelta(hours=t), f"{rng.choice('ab')} {rng.choice('cd')} x"))
    table = spark.createDataFrame(rows, "group string, id int, ts timestamp, text string").repartition(4)
    hot = [r for r in rows if r[0] == "hot"]
    best = run = 1
    for a, b in zip(hot, hot[1:]):
        x, y = set(a[3].split()), set(b[3].split())
        run = run + 1 if b[2] - a[2] < timedelta(hours=24) and len(x & y) / len(x | y) > 0.5 else 1
        best = max(best, run)
    assert {r["group"]: r["n"] for r in A.related_runs(table).collect()}.get("hot") == best
    gaps = [(b[2] - a[2]).total_seconds() / 3600 for a, b in zip(hot, hot[1:])]
    mean = sum(gaps) / len(gaps)
    deviation = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    got = {r["id"] for r in A.time_gap_anomalies(table).filter("group = 'hot'").collect()}
    assert got == {b[1] for b, g in zip(hot[1:], gaps) if g > mean + 2 * deviation} and got
    sample = (sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) ** 0.5
    regular = {r["group"]: r["regularity"] for r in A.regular_creation(table).collect()}
    assert abs(regular["hot"] - sum(abs(g - mean) <= sample for g in gaps) / len(gaps)) < 1e-9
    sizes = spark.createDataFrame([("o" if k % 9 else "p", k, start + timedelta(hours=k), k % 5 + 1) for k in range(300)], "owner string, id int, accessed timestamp, size int")
    freed, want = {}, set()
    excess = {o: sum(k % 5 + 1 for k in range(300) if (k % 9 != 0) == (o == "o")) - 100 for o in "op"}
    for k in range(300):
        o = "o" if k % 9 else "p"
        if freed.get(o, 0) < excess[o]:
            want.add(k)
        freed[o] = freed.get(o, 0) + k % 5 + 1
    assert {r["id"] for r in A.evict_lru(sizes, 100).collect()} == want
