"""Stateful streams against plain versions: rows in any order and in any number of batches, silence, and state that goes."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import search
from loomtext.plans import registry
from loomtext.streaming import stateful as Z
from loomtext.streaming import streams as S

START = datetime(2024, 5, 1)


def stream_of(spark, batches, schema, folder):
    """One file a batch, read one at a time in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/t{k:03d}.parquet")
    return S.message_stream(spark, f"{folder}/t", schema, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


# node health

BEATS = "node string, ts timestamp, tasks int, errors int"


def changes(beats, grace, watermark):
    out = []
    for node in {n for n, _ in beats}:
        times = sorted(t for n, t in beats if n == node)
        stretches = [[times[0], times[0]]]
        for t in times[1:]:
            if t - stretches[-1][1] > grace:
                stretches.append([t, t])
            stretches[-1][1] = t
        for first, last in stretches:
            out += [(node, first, True)] * (first < watermark) + [(node, last + grace, False)] * (last + grace < watermark)
    return sorted(out)


def test_a_silent_node_gives_a_row(spark, tmp_path):
    """Only other nodes beat on: the silent one is reported at 3 intervals, by its timer."""
    batches = [[("a", at(0), 1, 0), ("b", at(0), 1, 0)], *[[("b", at(60 * k), 1, 1)] for k in range(1, 9)]]
    got = sorted(((r["node"], (r["ts"] - START).total_seconds(), r["healthy"]) for r in S.run_available(Z.node_changes(stream_of(spark, batches, BEATS, tmp_path), 60)).collect()), key=str)
    assert got == [("a", 0.0, True), ("a", 180.0, False), ("b", 0.0, True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_do_not_depend_on_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    beats = [(rng.choice("abc"), 10 * k + rng.randrange(9)) for k in range(160) if rng.random() < 0.4]
    delay = 40
    shuffled = sorted(beats, key=lambda b: b[1] + rng.uniform(0, delay / 2))  # out of order within the delay
    size = rng.choice([3, 11])
    batches = [[(n, at(t), 1, 0) for n, t in shuffled[k : k + size]] for k in range(0, len(shuffled), size)]
    found = S.run_available(Z.node_changes(stream_of(spark, batches, BEATS, tmp_path), 15, f"{delay} seconds")).collect()
    got = sorted((r["node"], int((r["ts"] - START).total_seconds()), r["healthy"]) for r in found)
    assert got == changes(beats, 45, max(t for _, t in beats) - delay)


def test_one_batch_of_all_beats(spark, tmp_path):
    beats = [("n", 7 * k) for k in range(300)] + [("n", 5000 + k) for k in range(5)] + [("m", 9000)]
    rows = [(n, at(t), 1, 0) for n, t in beats]
    random.Random(3).shuffle(rows)
    got = sorted((r["node"], int((r["ts"] - START).total_seconds()), r["healthy"]) for r in S.run_available(Z.node_changes(stream_of(spark, [rows], BEATS, tmp_path), 10, "5 seconds")).collect())
    assert got == changes(beats, 30, 9000 - 5) and len(got) == 4


@pytest.mark.parametrize("name", ["stream_node_health", "stream_health_alerts"])
def test_health_rounds_seconds_as_its_sql_does(spark, tmp_path, name):
    """Ages about 12 hours, with the newest beat and the last ones on both sides of half a second."""
    rows = [(k, datetime(2024, 5, 1, 12, 0, 0, 700_000) - timedelta(seconds=43199 + k // 4, microseconds=[0, 300_000, 600_000, 900_000][k % 4]), k, "view", 1.0, "{}") for k in range(12)]
    rows.append((99, datetime(2024, 5, 1, 12, 0, 0, 700_000), 99, "error", 1.0, "{}"))
    spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


# working memory

MESSAGES = "user_id long, cube_id string, ts timestamp, pos long, is_query boolean, text string"


def test_working_memory_equals_the_batch_merge(spark, tmp_path):
    """At each query event: what merge_working_memory gives for what was held and the candidates since."""
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice(["x", "y"]), 5 * k, k, rng.random() < 0.25, f"t{rng.randrange(12)}" if rng.random() < 0.95 else None) for k in range(160)]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 30))
    batches = [[(u, c, at(t), p, q, x) for u, c, t, p, q, x in shuffled[k : k + 13]] for k in range(0, len(shuffled), 13)]
    found = S.run_available(Z.working_memory_events(stream_of(spark, batches, MESSAGES, tmp_path), 4, 2, "1 day", "60 seconds")).collect()
    got = {(r["user_id"], r["cube_id"], r["pos"]): list(r["texts"]) for r in found}
    limit = max(r[2] for r in rows) - 60
    held, waiting, want = {}, {}, {}
    for u, c, t, p, q, x in sorted(rows, key=lambda r: (r[2], r[3])):
        if q:
            texts = held.get((u, c), [])
            for new in waiting.pop((u, c), []):
                if new not in texts and len(texts) < 6:
                    texts = [*texts, new]
            held[u, c] = texts
            if t < limit:
                want[u, c, p] = texts
        elif x is not None:
            waiting.setdefault((u, c), []).append(x)
    assert got == want and len(want) > 20
    # one of them by the batch operator
    (u, c, p), texts = max(want.items(), key=lambda w: len(w[1]))
    before = [(u, r[3], r[5]) for r in rows if r[:2] == (u, c) and r[3] < p and not r[4] and r[5] is not None]
    merged = search.merge_working_memory(spark.createDataFrame(before[:1], "user_id long, pos long, text string"), spark.createDataFrame(before[1:], "user_id long, pos long, text string"), 4, 2)
    assert [r["text"] for r in merged.orderBy("place").collect()] == texts


def test_idle_memory_goes(spark, tmp_path):
    """After the idle time nothing is held; a later query finds only what came after."""
    batches = [[(1, "x", at(0), 1, False, "old"), (1, "x", at(10), 2, True, None)], [(2, "x", at(5000), 3, False, "other")], [(1, "x", at(5100), 4, False, "new"), (1, "x", at(5101), 5, True, None)], [(2, "x", at(9000), 6, False, "end")], [(2, "x", at(9001), 7, False, "end")]]
    found = S.run_available(Z.working_memory_events(stream_of(spark, batches, MESSAGES, tmp_path), 4, 2, "20 minutes", "10 seconds")).collect()
    assert sorted((r["pos"], list(r["texts"])) for r in found) == [(2, ["old"]), (5, ["new"])]


def test_queries_without_candidates(spark, tmp_path):
    batches = [[(1, "x", at(0), 1, True, None), (1, None, at(1), 2, True, "ignored"), (None, "x", at(2), 3, False, "a"), (None, "x", at(3), 4, True, None)], [(9, "z", at(900), 9, False, "t")]]
    found = S.run_available(Z.working_memory_events(stream_of(spark, batches, MESSAGES, tmp_path), 1, 1, "1 day", "10 seconds")).collect()
    assert sorted((r["pos"], list(r["texts"])) for r in found) == [(1, []), (2, []), (4, ["a"])]
    assert all(isinstance(r["user_id"], int) or r["user_id"] is None for r in found)


def test_state_is_one_row_a_key(spark, tmp_path):
    """However many rows a key has in a batch, the result is that of one row at a time."""
    rows = [(1, "x", at(k), k, k % 500 == 499, f"t{k % 40}") for k in range(6000)]
    found = S.run_available(Z.working_memory_events(stream_of(spark, [rows, [(2, "x", at(90_000), 1, False, "z")]], MESSAGES, tmp_path), 8, 2, "1 day", "10 seconds"))
    assert found.count() == 12 and found.agg(F.min(F.size("texts")), F.max(F.size("texts"))).first() == (10, 10)


# late rows, batches of texts, throttling


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    batches = [[(1, at(0)), (2, at(90_000))], [(3, at(100))], [(4, at(100)), (5, at(5000)), (2, at(90_000))], [(6, at(3600)), (7, at(3601))], [(8, at(200_000))]]
    late = {4, 6}  # a day and more behind the newest of all batches but the last before theirs
    kept, dropped = S.run_counted(S.retention(stream_of(spark, batches, schema, tmp_path), "event_id"))
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3, 5, 7, 8] and dropped == len(late)


def test_embedding_sees_batches_of_a_size(spark, tmp_path):
    from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

    def embed(texts):  # tells each text how many it came with
        return [[float(len(texts)), float(len(t))] for t in texts]

    rows = [(k, None if k % 10 == 3 else "x" * (k % 7)) for k in range(103)]
    table = spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("text", StringType())])).coalesce(1)
    out = S.embed_in_batches(table, embed, 20)
    assert out.schema["vector"].dataType == ArrayType(FloatType())
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert all(got[k] is None if t is None else got[k][1] == len(t) for k, t in rows)
    assert {got[k][0] for k, t in rows if t is not None and k < 100} == {18.0} and {got[k][0] for k in (100, 101, 102)} == {3.0}
    for k in range(3):
        table.filter(F.col("id") % 3 == k).write.parquet(f"{tmp_path}/texts{k}.parquet")
    found = S.run_available(S.micro_batch_embed(spark, f"{tmp_path}/texts", "id long, text string", embed, 5, 1))
    assert found.count() == 103 and found.filter("vector is null").count() == sum(t is None for _, t in rows)


def test_throttle_over_batches_and_frames(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    times = sorted(rng.sample(range(20_000), 1500))
    batches = [[("k", at(t)) for t in rng.sample(times[k : k + 300], len(times[k : k + 300]))] for k in range(0, 1500, 300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = S.run_available(S.throttle(stream_of(spark, batches, "name string, ts timestamp", tmp_path), "name", 300)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], None
    for t in times:
        if last is None or t - last >= 300:
            want.append(t)
            last = t
    assert sorted(int((r["ts"] - START).total_seconds()) for r in found) == want


class _State:
    """One key's state with a watermark, as a stream gives it."""

    def __init__(self, now, held=None, out=False):
        self.now, self.get, self.hasTimedOut, self.wakes = now, held, out, None

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, held):
        self.get = held

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, at):
        assert at >= self.now
        self.wakes = at


def test_all_that_is_due_is_one_call():
    """A hundred queries of a key (a timer and calls to the store each before) are answered in one call, in order."""
    rows = pd.DataFrame({"is_query": [k % 2 == 1 for k in range(200)], "text": [f"t{k // 20}" for k in range(200)], "pos": range(200), "ms": [1000 + k for k in range(200)]})
    step, state = Z._working_memory(5, 10_000), _State(0)
    assert list(step((1, "x"), iter([rows]), state)) == [] and state.wakes == 1001
    out = list(step((1, "x"), iter([]), _State(1190, state.get, True)))
    assert len(out) == 1 and out[0]["pos"].tolist() == list(range(1, 190, 2))
    assert out[0]["texts"].tolist()[-1] == [f"t{k}" for k in range(5)]


def test_a_stretch_is_told_once_and_ends_once():
    step, state = Z._node_health(100), _State(0)
    beats = pd.DataFrame({"ms": [1050, 1000, 1090, 5000], "tasks": [1] * 4, "errors": [0] * 4})
    assert list(step(("n",), iter([beats]), state)) == [] and state.wakes == 1000
    out = list(step(("n",), iter([]), _State(1191, state.get, True)))
    assert out[0][["ms", "healthy"]].values.tolist() == [[1000, True], [1190, False]] and out[0]["tasks"].tolist() == [4, 4]
