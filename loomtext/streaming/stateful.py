"""Streams with state and timers of their own: working memory by event, node health by beats.

Both run on ``applyInPandasWithState``: a key's state comes and goes with its rows,
many keys to an Arrow batch, so a key costs no calls to the store of its own.
State lives in RocksDB beside the executors, is saved with each batch, and goes by
event-time timers: one a key, at the next thing that is due; all that is due by the
watermark is done in one call.  Rows of a group are taken a data frame at a time,
so a micro-batch may hold any number of rows of one key, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _wake(state: GroupState, due: int) -> None:
    """Calls again once the watermark is at due or past it (Spark's timeouts need it past)."""
    state.setTimeoutTimestamp(max(due - 1, 1))


#: The texts held, candidates by text with their first place, the queries that wait for the watermark, and when all goes.
_MEMORY = "held array<string>, texts array<string>, ms array<long>, pos array<long>, asked array<long>, asked_ms array<long>, goes long"


def _answers(held: list, candidates: dict, queries: dict, upto: int, cap: int) -> list[tuple]:
    """The queries up to a time, in order, each with what is held after the candidates before it."""
    due = sorted((at, pos) for pos, at in queries.items() if at <= upto)
    waiting = sorted((at, pos, text) for text, (at, pos) in candidates.items()) if due else []
    out, k = [], 0
    for at, pos in due:
        while k < len(waiting) and waiting[k][:2] < (at, pos):
            text = waiting[k][2]
            if len(held) < cap and text not in held:
                held.append(text)
            del candidates[text]
            k += 1
        out.append((pos, list(held)))
        del queries[pos]
    return out


def _working_memory(cap: int, idle_ms: int):
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, answers = state.getCurrentWatermarkMs(), []
        held, candidates, queries, goes = [], {}, {}, None
        if state.exists:
            held, texts, ms, pos, asked, asked_ms, goes = state.get
            held, candidates, queries = list(held), dict(zip(texts, zip(ms, pos))), dict(zip(asked, asked_ms))
            if goes <= now:  # before these rows
                answers += _answers(held, candidates, queries, goes, cap)
                held, candidates, queries, goes = [], {}, {}, None
        if not state.hasTimedOut:
            for part in rows:
                for is_query, text, pos, at in zip(part["is_query"], part["text"], part["pos"].tolist(), part["ms"].tolist()):
                    if is_query:
                        queries[pos] = at
                    elif text is not None and (text not in candidates or (at, pos) < candidates[text]):
                        candidates[text] = (at, pos)
                goes = max(goes or 0, int(part["ms"].max()) + idle_ms)
        answers += _answers(held, candidates, queries, now - 1, cap)
        if goes is None or goes <= now:
            if state.exists:
                state.remove()
        else:
            places = list(candidates.values())
            state.update((held, list(candidates), [a for a, _ in places], [p for _, p in places], list(queries), list(queries.values()), goes))
            _wake(state, min([goes, *(at + 1 for at in queries.values())]))
        if answers:
            n = len(answers)
            yield pd.DataFrame({"user_id": [key[0]] * n, "cube_id": [key[1]] * n, "pos": [p for p, _ in answers], "texts": [t for _, t in answers]})

    return step


def working_memory_events(stream: DataFrame, top: int, extra: int, idle: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(user_id, cube_id, pos, texts): the working memory of a user in a cube at each query event.

    stream: user_id, cube_id, ts, pos (unique within user and cube), is_query, text.
    Rows count in the order of (ts, pos), however they arrive: a query is answered
    when the watermark, delay behind the newest event, has passed it.  At a query
    the candidates before it are merged behind the texts held, each text once, cut
    at top + extra, as ``search.merge_working_memory`` does.  What a user holds in a
    cube goes when the watermark is idle past the last event that has come for it.  A row without a
    text is no candidate.
    """
    use_store(stream.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    users, cubes = (stream.schema[c].dataType.simpleString() for c in ("user_id", "cube_id"))
    timed = stream.select("user_id", "cube_id", "ts", F.col("pos").cast("long").alias("pos"), "is_query", "text", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).filter("ts is not null").withWatermark("ts", delay)
    schema = f"user_id {users}, cube_id {cubes}, pos long, texts array<string>"
    return timed.groupBy("user_id", "cube_id").applyInPandasWithState(_working_memory(top + extra, idle_ms), schema, _MEMORY, "append", GroupStateTimeout.EventTimeTimeout)


#: The stretches in which beats follow each other closely enough, by first beat, whether their start has been told, and the totals.
_STRETCHES = "firsts array<long>, lasts array<long>, told array<boolean>, tasks long, errors long"


def _node_health(grace: int):
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held, tasks, errors = state.getCurrentWatermarkMs(), [], 0, 0
        if state.exists:
            firsts, lasts, told, tasks, errors = state.get
            held = list(zip(firsts, lasts, told))
        if not state.hasTimedOut:
            for part in rows:  # a data frame becomes stretches, these are joined with those held
                ms = np.sort(part["ms"].to_numpy())
                cut = np.flatnonzero(np.diff(ms) > grace) + 1
                held += [(a, b, False) for a, b in zip(ms[np.append(0, cut)].tolist(), ms[np.append(cut, len(ms)) - 1].tolist())]
                tasks, errors = tasks + int(part["tasks"].sum()), errors + int(part["errors"].sum())
                joined: list[tuple] = []
                for first, last, told in sorted(held):
                    if joined and first - joined[-1][1] <= grace:
                        joined[-1] = (joined[-1][0], max(joined[-1][1], last), joined[-1][2] or told)
                    else:
                        joined.append((first, last, told))
                held = joined
        out, left = [], []
        for first, last, told in held:
            if not told and first + 1 <= now:
                out.append((first, True))
                told = True
            if last + grace + 1 <= now:
                out.append((last + grace, False))
            else:
                left.append((first, last, told))
        state.update(([x[0] for x in left], [x[1] for x in left], [x[2] for x in left], tasks, errors))
        if left:
            _wake(state, min(last + grace + 1 if told else first + 1 for first, last, told in left))
        if out:
            yield pd.DataFrame({"node": [key[0]] * len(out), "ms": [t for t, _ in out], "healthy": [h for _, h in out], "tasks": tasks, "errors": errors})

    return step


def node_changes(beats: DataFrame, interval: int = 60, delay: str = "1 minute") -> DataFrame:
    """(node, ts, healthy, tasks, errors): when a node comes up, and when 3 intervals (seconds) have passed without a beat.

    beats: node, ts, tasks, errors.  A node that is silent gives its row by a timer,
    as soon as the watermark, delay behind the newest beat of any node, is past it;
    beats may arrive in any order within the delay.  tasks and errors are the
    node's sums so far.  A node's stretches leave the state when they have ended.
    """
    use_store(beats.sparkSession)
    node = beats.schema["node"].dataType.simpleString()
    timed = beats.select("node", "ts", F.col("tasks").cast("long").alias("tasks"), F.col("errors").cast("long").alias("errors"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).filter("ts is not null").withWatermark("ts", delay)
    schema = f"node {node}, ms long, healthy boolean, tasks long, errors long"
    changes = timed.groupBy("node").applyInPandasWithState(_node_health(3000 * interval), schema, _STRETCHES, "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("node", F.timestamp_millis("ms").alias("ts"), "healthy", "tasks", "errors")
