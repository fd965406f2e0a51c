"""Structured Streaming jobs over message, event and metric streams.

Each function takes a streaming (or batch) DataFrame and returns one; sinks
are started by ``run_available`` (all data there is, then stop) or by the
caller.  Event time is the column ``ts``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from loomtext.functions import text as T
from loomtext.plans.shared import new_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
MESSAGES = "conv_id long, turn long, role string, text string"


def message_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream, in the order they appear."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    return stream.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


class LateRows(StreamingQueryListener):
    """Counts, by query id, the rows that stateful steps have dropped as later than the watermark.

    Add it to ``spark.streams`` before the queries start; ``of`` waits for the end
    of a query, so that all its progress has been told.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.changed = threading.Condition()
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self.changed:
            n = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
            self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.id))
            self.changed.notify_all()

    def of(self, query: str, seconds: float = 60) -> int:
        with self.changed:
            if not self.changed.wait_for(lambda: query in self.ended, seconds):
                raise TimeoutError(f"the end of query {query} has not been told")
            return self.dropped.get(query, 0)


def run_counted(stream: DataFrame) -> tuple[DataFrame, int]:
    """Runs an append-mode stream over what is there: its result, and how many rows came too late for it."""
    spark, late = stream.sparkSession, LateRows()
    out = new_folder(spark, "stream")
    spark.streams.addListener(late)
    try:
        # a repeated batch overwrites its own folder
        writer = stream.writeStream.option("checkpointLocation", new_folder(spark, "stream-state")).trigger(availableNow=True)
        query = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()
        query.awaitTermination()
        dropped = late.of(str(query.id))
    finally:
        spark.streams.removeListener(late)
    return spark.read.schema(stream.schema).parquet(out).select(stream.columns), dropped


def run_available(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there and gives its result as a table in the shared folder.

    In complete mode the last batch is the result; in append mode all batches;
    in update mode the last row of each of the given keys.
    """
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, "stream"), new_folder(spark, "stream-state")

    def write(rows: DataFrame, number: int) -> None:
        # overwriting one folder a batch makes a repeated batch harmless
        rows.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(batch or write).start().awaitTermination()
    if mode == "update" and keys:
        table = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
        last = table.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last"))
        return last.select("last.*")
    return spark.read.schema(stream.schema).parquet(out).select(stream.columns)


def dedupe_messages(stream: DataFrame, key: str = "item_id", delay: str = "1 day") -> DataFrame:
    """Redelivered messages go: one row per key within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def route_by_label(stream: DataFrame, label: str, handlers: dict[str, Callable[[DataFrame, int], None]], default: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each label's rows to its handler."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        for name, handler in handlers.items():
            handler(rows.filter(F.col(label) == name), number)
        default(rows.filter(~F.coalesce(F.col(label).isin(*handlers), F.lit(False))), number)
        rows.unpersist()

    return batch


def retention(stream: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Each key once, without rows that are older than the watermark by which the batch before was run.

    The watermark is so many hours behind the newest event; a batch is judged by
    the one before its own, as Spark does for all steps of a query.  Late rows are
    dropped, and counted: run it by ``run_counted``, or with a ``LateRows``
    listener.  State is one entry a key, which goes after the same time.
    """
    return stream.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark([key])


def metric_windows(stream: DataFrame, size: str, slide: str | None = None, *by: str, delay: str = "1 hour") -> DataFrame:
    """Count, mean and maximum of value per window (and group).

    Windows leave the state once the watermark, delay behind the newest event,
    has passed them: use append or update mode.
    """
    stream = stream.withWatermark("ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")).select(F.col("w.start").alias("start"), *by, "n", "mean", "max")


def alerts(stream: DataFrame, size: str, rate: float = 0.1, least: int = 1, delay: str = "1 hour") -> DataFrame:
    """Windows in which more than rate of the events are errors; in append mode, as they close behind the watermark."""
    stream = stream.withWatermark("ts", delay)
    failed = F.count_if(F.col("event_type") == "error")
    g = stream.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), failed.alias("errors"))
    return g.select(F.col("w.start").alias("start"), "n", "errors", (F.col("errors") / F.col("n")).alias("rate")).filter((F.col("rate") > rate) & (F.col("n") >= least))


def sessions(stream: DataFrame, gap: str = "24 hours", by: str = "user_id", delay: str = "1 hour") -> DataFrame:
    """Sessions end after a gap without activity; in append mode, as they close behind the watermark."""
    stream = stream.withWatermark("ts", delay)
    g = stream.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def message_memories(stream: DataFrame) -> DataFrame:
    """Messages as memories, with their role and the keyword rule that fits."""
    m = T.extract_memory(F.col("text"))
    return stream.select("conv_id", "turn", "role", F.octet_length("text").alias("bytes"), F.coalesce(m["category"], F.lit("none")).alias("category"))


def latest_values(stream: DataFrame) -> DataFrame:
    """(key, revision, value): the newest revision of each key; in update mode a batch gives the keys it changed."""
    return stream.groupBy("key").agg(F.max("revision").alias("revision"), F.max_by("value", "revision").alias("value"))


def working_memory(stream: DataFrame, top: int, extra: int, idle_hours: int | None = None) -> DataFrame:
    """(user_id, size): each user's working memory, unique texts in order of arrival, cut at top + extra.

    With idle_hours (and a column ts) a memory goes when the watermark is so
    far past its last text; else it stays, at most top + extra texts a user.
    """
    cap = top + extra

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        # a micro-batch brings a group in several data frames: of all their new texts the first ones by pos are kept, no more than fit
        known, first, newest = set(held), {}, 0
        for rows in batches:
            for text, pos in zip(rows["text"], rows["pos"]):
                if text not in known:
                    first[text] = min(pos, first.get(text, pos))
            first = dict(sorted(first.items(), key=lambda x: x[1])[: cap - len(held)])
            if idle_hours is not None:
                newest = max(newest, int(rows["ts"].max().value // 10**6))
        held += first
        state.update((held,))
        if idle_hours is not None:
            state.setTimeoutTimestamp(max(newest + idle_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "size": [len(held)]})

    timed = stream.select("user_id", "pos", "text") if idle_hours is None else stream.select("user_id", "pos", "text", "ts").withWatermark("ts", "1 hour")
    timeout = GroupStateTimeout.NoTimeout if idle_hours is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("user_id").applyInPandasWithState(keep, "user_id long, size long", "held array<string>", "update", timeout)


def throttle(stream: DataFrame, key: str, seconds: int, keep_for: str = "1 hour") -> DataFrame:
    """(key, ts): of the events of each key those at least so many seconds after the last one that was let through.

    A refresh at most every five minutes, or alerts with a cooldown.  State is
    one time a key, which goes once the watermark (keep_for behind the newest
    event) has passed the cooldown.
    """

    def pass_on(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # of a micro-batch's rows only the times are held, 8 bytes each
        times = np.sort(np.concatenate([b["ts"].to_numpy("datetime64[us]").astype(np.int64) for b in batches]))
        passed, k = [], 0 if last is None else int(np.searchsorted(times, last + seconds * 1_000_000))
        while k < len(times):  # a search for each time that passes
            last = int(times[k])
            passed.append(last)
            k = max(k + 1, int(np.searchsorted(times, last + seconds * 1_000_000)))
        if last is None:
            return
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(passed), "ts": np.array(passed, "datetime64[us]")})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.select(key, "ts").withWatermark("ts", keep_for)
    return timed.groupBy(key).applyInPandasWithState(pass_on, f"`{key}` {kind}, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def node_health(stream: DataFrame) -> DataFrame:
    """Latest beat of each node as a stream in complete mode; give its batches to health_of()."""
    return stream.groupBy("node").agg(F.max("ts").alias("ts"), F.sum("tasks").alias("tasks"), F.sum("errors").alias("errors"))


def health_of(beats: DataFrame, interval: int = 60) -> DataFrame:
    """(node, healthy, tasks, errors, error_rate) of one table of latest beats, as of its newest beat."""
    now = beats.agg(F.max("ts").alias("now"))
    joined = beats.join(F.broadcast(now))  # one row
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return joined.select("node", (age <= 3 * interval).alias("healthy"), "tasks", "errors", F.coalesce(F.try_divide(100 * F.col("errors"), F.col("tasks")), F.lit(0.0)).alias("error_rate"))


def health_alerts(health: DataFrame, rate: float = 10.0, unhealthy: int = 2) -> DataFrame:
    """(alert, value): nodes above an error rate, more than so many unhealthy nodes, and the whole cluster above the rate."""
    nodes = health.filter(F.col("error_rate") > rate).select(F.concat(F.lit("node "), F.col("node").cast("string")).alias("alert"), F.col("error_rate").alias("value"))
    whole = health.agg(F.count_if(~F.col("healthy")).cast("double").alias("down"), F.coalesce(F.try_divide(100.0 * F.sum("errors"), F.sum("tasks")), F.lit(0.0)).alias("rate"))
    return nodes.unionByName(whole.filter(F.col("down") > unhealthy).select(F.lit("unhealthy nodes").alias("alert"), F.col("down").alias("value"))).unionByName(whole.filter(F.col("rate") > rate).select(F.lit("cluster").alias("alert"), F.col("rate").alias("value")))


def embed_in_batches(stream: DataFrame, embed: Callable[[list[str]], list[list[float]]], texts: int = 32) -> DataFrame:
    """A stream (or table) with a text, each row with its vector: embed sees so many texts at a time.

    What is left at the end of a task's share of a micro-batch goes as a smaller
    batch, so with ``trigger(processingTime="1 second")`` no text waits longer than
    that for others.  A null text has a null vector and isn't sent.
    """
    schema = StructType([*stream.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            given = rows["text"].notna()
            vectors = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            if given.any():
                found = embed(rows.loc[given, "text"].tolist())
                vectors[given] = pd.Series(found, index=rows.index[given])
            return rows.assign(vector=vectors)

        for frame in frames:
            while n + len(frame) >= texts:
                first, frame = frame.iloc[: texts - n], frame.iloc[texts - n :]
                yield done(pd.concat([*held, first], ignore_index=True))
                held, n = [], 0
            if len(frame):
                held.append(frame)
                n += len(frame)
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return stream.mapInPandas(batches, schema)


def micro_batch_embed(spark: SparkSession, path: str, schema: str, embed: Callable[[list[str]], list[list[float]]], texts: int = 32, files: int = 8) -> DataFrame:
    """Texts that arrive in a folder with their vectors; at most so many files make a micro-batch, texts of them a call of embed."""
    return embed_in_batches(message_stream(spark, path, schema, files), embed, texts)
