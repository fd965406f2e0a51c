"""Registered queries of sources and streams; a stream runs over what is there, then stops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.embed import letter_counts
from loomtext.sources import io
from loomtext.streaming import stateful as Z
from loomtext.streaming import streams as S

from .catalog import Catalog
from .store_queries import _SENTENCES, _overlapping_sql

C = Catalog()


def r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def nearest_second(ts):
    """A timestamp at its nearest whole second (halves to the even one), as the twins' cast of seconds to BIGINT gives it."""
    return F.timestamp_seconds(F.rint(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long"))


def _streaming(name: str, sql: str | None, table: str, schema: str):
    """Registers fn(stream): the query reads the table as a stream."""

    def register(fn):
        C.queries[name] = lambda spark, sf_dir: fn(S.message_stream(spark, f"{sf_dir}/{table}.parquet", schema))
        if sql:
            C.sql[name] = sql
        return fn

    return register


@C.add("profile_columns", """
WITH l AS (SELECT 'c_custkey' AS "column", c_custkey::VARCHAR AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_acctbal', c_acctbal::VARCHAR FROM customer),
k AS (SELECT "column", CASE WHEN trim(v) = '' THEN 'empty' WHEN regexp_matches(trim(v), '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN 'number' ELSE 'text' END AS class FROM l),
n AS (SELECT "column", class, count(*) AS n FROM k WHERE class <> 'empty' GROUP BY ALL)
SELECT "column", arg_max(class, n) AS class, max(n) / sum(n) AS share FROM n GROUP BY "column"
""")
def _(t):
    return io.profile_columns(t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))


@C.add("json_paths", "SELECT event_id AS id, '$.' || unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def _(t):
    return io.json_paths(t("events"), "event_id", "props")


_CHUNKED = _overlapping_sql(_SENTENCES, " ", 128, 0, 1, 100, "fit")
_INGESTED = _CHUNKED.replace("WITH RECURSIVE", "WITH RECURSIVE t AS (SELECT doc_id, trim(text, ' ') AS text FROM documents), fit AS (SELECT * FROM t WHERE strlen(text) BETWEEN 10 AND 1000000),", 1)


@C.add("ingest_documents", f"""
SELECT doc_id, chunk_no, tokens, round(coalesce(strlen(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) / nullif(strlen(text), 0), 0.0), 6) AS density,
  CASE WHEN regexp_matches(text, 'function|class |import |```') THEN 'code' WHEN regexp_matches(text, 'https?://|www\\.') THEN 'web_content' WHEN contains(text, '@') AND contains(text, '.') THEN 'contact_info' ELSE 'text' END AS content_type, NULL AS error
FROM ({_INGESTED})
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'length out of bounds' FROM documents WHERE NOT coalesce(strlen(trim(text, ' ')) BETWEEN 10 AND 1000000, false)
""")
def _(t):
    return io.ingest_documents(t("documents"), size=128).select("doc_id", "chunk_no", "tokens", *r("density"), "content_type", "error")


@_streaming("stream_dedupe", "SELECT event_id, event_type FROM events", "events", S.EVENTS)
def _(s):
    twice = s.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return S.run_available(S.dedupe_messages(twice, "event_id", "60 days").select("event_id", "event_type"))


@_streaming("stream_metric_windows", "SELECT (time_bucket(INTERVAL 6 HOUR, ts))::VARCHAR AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY ALL", "events", S.EVENTS)
def _(s):
    out = S.run_available(S.metric_windows(s.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", None, "event_type"), "update", keys=("start", "event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", *r("mean"), "max")


@_streaming("stream_sliding_windows", """
SELECT (b - s * INTERVAL 6 HOUR)::VARCHAR AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM (SELECT value, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events), range(0, 2) AS r(s) GROUP BY ALL
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    out = S.run_available(S.metric_windows(s.withColumn("ts", F.col("ts").cast("timestamp")), "12 hours", "6 hours"), "update", keys=("start",))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", *r("mean"), "max")


@_streaming("stream_alerts", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL)
SELECT start::VARCHAR AS start, n, errors, round(errors / n, 6) AS rate FROM w WHERE errors / n > 0.1 AND n >= 5 AND start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    out = S.run_available(S.alerts(s.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", 0.1, 5))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "errors", *r("rate"))


@_streaming("stream_sessions", """
WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER o >= INTERVAL 12 HOUR OR lag(ts) OVER o IS NULL)::INT AS cut FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, cut DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 13 HOUR <= (SELECT max(ts) FROM events)
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    out = S.run_available(S.sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "12 hours"))
    return out.select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@_streaming("stream_latest_kv", "SELECT user_id AS key, max(event_id) AS revision, arg_max(value, event_id) AS value FROM events GROUP BY user_id", "events", S.EVENTS)
def _(s):
    return S.run_available(S.latest_values(s.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), "value")), "update", keys=("key",))


_RULES = "CASE " + " ".join(f"WHEN strlen(x) BETWEEN {lo} AND {hi} AND regexp_matches(lower(x), '{'|'.join(found)}') THEN '{category}'" for _, category, _, found, lo, hi in T.MEMORY_RULES) + " ELSE 'none' END"


@_streaming("stream_message_memories", f"WITH c AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'Remember: ' WHEN 1 THEN 'I prefer ' WHEN 2 THEN 'My name is ' ELSE '' END || text AS x FROM conversations) SELECT conv_id, turn, role, strlen(x) AS bytes, {_RULES} AS category FROM c", "conversations", S.MESSAGES)
def _(s):
    # the invented texts hold no keyword of a rule, so most turns are given one
    opening = F.when(F.col("turn") % 4 == 0, "Remember: ").when(F.col("turn") % 4 == 1, "I prefer ").when(F.col("turn") % 4 == 2, "My name is ").otherwise("")
    return S.run_available(S.message_memories(s.withColumn("text", F.concat(opening, "text"))))


_THROTTLED = """
WITH RECURSIVE e AS (SELECT {key} AS key, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS k FROM events WHERE {filter}),
w AS (SELECT key, ts, k FROM e WHERE k = 1 UNION ALL SELECT key, ts, k FROM (SELECT e.*, row_number() OVER (PARTITION BY e.key ORDER BY e.ts) AS first FROM w JOIN e ON e.key = w.key AND e.ts >= w.ts + INTERVAL {seconds} SECOND) WHERE first = 1)
SELECT key AS {key}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM w
"""


@_streaming("stream_activation_refresh", _THROTTLED.format(key="user_id", filter="true", seconds=6 * 3600), "events", S.EVENTS)
def _(s):
    out = S.run_available(S.throttle(s.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 6 * 3600))
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@_streaming("stream_alert_cooldown", _THROTTLED.format(key="event_type", filter="event_type = 'error'", seconds=12 * 3600), "events", S.EVENTS)
def _(s):
    out = S.run_available(S.throttle(s.filter("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", 12 * 3600))
    return out.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@_streaming("stream_node_health", """
WITH b AS (SELECT user_id AS node, max(ts) AS ts, count(*) AS tasks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT node, epoch((SELECT max(ts) FROM b))::BIGINT - epoch(ts)::BIGINT <= 43200 AS healthy, tasks, errors, round(100.0 * errors / tasks, 6) AS error_rate FROM b
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    beats = s.select(F.col("user_id").alias("node"), nearest_second(F.col("ts")).alias("ts"), F.lit(1).alias("tasks"), (F.col("event_type") == "error").cast("int").alias("errors"))
    latest = S.run_available(S.node_health(beats), "update", keys=("node",))
    return S.health_of(latest, 14400).select("node", "healthy", "tasks", "errors", *r("error_rate"))


@_streaming("stream_health_alerts", """
WITH b AS (SELECT user_id AS node, max(ts) AS ts, count(*) AS tasks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
h AS (SELECT *, epoch((SELECT max(ts) FROM b))::BIGINT - epoch(ts)::BIGINT <= 43200 AS healthy FROM b)
SELECT 'node ' || node AS alert, round(100.0 * errors / tasks, 6) AS value FROM h WHERE 100.0 * errors / tasks > 10
UNION ALL SELECT 'unhealthy nodes', count(*)::DOUBLE FROM h WHERE NOT healthy HAVING count(*) > 2
UNION ALL SELECT 'cluster', round(100.0 * sum(errors) / sum(tasks), 6) FROM h HAVING 100.0 * sum(errors) / sum(tasks) > 10
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    beats = s.select(F.col("user_id").alias("node"), nearest_second(F.col("ts")).alias("ts"), F.lit(1).alias("tasks"), (F.col("event_type") == "error").cast("int").alias("errors"))
    latest = S.run_available(S.node_health(beats), "update", keys=("node",))
    return S.health_alerts(S.health_of(latest, 14400)).select("alert", *r("value"))


@_streaming("stream_node_changes", """
WITH b AS (SELECT user_id AS node, epoch_us(ts) // 1000 AS ms FROM events),
cut AS (SELECT node, ms, coalesce(ms - lag(ms) OVER (PARTITION BY node ORDER BY ms) > 43200000, true)::INT AS new FROM b),
stretch AS (SELECT node, min(ms) AS first, max(ms) AS last FROM (SELECT node, ms, sum(new) OVER (PARTITION BY node ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM cut) GROUP BY node, k),
change AS (SELECT node, first AS ms, true AS healthy FROM stretch UNION ALL SELECT node, last + 43200000, false FROM stretch)
SELECT node, ms, healthy FROM change WHERE ms + 1 <= (SELECT max(ms) - 3600000 FROM b)
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    beats = s.select(F.col("user_id").alias("node"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("tasks"), (F.col("event_type") == "error").cast("int").alias("errors"))
    return S.run_available(Z.node_changes(beats, 14400, "1 hour")).select("node", F.unix_millis("ts").alias("ms"), "healthy")


@_streaming("stream_working_memory_events", """
WITH e AS (SELECT user_id, event_type AS cube_id, event_id AS pos, epoch_us(ts) // 1000 AS ms, event_id % 3 = 0 AS is_query, floor(value)::BIGINT::VARCHAR AS text FROM events),
c AS (SELECT user_id, cube_id, text, min({'ms': ms, 'pos': pos}) AS seen FROM e WHERE NOT is_query AND text IS NOT NULL GROUP BY ALL),
q AS (SELECT user_id, cube_id, pos, {'ms': ms, 'pos': pos} AS asked FROM e WHERE is_query AND ms + 1 <= (SELECT max(ms) - 3600000 FROM e)),
r AS (SELECT q.user_id, q.cube_id, q.pos, text, seen, row_number() OVER (PARTITION BY q.user_id, q.cube_id, q.pos ORDER BY seen) AS k FROM q LEFT JOIN c ON q.user_id = c.user_id AND q.cube_id = c.cube_id AND seen < asked)
SELECT user_id, cube_id, pos, coalesce(string_agg(text, ',' ORDER BY seen), '') AS texts FROM r WHERE k <= 5 GROUP BY ALL
""", "events", S.EVENTS)  # fmt: skip
def _(s):
    m = s.select("user_id", F.col("event_type").alias("cube_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("pos"), (F.col("event_id") % 3 == 0).alias("is_query"), F.floor("value").cast("string").alias("text"))
    return S.run_available(Z.working_memory_events(m, 3, 2, "40 days")).select("user_id", "cube_id", "pos", F.array_join("texts", ",").alias("texts"))


def _letters(texts: list[str]) -> list[list[float]]:
    return next(letter_counts(iter([pd.Series(texts)]))).tolist()


C.queries["stream_embed"] = lambda spark, sf_dir: S.run_available(S.micro_batch_embed(spark, f"{sf_dir}/conversations.parquet", S.MESSAGES, _letters)).select("conv_id", "turn", F.col("vector")[4].cast("double").alias("e"))
C.sql["stream_embed"] = "SELECT conv_id, turn, len(regexp_extract_all(lower(text), 'e'))::DOUBLE AS e FROM conversations"


@C.add("stream_retention", """
WITH e AS (SELECT event_id % 3 AS batch, epoch_us(ts) AS us FROM events),
m AS (SELECT batch, (max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 - 86400000) * 1000 AS watermark FROM e GROUP BY batch)
SELECT count(*) FILTER (kept) AS n, count(*) FILTER (NOT kept) AS dropped FROM (SELECT coalesce(us > watermark, true) AS kept FROM e JOIN m USING (batch))
""")
def _(t):
    # three batches that each go over the whole time, so that most of the third comes too late
    events = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = S.new_folder(events.sparkSession, "deliveries")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{folder}/part{k}.parquet")
    kept, dropped = S.run_counted(S.retention(S.message_stream(events.sparkSession, f"{folder}/part", "event_id long, ts timestamp", 1), "event_id"))
    return kept.agg(F.count("*").alias("n")).withColumn("dropped", F.lit(dropped).cast("long"))


@_streaming("stream_working_memory", "SELECT conv_id % 20 AS user_id, least(count(DISTINCT text), 12) AS size FROM conversations GROUP BY ALL", "conversations", S.MESSAGES)
def _(s):
    m = s.select((F.col("conv_id") % 20).alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    return S.run_available(S.working_memory(m, 10, 2), "update", keys=("user_id",))


@_streaming("stream_route_by_label", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL", "events", S.EVENTS)
def _(s):
    spark = s.sparkSession
    out = S.new_folder(spark, "routed")
    to = lambda name: lambda rows, number: rows.select("event_type", "event_id").write.mode("overwrite").parquet(f"{out}/handler={name}/batch={number}")
    rows = s.select("event_type", "event_id")
    batch = S.route_by_label(rows, "event_type", {"click": to("click"), "error": to("error")}, to("default"))
    rows.writeStream.option("checkpointLocation", S.new_folder(spark, "routed-state")).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return spark.read.schema("event_type string, event_id long, handler string").parquet(out).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
