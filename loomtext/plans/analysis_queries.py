"""Registered queries of the pair joins and the collection analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import analyze as A
from loomtext.operators import pairs as P

from loomtext.plans.shared import Scratch

from .catalog import SQL_MARKS, SQL_N_WORDS, Catalog, sql_words
from .text_queries import _QUALITY, _THEME_SQL, _quoted

C = Catalog()
_W = sql_words("lower(text)")


def memories(t):
    return t("documents").select(F.col("doc_id").alias("id"), "text")


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def events(t):
    return t("events").select(F.col("user_id").alias("group"), F.col("event_id").alias("id"), "ts", F.concat_ws(" ", "event_type", "props").alias("text"))


def r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


_JACCARD = f"""
s AS (SELECT doc_id AS id, list_distinct({_W}) AS w FROM documents),
i AS (SELECT id, len(w) AS n, unnest(w) AS word FROM s),
jac AS (SELECT x.id AS a, y.id AS b, count(*) / (x.n + y.n - count(*)) AS score FROM i x JOIN i y ON x.word = y.word AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n)"""


@C.add("pairs_token_jaccard", f"WITH {_JACCARD} SELECT a, b, round(score, 6) AS score FROM jac WHERE score > 0.3")
def _(t):
    return P.token_jaccard_pairs(memories(t), 0.3).select("a", "b", *r("score"))


_COSINE = "cos AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


@C.add("pairs_cosine", f"WITH {_COSINE} SELECT a, b, round(score, 6) AS score FROM cos WHERE score > 0.3")
def _(t):
    return P.cosine_pairs(vectors(t), 0.3).select("a", "b", *r("score"))


@C.add("pairs_cosine_lsh")
def _(t):
    return P.cosine_pairs(vectors(t), 0.35, "lsh").select("a", "b", *r("score"))


@C.add("semantic_relationships", f"WITH {_JACCARD} SELECT a, b, round(score, 6) AS score, CASE WHEN score > 0.9 THEN 'near_duplicate' WHEN score > 0.8 THEN 'highly_similar' WHEN score > 0.7 THEN 'similar' ELSE 'related' END AS relationship FROM jac WHERE score > 0.6")
def _(t):
    return P.token_jaccard_pairs(memories(t), 0.6).select("a", "b", *r("score"), P.relationship_label(F.col("score")).alias("relationship"))


@C.add("similarity_graph", f"WITH {_COSINE} SELECT a AS src, b AS dst, round(score, 6) AS weight FROM cos WHERE score > 0.3 UNION ALL SELECT b, a, round(score, 6) FROM cos WHERE score > 0.3")
def _(t):
    return P.similarity_graph(P.cosine_pairs(vectors(t), 0.3)).select("src", "dst", *r("weight"))


@C.add("pairs_temporal", """
SELECT x.event_id AS a, y.event_id AS b, round(exp(-(abs(epoch_us(x.ts) - epoch_us(y.ts)) / 3600000000) / 24), 6) AS score
FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id < y.event_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) / 3600000000 < 24
""")
def _(t):
    return P.temporal_pairs(events(t)).select("a", "b", *r("score"))


def _groups(t):
    pairs = P.token_jaccard_pairs(memories(t), 0.3)
    pairs = Scratch(pairs.sparkSession, "pairs").keep(pairs)  # read by the groups and by their summaries
    return P.duplicate_groups(memories(t), pairs), pairs


_GROUPS = f"""
{_JACCARD}, close AS MATERIALIZED (SELECT a, b, score FROM jac WHERE score > 0.3),
lower_ones AS (SELECT d.doc_id AS id, coalesce(list(c.a) FILTER (c.a IS NOT NULL), []) AS lows FROM documents d LEFT JOIN close c ON c.b = d.doc_id GROUP BY d.doc_id),
numbered AS MATERIALIZED (SELECT id, lows, row_number() OVER (ORDER BY id) AS k FROM lower_ones WHERE len(lows) > 0 OR id IN (SELECT a FROM close)),
run(k, id, leader, leaders) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT n.k, n.id, coalesce(list_min(list_intersect(n.lows, r.leaders)), n.id), CASE WHEN len(list_intersect(n.lows, r.leaders)) = 0 THEN list_append(r.leaders, n.id) ELSE r.leaders END FROM run r JOIN numbered n ON n.k = r.k + 1),
led AS (SELECT d.doc_id AS id, coalesce(r.leader, d.doc_id) AS leader FROM documents d LEFT JOIN run r ON r.id = d.doc_id)"""


@C.add("duplicate_groups", f"WITH RECURSIVE {_GROUPS} SELECT id, leader FROM led")
def _(t):
    return _groups(t)[0]


@C.add("duplicate_group_summary", f"WITH RECURSIVE {_GROUPS} SELECT leader, count(*) + 1 AS members, round(min(score), 6) AS similarity FROM led JOIN close ON a = leader AND b = id WHERE id <> leader GROUP BY leader")
def _(t):
    groups, pairs = _groups(t)
    return P.group_summary(groups, pairs).select("leader", "members", *r("similarity"))


@C.add("cluster_themes", f"""
WITH RECURSIVE {_GROUPS}, t AS (SELECT leader, coalesce({_THEME_SQL}[1], 'general') AS theme, strlen(text) AS n, CASE WHEN strlen(text) = 0 THEN 0.0 ELSE least({SQL_N_WORDS} / {SQL_MARKS} / 20, 1.0) END AS c FROM led JOIN documents ON doc_id = id),
g AS (SELECT leader, theme, count(*) AS k, sum(n) AS n, sum(c) AS c FROM t GROUP BY ALL)
SELECT leader, sum(k)::BIGINT AS members, first(theme ORDER BY k DESC, theme DESC) AS theme, round(sum(n) / sum(k), 6) AS avg_length, round(sum(c) / sum(k), 6) AS avg_complexity FROM g GROUP BY leader HAVING sum(k) > 1
""")
def _(t):
    groups, _ = _groups(t)
    first = F.coalesce(F.try_element_at(T.themes(F.col("text")), F.lit(1)), F.lit("general"))
    themed = groups.join(memories(t).select("id", first.alias("theme"), F.octet_length("text").alias("n"), T.complexity(F.col("text")).alias("c")), "id")
    counted = themed.groupBy("leader", "theme").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    return counted.groupBy("leader").agg(F.sum("k").alias("members"), F.max_by("theme", F.struct("k", "theme")).alias("theme"), F.round(F.sum("n") / F.sum("k"), 6).alias("avg_length"), F.round(F.sum("c") / F.sum("k"), 6).alias("avg_complexity")).filter("members > 1")


@C.add("similar_pair_share", f"WITH {_COSINE} SELECT count(*) AS pairs, count(*) / ((SELECT count(*) * (count(*) - 1) / 2 FROM embeddings)) AS support FROM cos WHERE score > 0.3")
def _(t):
    v = vectors(t)
    return P.similar_pair_share(v.count(), P.cosine_pairs(v, 0.3))


@C.add("collection_stats", f"""
WITH q AS (SELECT strlen(text) AS n, {_QUALITY} AS q FROM documents)
SELECT count(*) AS items, round(avg(n), 6) AS avg_length, median(n) AS median_length, round(stddev_pop(n), 6) AS stddev_length, round(avg(q), 6) AS avg_quality, round(stddev_pop(q), 6) AS stddev_quality FROM q
""")
def _(t):
    return A.collection_stats(memories(t)).select("items", *r("avg_length"), "median_length", *r("stddev_length", "avg_quality", "stddev_quality"))


@C.add("creation_rate", "SELECT user_id AS \"group\", count(*) AS items, round(coalesce(count(*) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000, 0), 0.0), 6) AS per_hour FROM events GROUP BY user_id")
def _(t):
    return A.creation_rate(events(t), "group").select("group", "items", *r("per_hour"))


@C.add("theme_histogram", f"SELECT theme, count(*) AS n FROM (SELECT unnest({_THEME_SQL}) AS theme FROM documents) GROUP BY theme")
def _(t):
    return A.theme_histogram(memories(t))


@C.add("topic_patterns", f"SELECT theme, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS support FROM (SELECT unnest({_THEME_SQL}) AS theme FROM documents) GROUP BY theme HAVING support >= 0.001")
def _(t):
    return A.topic_patterns(memories(t), 0.001).select("theme", "n", *r("support"))


@C.add("daily_timeline", """
WITH e AS (SELECT ts::DATE AS day, event_id AS id, event_type || ' ' || props AS text FROM events)
SELECT day::VARCHAR AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id, array_to_string(list_filter([CASE WHEN count(*) > 10 THEN 'high_activity' END, CASE WHEN avg(strlen(text)) > 500 THEN 'long_form' END,
  CASE WHEN avg(contains(text, '?')::INT) > 0.5 THEN 'inquiry' END], lambda x: x IS NOT NULL), ',') AS kinds FROM e GROUP BY day
""")
def _(t):
    return A.daily_timeline(events(t)).withColumn("day", F.col("day").cast("string"))


@C.add("frequent_words", f"SELECT word, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS support FROM (SELECT unnest({_W}) AS word FROM documents) WHERE strlen(word) > 3 GROUP BY word HAVING count(*) / (SELECT count(*) FROM documents) >= 0.05")
def _(t):
    return A.frequent_words(memories(t), 0.05).select("word", "n", *r("support"))


@C.add("corpus_tfidf", f"""
WITH d AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_W}) AS word FROM documents) WHERE strlen(word) > 3 GROUP BY word HAVING count(*) > 1)
SELECT word, df, floor(1000 * df / (SELECT count(*) FROM documents) * ln((SELECT count(*) FROM documents) / df))::INT AS weight FROM d
""")
def _(t):
    return A.corpus_tfidf(memories(t))


@C.add("format_frequencies", """
SELECT unnest(['question', 'statement', 'exclamation', 'list']) AS format, unnest([count(*) FILTER (contains(text, '?')), count(*) FILTER (contains(text, '.')), count(*) FILTER (contains(text, '!')),
  count(*) FILTER (regexp_matches(text, '(?m)^\\s*[-*] '))]) AS n FROM documents
""")
def _(t):
    return A.format_frequencies(memories(t))


@C.add("length_profile", """
WITH m AS (SELECT floor(avg(strlen(text)))::BIGINT AS mean FROM documents)
SELECT round(avg((strlen(text) < mean // 2)::INT), 6) AS short, round(avg((strlen(text) > 2 * mean)::INT), 6) AS long,
       round(avg((contains(text, chr(10)) AND contains(text, '.'))::INT), 6) AS structured, round(avg(contains(text, '?')::INT), 6) AS questions FROM documents, m
""")
def _(t):
    return A.length_profile(memories(t)).select(*r("short", "long", "structured", "questions"))


@C.add("keywords", f"""
WITH e AS (SELECT doc_id AS id, unnest({_W}) AS word FROM documents),
c AS (SELECT id, regexp_replace(regexp_replace(word, '^[.,!?;:"''()\\[\\]]+', ''), '[.,!?;:"''()\\[\\]]+$', '') AS word FROM e WHERE strlen(word) > 3),
k AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, word) AS k FROM c WHERE word <> '' GROUP BY id, word)
SELECT id, string_agg(word, ',' ORDER BY k) AS keywords FROM k WHERE k <= 5 GROUP BY id
""")
def _(t):
    return A.keywords(memories(t)).select("id", F.array_join("keywords", ",").alias("keywords"))


@C.add("memory_size", "SELECT lang AS memory_type, count(*) AS items, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def _(t):
    return A.memory_size(t("documents").select(F.col("lang").alias("memory_type"), "text"))


_GAPS = "g AS (SELECT user_id AS \"group\", event_id AS id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000 AS gap FROM events)"


@C.add("regular_creation", f"""
WITH {_GAPS}, m AS (SELECT *, avg(gap) OVER (PARTITION BY "group") AS mean, stddev_samp(gap) OVER (PARTITION BY "group") AS sd FROM g WHERE gap IS NOT NULL)
SELECT "group", round(avg((abs(gap - mean) <= sd)::INT), 6) AS regularity, count(*) AS gaps FROM m GROUP BY "group" HAVING count(*) > 2
""")
def _(t):
    return A.regular_creation(events(t)).filter("gaps > 2").select("group", *r("regularity"), "gaps")


@C.add("time_gap_anomalies", f"""
WITH {_GAPS}, m AS (SELECT *, avg(gap) OVER (PARTITION BY "group") + 2 * stddev_pop(gap) OVER (PARTITION BY "group") AS lim FROM g WHERE gap IS NOT NULL)
SELECT "group", id, round(gap, 6) AS gap, round(least(0.8, gap / lim), 6) AS severity FROM m WHERE gap > lim + 1e-9
""")
def _(t):
    return A.time_gap_anomalies(events(t)).filter("severity < 0.8 or gap > 0").select("group", "id", *r("gap", "severity"))


@C.add("activity_bursts", """
WITH d AS (SELECT user_id AS "group", ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY "group") // count(*) OVER (PARTITION BY "group") AS mean FROM d)
SELECT "group", day::VARCHAR AS day, n FROM m WHERE n > 2 * mean
""")
def _(t):
    return A.activity_bursts(events(t)).withColumn("day", F.col("day").cast("string"))


@C.add("related_runs", """
WITH e AS (SELECT user_id AS "group", event_id AS id, ts, list_distinct(list_filter(regexp_split_to_array(lower(event_type || ' ' || props), '\\s+'), lambda w: w <> '')) AS w FROM events),
p AS (SELECT *, lag(ts) OVER o AS pts, lag(w) OVER o AS pw FROM e WINDOW o AS (PARTITION BY "group" ORDER BY ts, id)),
c AS (SELECT *, (NOT coalesce((epoch_us(ts) - epoch_us(pts)) / 3600000000 < 48 AND len(list_intersect(w, pw)) / len(list_distinct(w || pw)) > 0.3, false))::INT AS cut FROM p),
n AS (SELECT "group", sum(cut) OVER (PARTITION BY "group" ORDER BY ts, id) AS run FROM c),
s AS (SELECT "group", run, count(*) AS n FROM n GROUP BY ALL)
SELECT "group", max(n) AS n FROM s GROUP BY "group" HAVING max(n) >= 3
""")
def _(t):
    return A.related_runs(events(t), 48, 0.3)


@C.add("theme_trigrams", f"""
WITH f AS (SELECT source AS "group", doc_id AS id, coalesce(({_THEME_SQL})[1], 'general') AS a FROM documents),
l AS (SELECT a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY "group" ORDER BY id))
SELECT a, b, c, count(*) AS n FROM l WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) > 1
""")
def _(t):
    return A.theme_trigrams(t("documents").select(F.col("source").alias("group"), F.col("doc_id").alias("id"), "text"))


@C.add("length_outliers", """
WITH m AS (SELECT floor(avg(strlen(text))) AS mean, floor(stddev_pop(strlen(text))) AS sd FROM documents)
SELECT doc_id AS id, strlen(text) AS n FROM documents, m WHERE abs(strlen(text) - mean) > 2 * sd
""")
def _(t):
    return A.length_outliers(memories(t))


@C.add("turn_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4")
def _(t):
    return A.turn_window(t("conversations"), 2).select("conv_id", "turn", "role")


@C.add("evict_lru", """
WITH e AS (SELECT user_id AS owner, event_id AS id, strlen(props) AS size, sum(strlen(props)) OVER (PARTITION BY user_id) - 100 AS excess,
  coalesce(sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM events)
SELECT owner, id, size FROM e WHERE freed < excess
""")
def _(t):
    e = t("events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("accessed"), F.octet_length("props").alias("size"))
    return A.evict_lru(e, 100).select("owner", "id", "size")


@C.add("keep_last_versions", "SELECT owner, version FROM (SELECT o_custkey AS owner, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def _(t):
    return A.keep_last_versions(t("orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("version")), 3)


@C.add("chat_metrics", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS asked, sum(strlen(text) // 4)::BIGINT AS tokens, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(t):
    return A.chat_metrics(t("conversations"))


@C.add("export_chat_history", "SELECT conv_id, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def _(t):
    return A.chat_history(t("conversations"))


@C.add("operation_metrics", "SELECT event_type AS operation, count(*) AS n, count(*) FILTER (value < 10) AS errors, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY event_type")
def _(t):
    log = t("events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), (F.col("value") < 10).alias("failed"))
    return A.operation_metrics(log).select("operation", "n", "errors", "min", "max", *r("avg"))


@C.add("quality_trend", """
WITH s AS (SELECT user_id AS "group", value AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events),
o AS (SELECT "group", count(*) AS rows, avg(score) AS mean, regr_slope(score, -k) AS slope FROM s WHERE k <= 10 GROUP BY "group")
SELECT "group", rows, round(mean, 6) AS mean, round(slope, 6) AS slope, CASE WHEN rows < 3 THEN 'insufficient' WHEN slope > 0.01 THEN 'improving' WHEN slope < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM o WHERE rows > 1
""")
def _(t):
    s = t("events").select(F.col("user_id").alias("group"), F.col("event_id").alias("n"), F.col("value").alias("score"))
    return A.quality_trend(s).filter("rows > 1").select("group", "rows", *r("mean", "slope"), "trend")


@C.add("compare_strategies", """
WITH a AS (SELECT avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM events WHERE event_type = 'view'), b AS (SELECT avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM events WHERE event_type = 'click')
SELECT round(b.m - a.m, 6) AS difference, round((b.m - a.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t FROM a, b
""")
def _(t):
    of = lambda kind: t("events").filter(F.col("event_type") == kind).select(F.col("value").alias("score"))
    return A.welch(of("view"), of("click")).select(*r("difference", "t"))


@C.add("detect_regressions", """
WITH h AS (SELECT event_type AS name, 'mean' AS metric, avg(value) FILTER (event_id % 2 = 0) AS before, avg(value) FILTER (event_id % 2 = 1) AS after FROM events GROUP BY event_type),
c AS (SELECT *, (after - before) / before AS change FROM h)
SELECT name, metric, round(before, 6) AS before, round(after, 6) AS after, round(change, 6) AS change,
       CASE WHEN abs(change) > 0.5 THEN 'critical' WHEN abs(change) > 0.2 THEN 'high' WHEN abs(change) > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM c
""")
def _(t):
    half = lambda k: t("events").filter(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("name")).agg(F.lit("mean").alias("metric"), F.avg("value").alias("value"))
    return A.detect_regressions(half(0), half(1)).select("name", "metric", *r("before", "after", "change"), "severity")
