"""Registered queries of summaries, sequences, patterns and retrieval for messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import markup as M
from loomtext.functions import text as T
from loomtext.functions.embed import embedder, letter_counts
from loomtext.operators import analyze as A
from loomtext.operators import chunk as K
from loomtext.operators import pairs as P
from loomtext.operators import search as S
from loomtext.operators import structure as D
from loomtext.operators import summarize as Z

from .catalog import SQL_MARKS, SQL_N_WORDS, Catalog, sql_words
from .search_queries import _CLEAN
from .store_queries import _PEOPLE, cubes, links, people
from .text_queries import _DIVERSITY, _QUALITY, _THEME_SQL, _TRIMMED, _quoted

C = Catalog()


def r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def talks(t):
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("group"), "text")


_DOTTED = "list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: s <> '')"
_JACCARD = """
j AS (SELECT x.group_ AS group_, sum(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))) AS total FROM sets x JOIN sets y ON x.group_ = y.group_ AND x.id < y.id GROUP BY x.group_)"""


@C.add("summarize_collection", f"""
WITH m AS (SELECT conv_id * 1000 + turn AS id, conv_id AS group_, text FROM conversations),
sets AS (SELECT id, group_, list_distinct({sql_words("lower(text)")}) AS w FROM m), {_JACCARD},
f AS (SELECT group_, count(*) AS memories, avg(least({SQL_N_WORDS} / {SQL_MARKS} / 20, 1.0)) AS complexity, least(avg(strlen(text)) / 200, 1.0) AS completeness,
  sum(len(list_filter({sql_words("text")}, lambda w: regexp_matches(w, '^[\\x00-\\x60\\x7B-\\x7F]'))))::BIGINT AS n_entities FROM m GROUP BY group_),
e AS (SELECT group_, s, row_number() OVER (PARTITION BY group_ ORDER BY id, k) AS place FROM (SELECT group_, id, unnest({_DOTTED}) AS s, generate_subscripts({_DOTTED}, 1) AS k FROM m)),
b AS (SELECT *, sum(strlen(s) + 1) OVER (PARTITION BY group_ ORDER BY place) AS bytes FROM e),
p AS (SELECT group_, coalesce(string_agg(s || '.', ' ' ORDER BY place) FILTER (bytes <= 500), '') AS summary, array_to_string(list(s ORDER BY place) FILTER (place <= 5), '|') AS key_points FROM b GROUP BY group_),
h AS (SELECT group_, theme, count(*) AS n FROM (SELECT group_, unnest({_THEME_SQL}) AS theme FROM m) GROUP BY ALL),
t AS (SELECT group_, string_agg(theme, '|' ORDER BY k) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY group_ ORDER BY n DESC, theme) AS k FROM h) WHERE k <= 5 GROUP BY group_)
SELECT f.group_ AS conv_id, memories, coalesce(summary, '') AS summary, coalesce(key_points, '') AS key_points, coalesce(themes, '') AS themes, n_entities, round(complexity, 6) AS complexity,
  round(CASE WHEN memories <= 1 THEN 1.0 ELSE coalesce(total, 0.0) / (memories * (memories - 1) / 2) END, 6) AS coherence, round(completeness, 6) AS completeness
FROM f LEFT JOIN p USING (group_) LEFT JOIN t USING (group_) LEFT JOIN j USING (group_)
""")
def _(t):
    z = Z.summarize_collection(talks(t))
    return z.select(F.col("group").alias("conv_id"), "memories", "summary", F.array_join("key_points", "|").alias("key_points"), F.array_join("themes", "|").alias("themes"), "n_entities", *r("complexity", "coherence", "completeness"))


@C.add("summary_entities", f"""
WITH e AS (SELECT source AS group_, unnest(list_filter({sql_words("text")}, lambda w: regexp_matches(w, '^[\\x00-\\x60\\x7B-\\x7F]'))) AS entity FROM documents)
SELECT group_ AS source, entity, count(*) AS n FROM e GROUP BY ALL
""")
def _(t):
    return Z.entities(t("documents").select(F.col("source").alias("group"), "text")).withColumnRenamed("group", "source")


@C.add("frequent_openers", f"""
WITH s AS (SELECT doc_id, unnest({_DOTTED}) AS s FROM documents), w AS (SELECT doc_id, {sql_words("lower(s)")} AS w FROM s WHERE strlen(s) > 20),
c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w[1:5]) AS word FROM w WHERE len(w) > 5) WHERE strlen(word) > 4 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c)
SELECT * FROM k WHERE rank <= 5
""")
def _(t):
    return Z.frequent_openers(t("documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@C.add("analyze_memory", f"""
WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(w, '^[.,!?;:"''()\\[\\]]+', ''), '[.,!?;:"''()\\[\\]]+$', '') AS w FROM (SELECT doc_id, unnest({sql_words("lower(text)")}) AS w FROM documents) WHERE strlen(w) > 3),
c AS (SELECT doc_id, w, count(*) AS n FROM e WHERE w <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c),
g AS (SELECT doc_id, string_agg(w, ',' ORDER BY k) AS keywords FROM k WHERE k <= 5 GROUP BY doc_id),
h AS (SELECT doc_id, len(list_filter({_TRIMMED}, lambda w: w IN ({_quoted(T.POSITIVE)}))) AS pos, len(list_filter({_TRIMMED}, lambda w: w IN ({_quoted(T.NEGATIVE)}))) AS neg FROM documents)
SELECT d.doc_id, coalesce(keywords, '') AS keywords, array_to_string({_THEME_SQL}, ',') AS themes, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS emotion,
  CASE WHEN strlen(text) = 0 THEN 0.0 ELSE round(least({SQL_N_WORDS} / {SQL_MARKS} / 20, 1.0), 6) END AS complexity, round({_QUALITY}, 6) AS quality,
  (strlen(text) > 500)::INT + (strlen(text) < 50)::INT + contains(text, '?')::INT + contains(text, '!')::INT + 1 AS insights
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)
""")
def _(t):
    day = lambda x: F.to_timestamp(F.lit(x))
    d = t("documents").select(F.col("doc_id").alias("id"), "text", day("2024-01-01").alias("created_at"), day("2024-01-01").alias("updated_at"))
    a = Z.analyze_memory(d, day("2024-03-01"))
    return a.select(F.col("id").alias("doc_id"), F.array_join("keywords", ",").alias("keywords"), F.array_join("themes", ",").alias("themes"), F.col("sentiment.emotion").alias("emotion"), *r("complexity", "quality"), F.size("insights").alias("insights"))


@C.add("temporal_triples", f"""
WITH m AS (SELECT event_id AS id, user_id AS group_, ts, string_split(event_type || ' ' || (event_id % 2), ' ') AS w FROM events),
n AS (SELECT *, lead(id) OVER o AS b, lead(w) OVER o AS w2, epoch_us(lead(ts) OVER o) - epoch_us(ts) < 86400000000 AS near FROM m WINDOW o AS (PARTITION BY group_ ORDER BY ts, id)),
p AS (SELECT group_, id AS a, b, len(list_intersect(w, w2)) / len(list_distinct(w || w2)) AS s FROM n WHERE near)
SELECT p.group_ AS user_id, p.a, p.b, q.b AS c, round((p.s + q.s) / 2, 6) AS support FROM p JOIN p q ON q.group_ = p.group_ AND q.a = p.b WHERE p.s > 0.3 AND q.s > 0.3
""")
def _(t):
    words = F.concat_ws(" ", "event_type", (F.col("event_id") % 2).cast("string"))
    m = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("group"), "ts", words.alias("text"))
    return Z.temporal_triples(m, overlap=0.3).select(F.col("group").alias("user_id"), "a", "b", "c", *r("support"))


@C.add("pattern_outliers", f"""
WITH d AS (SELECT doc_id, text, {_THEME_SQL} AS themes FROM documents), p AS (SELECT theme FROM (SELECT unnest(themes) AS theme FROM d) GROUP BY theme HAVING count(*) / (SELECT count(*) FROM d) >= 0.05)
SELECT doc_id AS id FROM d WHERE NOT (list_has_any(themes, coalesce((SELECT list(theme) FROM p), [])) OR strlen(text) > 500 OR contains(text, '?'))
""")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "text")
    topics = A.topic_patterns(d, 0.05).select(F.lit("topic").alias("type"), F.array("theme").alias("instances"))
    forms = d.limit(1).select(F.lit("structural").alias("type"), F.array(F.lit("long"), F.lit("questions")).alias("instances"))
    return Z.pattern_outliers(d, topics.unionByName(forms))


@C.add("retrieve_for_messages", f"""
WITH {_PEOPLE}, m AS (SELECT item_id AS query_id, item_id * 7 % (SELECT count(*) FROM customer) + 1 AS user_id, text FROM benchmark),
reads AS (SELECT cube_id, owner_id AS user_id FROM cubes WHERE is_active UNION SELECT l.cube_id, l.user_id FROM links l JOIN cubes c ON c.cube_id = l.cube_id AND c.is_active),
allowed AS (SELECT query_id, cube_id FROM m JOIN users USING (user_id) JOIN reads USING (user_id) WHERE is_active),
asked AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest({_CLEAN(0)}) AS word FROM m) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id % 25 AS cube_id, doc_id AS id, unnest({_CLEAN(0)}) AS word FROM documents),
s AS (SELECT query_id, a.cube_id, id, sum(times)::BIGINT AS score FROM held h JOIN asked USING (word) JOIN allowed a USING (query_id, cube_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, cube_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, cube_id, id, score, rank FROM k WHERE rank <= 5
""")
def _(t):
    n = t("customer").count()
    messages = t("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7 % n + 1).alias("user_id"), "text")
    memories = t("documents").select((F.col("doc_id") % 25).cast("int").alias("cube_id"), F.col("doc_id").alias("id"), "text")
    return S.retrieve_for_messages(messages, memories, people(t), cubes(t), links(t), 5).select("query_id", "cube_id", "id", "score", "rank")


@C.add("evidence_search", f"""
WITH e AS (SELECT item_id // 3 AS query_id, item_id AS evidence_id, text FROM benchmark), q AS (SELECT query_id, evidence_id, greatest(10 // count(*) OVER (PARTITION BY query_id), 1) AS quota FROM e),
asked AS (SELECT query_id, evidence_id, word, count(*) AS times FROM (SELECT query_id, evidence_id, unnest({_CLEAN(0)}) AS word FROM e) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id AS id, unnest({_CLEAN(0)}) AS word FROM documents),
s AS (SELECT query_id, evidence_id, id, sum(times)::BIGINT AS score FROM held JOIN asked USING (word) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, evidence_id, id, score, rank FROM k JOIN q USING (query_id, evidence_id) WHERE rank <= quota
""")
def _(t):
    e = t("benchmark").select(F.floor(F.col("item_id") / 3).alias("query_id"), F.col("item_id").alias("evidence_id"), "text")
    return S.evidence_search(e, t("documents").select(F.col("doc_id").alias("id"), "text"), 10).select("query_id", "evidence_id", "id", "score", "rank")


@C.add("hydrate_results", f"""
WITH asked AS (SELECT query_id, word, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_CLEAN(0)}) AS word FROM benchmark) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id AS id, unnest({_CLEAN(0)}) AS word FROM documents), s AS (SELECT query_id, id, sum(times)::BIGINT AS score FROM held JOIN asked USING (word) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, k.id, rank, lang, sha256(text) AS text_sha256 FROM k JOIN documents d ON d.doc_id = k.id WHERE rank <= 3
""")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    found = S.keyword_search(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), d, 3)
    return S.hydrate(found, d).select("query_id", "id", "rank", "lang", F.sha2("text", 256).alias("text_sha256"))


@C.add("memory_type_scope", "SELECT doc_id FROM documents WHERE source = 'src1'")
def _(t):
    return S.memory_type_scope(t("documents").withColumnRenamed("source", "memory_type"), "src1").select("doc_id")


@C.add("replace_working_memory", """
SELECT doc_id, lang AS cube_id, CASE WHEN doc_id % 2 = 0 THEN 'WorkingMemory' ELSE 'LongTermMemory' END AS memory_type FROM documents WHERE NOT (doc_id % 2 = 0 AND lang IN ('en', 'fr'))
UNION ALL SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END, 'WorkingMemory' FROM benchmark
""")
def _(t):
    kind = F.when(F.col("doc_id") % 2 == 0, "WorkingMemory").otherwise("LongTermMemory")
    fresh = t("benchmark").select(F.col("item_id").alias("doc_id"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("cube_id"))
    return S.replace_working_memory(t("documents").select("doc_id", F.col("lang").alias("cube_id"), kind.alias("memory_type")), fresh)


@C.add("semantic_relationships_vectors", """
SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS score, 'related' AS label
FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.4
""")
def _(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return P.semantic_relationships(None, v, 0.4).select("a", "b", F.round("score", 5).alias("score"), "label")


@C.add("segment_coherence", """
WITH s AS MATERIALIZED (SELECT label AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT doc_id, pos, list_cosine_similarity(v, lead(v) OVER (PARTITION BY doc_id ORDER BY pos)) AS c FROM s),
q AS (SELECT doc_id, avg(c) AS sequential, list_sort(list(c) FILTER (c IS NOT NULL))[least(floor(count(c) * 0.3)::INT, count(c)::INT - 1) + 1] AS cut FROM n GROUP BY doc_id),
b AS (SELECT n.doc_id, count(*) FILTER (c <= cut) AS boundaries, count(*) AS segments FROM n JOIN q USING (doc_id) GROUP BY n.doc_id),
a AS (SELECT x.doc_id, avg(list_cosine_similarity(x.v, y.v)) AS average FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.pos < y.pos GROUP BY x.doc_id)
SELECT doc_id, segments, round(coalesce(sequential, 0.0), 5) AS sequential, round(coalesce(average, 0.0), 5) AS average, boundaries,
  round(greatest(least((0.6 * coalesce(sequential, 0.0) + 0.4 * coalesce(average, 0.0)) * CASE WHEN boundaries / segments > 0.5 THEN 1 - (boundaries / segments - 0.5) * 0.5 ELSE 1 END, 1.0), 0.0), 5) AS score
FROM b JOIN q USING (doc_id) LEFT JOIN a USING (doc_id)
""")
def _(t):
    s = t("embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return D.segment_coherence(s).select("doc_id", "segments", *[F.round(c, 5).alias(c) for c in ("sequential", "average")], "boundaries", F.round("score", 5).alias("score"))


_COUNTS = "[" + ", ".join(f"len(regexp_extract_all(lower(text), '{x}'))" for x in "abcdefghijklmnop") + "]"


@C.add("embed_texts", f"SELECT conv_id, turn, list_sum({_COUNTS})::DOUBLE AS total, ({_COUNTS})[5]::DOUBLE AS e FROM conversations")
def _(t):
    v = embedder(letter_counts)(t("conversations").select("conv_id", "turn", "text"))
    return v.select("conv_id", "turn", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.col("vector")[4].cast("double").alias("e"))


@C.add("chunk_contextual")
def _(t):
    c = D.chunk_contextual(t("documents"), 64, embedder(letter_counts))
    return c.select("doc_id", "chunk_no", "tokens", "band", "structure.sentences", F.size("vector").alias("dims"))


@C.add("collection_quality", f"""
WITH a AS (SELECT CASE WHEN strlen(text) < 10 THEN 0.2 WHEN strlen(text) < 50 THEN 0.5 WHEN strlen(text) < 200 THEN 0.8 ELSE 1.0 END::DOUBLE AS length,
  (CASE WHEN contains(text, chr(10)) THEN 0.3 ELSE 0 END + CASE WHEN contains(text, '.') THEN 0.3 ELSE 0 END + CASE WHEN contains(text, ',') THEN 0.2 ELSE 0 END + CASE WHEN {SQL_N_WORDS} > 5 THEN 0.2 ELSE 0 END)::DOUBLE AS structure,
  (CASE WHEN {SQL_N_WORDS} = 0 THEN 0.0 WHEN {SQL_N_WORDS} / {SQL_MARKS} BETWEEN 15 AND 20 THEN 1.0 WHEN {SQL_N_WORDS} / {SQL_MARKS} BETWEEN 10 AND 25 THEN 0.8 ELSE 0.5 END)::DOUBLE AS readability, {_DIVERSITY} AS informativeness FROM documents)
SELECT round(avg(length), 6) AS length, round(avg(structure), 6) AS structure, round(avg(readability), 6) AS readability, round(avg(informativeness), 6) AS informativeness, round(avg((length + structure + readability + informativeness) / 4), 6) AS score FROM a
""")
def _(t):
    return A.collection_quality(t("documents")).select(*r("length", "structure", "readability", "informativeness", "score"))


@C.add("update_frequency", "SELECT round(avg((o_orderdate > TIMESTAMP '1995-01-01')::INT), 6) AS updated_share FROM orders")
def _(t):
    o = t("orders").select(F.lit("1995-01-01").cast("timestamp_ntz").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    return A.update_frequency(o).select(*r("updated_share"))


@C.add("text_sections", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
m AS (SELECT *, regexp_matches(line, '^#{1,6}\\s') AS marked, regexp_matches(line, '^[0-9]+(\\.[0-9]+)*\\.\\s+\\S') AS numbered, trim(line, ' ') = '' AS blank FROM l),
d AS (SELECT *, CASE WHEN bool_or(marked) OVER w THEN 'heading' WHEN bool_or(numbered) OVER w THEN 'number' ELSE 'block' END AS kind, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY k), false) AS after_blank FROM m WINDOW w AS (PARTITION BY doc_id)),
s AS (SELECT *, sum(CASE kind WHEN 'heading' THEN marked WHEN 'number' THEN numbered ELSE NOT blank AND after_blank END::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM d)
SELECT doc_id, section::BIGINT AS section, arg_min(CASE kind WHEN 'heading' THEN regexp_extract(line, '^#{1,6}\\s+(.*)$', 1) WHEN 'number' THEN regexp_extract(line, '^[0-9]+(\\.[0-9]+)*\\.\\s+(.*)$', 2) ELSE '' END, k) AS title, count(*) AS lines
FROM s WHERE kind <> 'block' OR NOT blank GROUP BY doc_id, section
""")
def _(t):
    return K.sections(t("documents"))


@C.add("title_references")
def _(t):
    n = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node"), "text", F.array_join(F.slice(T.words(F.col("text")), 1, 2), " ").alias("title"))
    return D.title_references(n)


@C.add("coherence_estimate")
def _(t):
    return Z.mean_jaccard(t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "text"), estimate=True).select("group", *r("coherence"))


@C.add("markdown_extract", """
WITH x AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || '- ' || lang || chr(10) || '## n' || chr(10) || text AS md FROM documents)
SELECT doc_id, len(regexp_extract_all(md, '(?m)^#{1,6}\\s+.+$')) AS headings FROM x
""")
def _(t):
    md = F.concat(F.lit("# "), "source", F.lit("\n\n- "), "lang", F.lit("\n## n\n"), "text")
    return t("documents").select("doc_id", md.alias("md")).select("doc_id", F.size(M.md_headings(F.col("md"))).alias("headings"))
