"""Registered queries of document structure, features and the remaining analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import features as X
from loomtext.functions import text as T
from loomtext.operators import analyze as A
from loomtext.operators import chunk as K
from loomtext.operators import search as S
from loomtext.operators import structure as D
from loomtext.plans.shared import Scratch

from .catalog import SQL_MARKS, SQL_N_WORDS, Catalog, sql_words
from .store_queries import _CHUNKS
from .text_queries import _DIVERSITY, _THEME_SQL, _quoted

C = Catalog()


def r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: trim(s)), lambda s: s <> '')"
_has = lambda found: " + ".join(f"contains(lower(text), '{w}')::INT" for w in found)
_TYPE_SCORES = ", ".join(f"({_has(found)}) / {len(found)} AS {k}" for k, found in X.DOCUMENT_TYPES.items())


@C.add("document_type", f"""
WITH s AS (SELECT doc_id, {_TYPE_SCORES} FROM documents), g AS (SELECT *, greatest({", ".join(X.DOCUMENT_TYPES)}) AS best FROM s)
SELECT doc_id, CASE WHEN best < 0.1 THEN 'unknown' {" ".join(f"WHEN {k} = best THEN '{k}'" for k in X.DOCUMENT_TYPES)} END AS type FROM g
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", X.document_type(F.col("text")).alias("type"))


@C.add("proposition_features", f"""
WITH e AS (SELECT doc_id, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) AS k FROM documents)
SELECT doc_id, k - 1 AS k, regexp_matches(s, '{"|".join(X.SUBJECTS)}') AND regexp_matches(s, '{"|".join(X.PREDICATES)}') AND regexp_matches(s, '^[A-Z]') AND regexp_matches(s, '[.!?]$') AS proposition,
  len(list_distinct(regexp_extract_all(s, '{X.ENTITY}'))) AS entities, {" + ".join(f"len(regexp_extract_all(s, '{p}'))" for p in X.RELATIONS)} AS relations,
  regexp_matches(s, '\\d') AS has_numbers, regexp_matches(s, '{"|".join(X.DATES)}') AS has_dates, len(regexp_extract_all(s, '[,;]')) + 1 AS clauses FROM e
""")  # fmt: skip
def _(t):
    s = t("documents").select("doc_id", F.posexplode_outer(K.split_sentences(F.col("text"))).alias("k", "s")).filter("s is not null")
    f = s.select("doc_id", "k", X.is_proposition(F.col("s")).alias("proposition"), X.proposition_features(F.col("s")).alias("f"))
    return f.select("doc_id", "k", "proposition", F.size("f.entities").alias("entities"), F.size("f.relations").alias("relations"), "f.has_numbers", "f.has_dates", "f.clauses")


_TELLING = f"list_filter(list_transform({sql_words('lower(text)')}, lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:\"''()\\[\\]]+', ''), '[.,!?;:\"''()\\[\\]]+$', '')), lambda w: strlen(w) > 3 AND NOT w IN ({_quoted(X.DULL)}))"


@C.add("informativeness", f"""
SELECT doc_id, round(coalesce((len({_TELLING}) + len(list_distinct({_TELLING}))) / nullif(2 * {SQL_N_WORDS}, 0), 0.0), 6) AS informativeness,
  round(least(coalesce(5 * (len(regexp_extract_all(text, '(?:^|\\s)[A-Z]')) + len(regexp_extract_all(text, '[0-9]')) / 10) / nullif({SQL_N_WORDS}, 0), 0.0), 1.0), 6) AS density FROM documents
""")  # fmt: skip
def _(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.round(X.informativeness(c), 6).alias("informativeness"), F.round(X.density(c, T.word_count(c)), 6).alias("density"))


@C.add("choose_strategy", f"""
WITH d AS (SELECT doc_id, least(0.5 * {SQL_N_WORDS} / {SQL_MARKS} / 20 + 0.5 * {_DIVERSITY}, 1.0) AS c, regexp_matches(text, 'function|class|import|def |var |const |let |public |private ') OR contains(text, '|')::INT + contains(text, chr(9))::INT + contains(text, 'Table')::INT + contains(text, 'Column')::INT + contains(text, 'Row')::INT >= 2 AS mixed, strlen(text) AS n FROM documents),
s AS (SELECT doc_id, strategy, 0.9 * CASE WHEN strategy = 'sentence' AND c < 0.5 THEN 1.2 WHEN strategy = 'semantic' AND c > 0.5 THEN 1.3 WHEN strategy = 'multimodal' AND mixed THEN 1.5 WHEN strategy = 'contextual' AND n > 1000 THEN 1.2 ELSE 1.0 END AS score
  FROM d, (VALUES ('sentence'), ('semantic'), ('multimodal'), ('contextual')) AS v(strategy))
SELECT doc_id, first(strategy ORDER BY round(score, 9) DESC, strategy) AS strategy FROM s GROUP BY doc_id
""")  # fmt: skip
def _(t):
    names = F.array(*[F.lit(x) for x in ("sentence", "semantic", "multimodal", "contextual")])
    each = t("documents").select("doc_id", "text", F.explode(names).alias("strategy"))
    scored = each.select("doc_id", "strategy", F.round(X.strategy_score(F.col("strategy"), F.lit(0.9), F.lit(1.0), F.col("text")), 9).alias("score"))
    return scored.groupBy("doc_id").agg(F.min_by("strategy", F.struct(-F.col("score"), "strategy")).alias("strategy"))


@C.add("follow_ups", """
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'more information|details') THEN 'Would you like me to elaborate on any specific aspect?' END,
  CASE WHEN contains(lower(text), 'example') THEN 'Would you like to see more examples?' END, CASE WHEN regexp_matches(lower(text), 'alternative|option') THEN 'Are you interested in exploring other alternatives?' END,
  CASE WHEN contains(lower(q), 'how') THEN 'Do you need help implementing this?' END, CASE WHEN contains(lower(q), 'what') THEN 'Would you like to know more about this topic?' END], lambda x: x IS NOT NULL)[1:3], ' ') AS questions
FROM p WHERE q IS NOT NULL
""")
def _(t):
    o = Window.partitionBy("conv_id").orderBy("turn")
    p = t("conversations").withColumn("q", F.lag("text").over(o)).filter("q is not null")
    return p.select("conv_id", "turn", F.array_join(X.follow_ups(F.col("text"), F.col("q")), " ").alias("questions"))


@C.add("sentiment_loose", f"""
WITH h AS (SELECT doc_id, len(list_filter({sql_words("lower(text)")}, lambda w: regexp_matches(w, '{"|".join(T.POSITIVE)}'))) AS pos, len(list_filter({sql_words("lower(text)")}, lambda w: regexp_matches(w, '{"|".join(T.NEGATIVE)}'))) AS neg FROM documents),
p AS (SELECT doc_id, coalesce((pos - neg) / nullif(pos + neg, 0), 0.0) AS polarity FROM h)
SELECT doc_id, round(polarity, 6) AS polarity, CASE WHEN polarity > 0.2 THEN 'positive' WHEN polarity < -0.2 THEN 'negative' ELSE 'neutral' END AS emotion FROM p
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", X.sentiment_loose(F.col("text")).alias("s")).select("doc_id", F.round("s.polarity", 6).alias("polarity"), "s.emotion")


@C.add("word_anomalies", f"""
WITH e AS (SELECT doc_id, unnest({sql_words("lower(text)")}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT doc_id, max(n) AS most, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(most / total, 6) AS share FROM m WHERE total >= 10 AND most / total > 0.3
""")
def _(t):
    found = A.word_anomalies(t("documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), *r("share"))


@C.add("document_outline", """
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
k AS (SELECT doc_id, line_no, trim(l) AS l FROM e WHERE trim(l) <> '')
SELECT doc_id, line_no, CASE WHEN regexp_matches(l, '^([-*+•]|[0-9]+\\))\\s') THEN 'item' WHEN strlen(l) < 100 AND ((l = upper(l) AND regexp_matches(l, '[A-Z]')) OR regexp_matches(l, '^[0-9]+(\\.[0-9]+)*\\.?\\s+[A-Z]') OR regexp_matches(l, '(?i)^(chapter|section|part)\\s')) THEN 'heading' ELSE 'text' END AS kind FROM k
""")
def _(t):
    return D.outline(t("documents"))


_BLOCK = D.BLOCK_PATTERN
_BLOCKS_OF = lambda table, id_, text: f"""
e AS (SELECT {id_} AS doc_id, unnest(string_split(regexp_replace({text}, '({_BLOCK})', chr(30) || '\\1' || chr(30), 'g'), chr(30))) AS x, generate_subscripts(string_split(regexp_replace({text}, '({_BLOCK})', chr(30) || '\\1' || chr(30), 'g'), chr(30)), 1) AS k FROM {table}),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS block_no, CASE WHEN starts_with(x, '```') THEN 'code' WHEN starts_with(x, '|') THEN 'table' WHEN starts_with(x, '![') THEN 'image' WHEN regexp_matches(x, '^<(table|div|section)') THEN 'html' ELSE 'text' END AS kind, trim(x, ' ') AS text
  FROM e WHERE trim(x, ' ') <> '')"""  # noqa: E731


@C.add("content_blocks", f"WITH {_BLOCKS_OF('documents', 'doc_id', 'text')} SELECT doc_id, block_no, kind, text FROM blocks")
def _(t):
    return D.content_blocks(t("documents"))


@C.add("chunk_multimodal")
def _(t):
    return D.chunk_multimodal(t("documents"), 64)


@C.add("neighbour_types", f"WITH {_BLOCKS_OF('pages', 'page_id', 'html')} SELECT doc_id, block_no, count(*) OVER w AS total, lag(kind) OVER o AS preceded_by, lead(kind) OVER o AS followed_by FROM blocks WINDOW w AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY block_no)")
def _(t):
    return D.neighbour_types(D.content_blocks(t("pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))))


@C.add("chunk_recursive", f"""
SELECT doc_id, sum(strlen(text))::BIGINT AS bytes, true AS within FROM documents WHERE text <> '' GROUP BY doc_id
""")
def _(t):
    p = D.chunk_recursive(t("documents"), 64, combine=True)
    return p.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), (F.max("tokens") <= 64).alias("within"))


_LEVELS = " UNION ALL ".join(f"SELECT doc_id, {k}, (n - 1) // {5**k} + 1, min(n), max(n) FROM c GROUP BY doc_id, (n - 1) // {5**k} HAVING count(DISTINCT (n - 1) // {5 ** (k - 1)}) > 1" for k in (1, 2, 3))


@C.add("chunk_hierarchy", f"WITH c AS (SELECT doc_id, chunk_no::BIGINT AS n FROM {_CHUNKS}) SELECT doc_id, 0 AS level, n AS node_no, n AS first, n AS last FROM c UNION ALL {_LEVELS} UNION ALL SELECT doc_id, 4, 1, min(n), max(n) FROM c GROUP BY doc_id")
def _(t):
    return D.hierarchy(K.chunk_sentence(t("documents"), 64, max_sentences=10_000)).select("doc_id", "level", "node_no", "first", "last")


# the invented documents have no headings, so a document is one section
_TREE = " UNION ALL ".join(f"SELECT doc_id, {k}, {f'(n - 1) // {5**k} + 1' if k < 4 else '1'}, min(n), max(n), count(DISTINCT (n - 1) // {5 ** (k - 1)}), sum(tokens)::BIGINT FROM c GROUP BY doc_id{f', (n - 1) // {5**k}' if k < 4 else ''} HAVING count(DISTINCT (n - 1) // {5 ** (k - 1)}) > 1" for k in (1, 2, 3, 4))


@C.add("section_tree", f"WITH c AS (SELECT doc_id, chunk_no::BIGINT AS n, tokens FROM {_CHUNKS}) SELECT doc_id, 0 AS level, n AS node_no, n AS first, n AS last, 0 AS children, tokens FROM c UNION ALL {_TREE}")
def _(t):
    return D.section_tree(t("documents"), 64).select("doc_id", "level", "node_no", "first", "last", "children", "tokens")


@C.add("position_context", f"""
WITH c AS (SELECT *, (chunk_no - 1) / count(*) OVER (PARTITION BY doc_id) AS rel FROM {_CHUNKS})
SELECT doc_id, chunk_no, round(rel, 6) AS \"at\", CASE WHEN rel < 0.1 THEN 'introduction' WHEN rel < 0.3 THEN 'early' WHEN rel < 0.7 THEN 'middle' WHEN rel < 0.9 THEN 'late' ELSE 'conclusion' END AS band,
  coalesce(length(right(lag(text) OVER o, 100)), 0) AS before, coalesce(length(left(lead(text) OVER o, 100)), 0) AS after FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_no)
""")
def _(t):
    return D.position_context(K.chunk_sentence(t("documents"), 64)).select("doc_id", "chunk_no", *r("at"), "band", F.length("before").alias("before"), F.length("after").alias("after"))


def _segments(t):
    return t("embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


_NEXT = "p AS (SELECT label AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), s AS (SELECT doc_id, pos, list_cosine_similarity(v, n) AS score FROM p WHERE n IS NOT NULL)"


@C.add("boundary_scores", f"WITH {_NEXT} SELECT doc_id, pos, round(score, 6) AS score FROM s")
def _(t):
    return D.boundary_scores(_segments(t)).select("doc_id", "pos", *r("score"))


@C.add("detect_boundaries", f"WITH {_NEXT}, q AS (SELECT doc_id, list_sort(list(score))[least(floor(count(*) * 0.3)::INT, count(*)::INT - 1) + 1] AS threshold FROM s GROUP BY doc_id) SELECT doc_id, pos, round(score, 6) AS score FROM s JOIN q USING (doc_id) WHERE score <= threshold")
def _(t):
    return D.detect_boundaries(_segments(t)).select("doc_id", "pos", *r("score"))


@C.add("boundary_thresholds", f"WITH {_NEXT} SELECT doc_id, round(avg(score), 6) AS mean, round(avg(score) - stddev_pop(score), 6) AS deviation FROM s GROUP BY doc_id")
def _(t):
    scores = D.boundary_scores(_segments(t))
    a, b = D.boundary_threshold(scores, "mean"), D.boundary_threshold(scores, "deviation")
    return a.withColumnRenamed("threshold", "mean").join(b.withColumnRenamed("threshold", "deviation"), "doc_id").select("doc_id", *r("mean", "deviation"))


@C.add("cross_references", f"""
WITH k AS (SELECT conv_id AS doc_id, turn AS node, list_distinct(list_filter(list_transform({sql_words("lower(text)")}, lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:"''()\\[\\]{{}}]+', ''), '[.,!?;:"''()\\[\\]{{}}]+$', '')), lambda w: strlen(w) > 2 AND NOT w IN ({_quoted(T.STOP_WORDS)}))) AS w FROM conversations)
SELECT a.doc_id, a.node AS src, b.node AS dst, len(list_intersect(a.w, b.w)) AS shared FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.node <> b.node WHERE len(list_intersect(a.w, b.w)) > 0.2 * len(a.w)
""")
def _(t):
    return D.cross_references(t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node"), "text"), 0.2)


@C.add("thematic_progression", f"""
WITH f AS (SELECT source, doc_id, {_THEME_SQL} AS a FROM documents), l AS (SELECT source, doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id FROM l WHERE list_has_any(a, b) AND list_has_any(b, c)
""")
def _(t):
    found = A.thematic_progression(t("documents").select(F.col("source").alias("group"), F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("group").alias("source"), F.col("id").alias("doc_id"))


@C.add("benchmark_summary", """
SELECT event_type AS operation, count(*) AS runs, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type
""")
def _(t):
    v = F.col("value")
    g = t("events").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("runs"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), (F.count("*") / F.sum(v)).alias("per_second"))
    return g.select("operation", "runs", *r("avg"), "min", "max", *r("p50", "p95", "per_second"))


@C.add("join_ground_truth", "SELECT d.doc_id, d.lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")


@C.add("union_distinct", "SELECT source AS x FROM documents UNION SELECT lang FROM documents UNION SELECT role FROM conversations")
def _(t):
    d = t("documents")
    return d.select(F.col("source").alias("x")).unionByName(d.select(F.col("lang").alias("x"))).unionByName(t("conversations").select(F.col("role").alias("x"))).distinct()


@C.add("relevant_subgraph", """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings),
core AS (SELECT id FROM v ORDER BY score DESC, id LIMIT 5),
s AS MATERIALIZED (SELECT x.vec_id AS src, y.vec_id AS dst FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.33), b AS MATERIALIZED (SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s),
w(start, id, hops) AS (SELECT id, id, 0 FROM core UNION SELECT start, b.dst, hops + 1 FROM w JOIN b ON b.src = w.id WHERE hops < 2)
SELECT start, id, min(hops) AS hops FROM w WHERE id <> start GROUP BY start, id
""")
def _(t):
    from loomtext.operators import graph as G
    from loomtext.operators.pairs import cosine_pairs

    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    core = S.knn(v.filter("id = 0").withColumnRenamed("id", "query_id"), v, 5).select("id")
    edges = Scratch(v.sparkSession, "similar").keep(cosine_pairs(v, 0.33).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return G.traverse(core, edges, 2, "both")
