"""Registered queries of the search operators: `benchmark` texts ask, `documents` are the memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import ivf as I
from loomtext.operators import search as S

from .catalog import Catalog, sql_words

C = Catalog()
K = 5
_CLEAN = lambda n: f"list_filter(list_transform({sql_words('lower(text)')}, lambda w: regexp_replace(w, '[.,!?;:()\\[\\]{{}}\"''\\-]', '', 'g')), lambda w: strlen(w) > {n})".replace("{{", "{").replace("}}", "}")


def asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def memories(t):
    return t("documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("cube_id"))


def query_vectors(t):
    return t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def r(df, *keep):
    return df.select(*keep, F.round("score", 6).alias("score"), "rank")


_KEYWORD = f"""
asked AS (SELECT query_id, word, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_CLEAN(0)}) AS word FROM benchmark) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id AS id, source AS cube_id, unnest({_CLEAN(0)}) AS word FROM documents),
scores AS (SELECT query_id, id, cube_id, sum(times)::BIGINT AS score FROM held JOIN asked USING (word) GROUP BY ALL)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"


@C.add("search_keyword", f"WITH {_KEYWORD}, r AS (SELECT query_id, id, score, {_TOP} FROM scores) SELECT * FROM r WHERE rank <= {K}")
def _(t):
    return S.keyword_search(asked(t), memories(t), K).select("query_id", "id", "score", "rank")


@C.add("search_substring", """
SELECT doc_id AS id, CASE WHEN lower(text) = 'the and' THEN 1.0 WHEN starts_with(lower(text), 'the and') THEN 0.9 ELSE 0.8 END::DOUBLE AS score
FROM documents WHERE contains(lower(text), 'the and') ORDER BY score DESC, id LIMIT 20
""")
def _(t):
    return S.substring_search("the and", memories(t), 20)


_TFIDF = f"""
words AS (SELECT doc_id AS id, {_CLEAN(2)} AS w FROM documents),
counted AS (SELECT id, term, any_value(total) AS total, count(*) AS tf FROM (SELECT id, len(w) AS total, unnest(w) AS term FROM words) GROUP BY id, term),
dfs AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM counted GROUP BY term),
weights AS (SELECT id, term, tf / total * idf AS weight, idf FROM counted JOIN dfs USING (term)),
asked AS (SELECT query_id, term, count(*) * any_value(idf) AS q FROM (SELECT item_id AS query_id, unnest({_CLEAN(2)}) AS term FROM benchmark) JOIN dfs USING (term) GROUP BY query_id, term),
scores AS (
  SELECT query_id, id, dot / (norm * q_norm) AS score
  FROM (SELECT query_id, id, sum(weight * q) AS dot FROM weights JOIN asked USING (term) GROUP BY ALL)
  JOIN (SELECT id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY id) USING (id)
  JOIN (SELECT query_id, sqrt(sum(q * q)) AS q_norm FROM asked GROUP BY query_id) USING (query_id)
  WHERE dot / nullif(norm * q_norm, 0) > 0)"""


@C.add("search_tfidf", f"WITH {_TFIDF}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}")
def _(t):
    return r(S.tfidf_search(asked(t), memories(t), K), "query_id", "id")


@C.add("build_tfidf", f"WITH {_TFIDF} SELECT id, count(*) AS terms, round(sum(weight), 6) AS total FROM weights GROUP BY id")
def _(t):
    return S.build_tfidf(memories(t)).groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"))


_FAST = f"""
words AS (SELECT doc_id AS id, {sql_words("lower(text)")} AS w FROM documents),
counted AS (SELECT id, term, any_value(total) AS total, count(*) AS tf FROM (SELECT id, len(w) AS total, unnest(w) AS term FROM words) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({sql_words("lower(text)")}) AS term FROM benchmark) GROUP BY ALL),
fast AS (SELECT query_id, id, sum(times * tf / total * ln((SELECT count(*) FROM documents) / (1 + df))) AS score FROM counted JOIN asked USING (term) JOIN dfs USING (term) GROUP BY ALL HAVING score > 0)"""


@C.add("search_tree_fast", f"""
WITH {_FAST}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fast JOIN documents ON doc_id = id WHERE lang = 'en')
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}
""")  # fmt: skip
def _(t):
    m = t("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return r(S.fast_search(asked(t), m, K, F.col("lang") == "en"), "query_id", "id")


@C.add("search_two_stage", f"""
WITH {_FAST}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM fast),
s AS (SELECT query_id, id, score / ln(2 + strlen(text)) AS score FROM c JOIN documents ON doc_id = id WHERE k <= {3 * K}),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}
""")  # fmt: skip
def _(t):
    return r(S.two_stage_search(asked(t), memories(t), K, F.round(F.col("score") / F.ln(2 + F.octet_length("text")), 9)), "query_id", "id")


_E = "embedding::DOUBLE[]"
_PAIRS = f"q AS (SELECT vec_id AS query_id, {_E} AS q FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id AS id, {_E} AS v, label FROM embeddings), pairs AS (SELECT query_id, id, label, list_cosine_similarity(q, v) AS score, 1 / (1 + list_distance(q, v)) AS near, list_dot_product(q, v) AS dot FROM q, v)"


@C.add("search_semantic", f"WITH {_PAIRS}, r AS (SELECT query_id, id, round(score, 6) AS score, {_TOP} FROM pairs WHERE score > 0.1) SELECT * FROM r WHERE rank <= 10")
def _(t):
    return r(S.semantic_search(query_vectors(t), vectors(t), 10), "query_id", "id")


@C.add("knn_euclidean", f"WITH {_PAIRS}, r AS (SELECT query_id, id, round(near, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id) AS rank FROM pairs) SELECT * FROM r WHERE rank <= 10")
def _(t):
    return r(S.knn(query_vectors(t), vectors(t), 10, "euclidean"), "query_id", "id")


@C.add("knn_dot", f"WITH {_PAIRS}, r AS (SELECT query_id, id, round(dot, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank FROM pairs) SELECT * FROM r WHERE rank <= 10")
def _(t):
    return r(S.knn(query_vectors(t), vectors(t), 10, "dot"), "query_id", "id")


@C.add("knn_ivf")
def _(t):
    # the invented vectors hardly cluster, so most cells are probed: a recall of 0.95 and more (held by a test)
    index = I.build(vectors(t))
    return r(I.search(query_vectors(t), index, 10, -(-7 * len(index.centers.value) // 10)), "query_id", "id")


@C.add("vector_search_filtered", f"WITH {_PAIRS}, r AS (SELECT query_id, id, round(score, 6) AS score, {_TOP} FROM pairs WHERE label = 3 AND score > 0.05) SELECT * FROM r WHERE rank <= 10")
def _(t):
    inside = t("embeddings").filter("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return r(S.knn(query_vectors(t), inside, 10, min_score=0.05), "query_id", "id")


@C.add("search_threshold", f"WITH {_PAIRS} SELECT query_id, id, round(score, 6) AS score FROM pairs WHERE score > 0.3")
def _(t):
    return S.vector_scores(query_vectors(t), vectors(t), 2**31 - 1, min_score=0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@C.add("search_multi_collection", f"""
WITH {_PAIRS}, c AS (SELECT query_id, id, label AS collection, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS k FROM pairs WHERE label < 3),
r AS (SELECT query_id, id, collection, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection, id) AS rank FROM c WHERE k <= 5)
SELECT * FROM r WHERE rank <= 8
""")  # fmt: skip
def _(t):
    parts = []
    for label in range(3):
        inside = t("embeddings").filter(F.col("label") == label).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        parts.append(S.knn(query_vectors(t), inside, 5).drop("rank").withColumn("collection", F.lit(label)))
    return r(S.merge_results(parts, 8), "query_id", "id", "collection")


@C.add("search_merge_dedup", f"""
WITH {_PAIRS}, l AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM pairs WHERE label < 5),
m AS (SELECT query_id, id, 0.5 * score AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM pairs),
b AS (SELECT query_id, id, score, 0 AS source FROM l WHERE k <= 10 UNION ALL SELECT query_id, id, score, 1 FROM m WHERE k <= 10),
o AS (SELECT query_id, id, arg_min(score, source) AS score FROM b GROUP BY ALL),
r AS (SELECT query_id, id, round(score, 6) AS score, {_TOP} FROM o) SELECT * FROM r WHERE rank <= 10
""")  # fmt: skip
def _(t):
    low = t("embeddings").filter("label < 5").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    local = S.knn(query_vectors(t), low, 10).drop("rank")
    remote = S.knn(query_vectors(t), vectors(t), 10).drop("rank").withColumn("score", 0.5 * F.col("score"))
    return r(S.merge_dedup(local, remote, 10), "query_id", "id")


@C.add("search_hybrid", f"""
WITH {_FAST}, {_PAIRS}, lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fast),
sem AS (SELECT query_id // 50 AS query_id, id, {_TOP} FROM (SELECT * FROM pairs WHERE score > 0.1)),
b AS (SELECT query_id, id, 0 AS source, rank FROM lex WHERE rank <= 3 UNION ALL SELECT query_id, id, 1, rank FROM sem WHERE rank <= 8),
o AS (SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id, id ORDER BY source, rank) AS seen, rank FROM b),
r AS (SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, id) AS rank FROM o WHERE seen = 1) SELECT * FROM r WHERE rank <= 4
""")  # fmt: skip
def _(t):
    lexical = S.fast_search(asked(t), memories(t), 8)
    semantic = S.semantic_search(query_vectors(t), vectors(t), 8).withColumn("query_id", F.floor(F.col("query_id") / 50))
    return S.hybrid_merge(lexical, semantic, 4)


@C.add("search_cubes", f"""
WITH {_KEYWORD}, r AS (SELECT query_id, cube_id, id, score, row_number() OVER (PARTITION BY query_id, cube_id ORDER BY score DESC, id) AS rank FROM scores WHERE cube_id IN ('src0', 'src1', 'src2'))
SELECT * FROM r WHERE rank <= 2
""")  # fmt: skip
def _(t):
    cubes = t("documents").select(F.col("source").alias("cube_id")).filter("cube_id in ('src0', 'src1', 'src2')").distinct()
    return S.search_cubes(asked(t), memories(t), cubes, 2).select("query_id", "cube_id", "id", "score", "rank")


@C.add("build_context", f"""
WITH {_KEYWORD}, r AS (SELECT query_id, id, score, {_TOP} FROM scores)
SELECT query_id, 'Use these memories:' || chr(10) || chr(10) || string_agg(rank || '. ' || text, chr(10) ORDER BY rank) AS prompt FROM r JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY query_id
""")  # fmt: skip
def _(t):
    return S.build_context(S.keyword_search(asked(t), memories(t), 3), memories(t), "Use these memories:")


@C.add("working_memory", """
WITH r AS (SELECT user_id AS cube_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) SELECT * FROM r WHERE rank <= 10
""")
def _(t):
    m = t("events").select(F.col("user_id").alias("cube_id"), F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    return S.working_memory(m, 10).select("cube_id", "id", "rank")


@C.add("merge_working_memory", """
WITH b AS (SELECT conv_id % 50 AS user_id, text, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS part, conv_id * 1000 + turn AS pos FROM conversations),
o AS (SELECT user_id, text, min({'part': part, 'pos': pos}) AS first_at FROM b GROUP BY ALL),
r AS (SELECT user_id, text, row_number() OVER (PARTITION BY user_id ORDER BY first_at, text) AS place FROM o) SELECT * FROM r WHERE place <= 6
""")
def _(t):
    m = t("conversations").select((F.col("conv_id") % 50).alias("user_id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "role")
    return S.merge_working_memory(m.filter("role = 'user'").drop("role"), m.filter("role <> 'user'").drop("role"), 4, 2)


@C.add("evidence_budget", "SELECT conv_id AS query_id, turn, greatest(10 // count(*) OVER (PARTITION BY conv_id), 1) AS quota FROM conversations")
def _(t):
    return S.evidence_budget(t("conversations").select(F.col("conv_id").alias("query_id"), "turn"), 10)
