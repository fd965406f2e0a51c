"""Registered queries of the text and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions import vectors as V

from .catalog import SQL_MARKS, SQL_N_WORDS, Catalog, sql_count, sql_words

C = Catalog()


def text_() -> F.Column:
    return F.col("text")

_quoted = lambda found: ", ".join(f"'{w}'" for w in found)
_LOW = sql_words("lower(text)")
_TRIMMED = f"list_transform({_LOW}, lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:\"''()\\[\\]]+', ''), '[.,!?;:\"''()\\[\\]]+$', ''))"


def r(c, n=6):
    return F.round(c, n)


@C.add("text_clean_words", f"""
SELECT doc_id, len(w) AS n_words, sha256(array_to_string(w, ' ')) AS words_sha256
FROM (SELECT doc_id, list_filter(list_transform({_LOW}, lambda w: regexp_replace(w, '[.,!?;:()\\[\\]{{}}"''\\-]', '', 'g')), lambda w: strlen(w) > 2) AS w FROM documents)
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", T.clean_words(text_(), 2).alias("w")).select("doc_id", F.size("w").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("words_sha256"))


@C.add("text_content_words", f"""
SELECT doc_id, len(w) AS n_words, sha256(array_to_string(list_sort(list_distinct(w)), ' ')) AS words_sha256
FROM (SELECT doc_id, list_filter(list_transform({_LOW}, lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:"''()\\[\\]{{}}]+', ''), '[.,!?;:"''()\\[\\]{{}}]+$', '')),
      lambda w: strlen(w) > 2 AND NOT w IN ({_quoted(T.STOP_WORDS)})) AS w FROM documents)
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", T.content_words(text_()).alias("w")).select("doc_id", F.size("w").alias("n_words"), F.sha2(F.array_join(F.array_sort(F.array_distinct("w")), " "), 256).alias("words_sha256"))


_THEME_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(found)}') THEN '{name}' END" for name, found in T.THEMES.items()) + "], lambda x: x IS NOT NULL)"


@C.add("text_themes", f"SELECT doc_id, array_to_string({_THEME_SQL}, ',') AS themes FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(T.themes(text_()), ",").alias("themes"))


@C.add("text_sentiment", f"""
WITH hits AS (
  SELECT conv_id, turn, {SQL_N_WORDS} AS n, len(list_filter({_TRIMMED}, lambda w: w IN ({_quoted(T.POSITIVE)}))) AS pos,
         len(list_filter({_TRIMMED}, lambda w: w IN ({_quoted(T.NEGATIVE)}))) AS neg FROM conversations),
p AS (SELECT *, CASE WHEN pos + neg > 0 THEN (pos - neg) / (pos + neg) ELSE 0.0 END AS polarity, coalesce((pos + neg) / nullif(n, 0), 0.0) AS share FROM hits)
SELECT conv_id, turn, round(polarity, 6) AS polarity, round(least(share, 1.0), 6) AS subjectivity,
       CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS emotion,
       round(CASE WHEN pos + neg > 0 THEN share ELSE 0.1 END, 6) AS confidence FROM p
""")  # fmt: skip
def _(t):
    s = t("conversations").select("conv_id", "turn", T.sentiment(text_()).alias("s")).select("conv_id", "turn", "s.*")
    return s.select("conv_id", "turn", r("polarity").alias("polarity"), r("subjectivity").alias("subjectivity"), "emotion", r("confidence").alias("confidence"))


_DIVERSITY = f"coalesce(len(list_distinct({_LOW})) / nullif(len({_LOW}), 0), 0.0)"
_BAND = "CASE WHEN strlen(text) < 10 THEN 0.2 WHEN strlen(text) < 50 THEN 0.5 WHEN strlen(text) < 200 THEN 0.8 ELSE 1.0 END"
_QUALITY = f"least(({_BAND} + 0.5 + CASE WHEN contains(text, chr(10)) THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '.') THEN 0.2 ELSE 0 END + CASE WHEN {SQL_N_WORDS} > 5 THEN 0.1 ELSE 0 END) / 2, 1.0)"
_STRUCT = "(" + " + ".join(f"contains(text, '{m}')::INT" for m in ".,;:!?-()[]") + ") / 11 + CASE WHEN contains(text, chr(10) || chr(10)) THEN 0.2 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, chr(10))) >= 3 THEN 0.1 ELSE 0 END"
_RATE = f"({SQL_N_WORDS} / {SQL_MARKS})"


@C.add("text_complexity", f"""
SELECT doc_id, round(least({_RATE} / 20, 1.0), 6) AS complexity,
       round(least(({_DIVERSITY} + {_RATE} / 20 + {_STRUCT}) / 3, 1.0), 6) AS semantic_complexity,
       round(least(0.5 * {_RATE} / 20 + 0.5 * {_DIVERSITY}, 1.0), 6) AS content_complexity FROM documents
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", r(T.complexity(text_())).alias("complexity"), r(T.semantic_complexity(text_())).alias("semantic_complexity"), r(T.content_complexity(text_())).alias("content_complexity"))


@C.add("text_quality", f"""
WITH d AS (
  SELECT doc_id, {_QUALITY} AS quality, {_BAND} AS length, CASE WHEN contains(text, chr(10)) THEN 0.3 ELSE 0 END + CASE WHEN contains(text, '.') THEN 0.3 ELSE 0 END
         + CASE WHEN contains(text, ',') THEN 0.2 ELSE 0 END + CASE WHEN {SQL_N_WORDS} > 5 THEN 0.2 ELSE 0 END AS structure,
         CASE WHEN {SQL_N_WORDS} = 0 THEN 0.0 WHEN {_RATE} BETWEEN 15 AND 20 THEN 1.0 WHEN {_RATE} BETWEEN 10 AND 25 THEN 0.8 ELSE 0.5 END AS readability,
         {_DIVERSITY} AS informativeness FROM documents)
SELECT doc_id, round(quality, 6) AS quality, round(length, 6)::DOUBLE AS length, round(structure, 6)::DOUBLE AS structure, readability::DOUBLE AS readability,
       round(informativeness, 6) AS informativeness, round((length + structure + readability + informativeness) / 4, 6) AS score,
       array_to_string(list_filter([CASE WHEN length < 0.5 THEN 'length' END, CASE WHEN structure < 0.5 THEN 'structure' END,
         CASE WHEN readability < 0.5 THEN 'readability' END, CASE WHEN informativeness < 0.5 THEN 'informativeness' END], lambda x: x IS NOT NULL), ',') AS issues FROM d
""")  # fmt: skip
def _(t):
    w = t("documents").select("doc_id", "text", T.words(F.lower("text")).alias("w"))
    w = w.select("doc_id", "text", F.explode_outer(F.array(T.lexical_diversity(text_(), F.col("w")))).alias("diversity"))
    d = w.select("doc_id", r(T.quality(text_())).alias("quality"), T.assess_quality(text_(), F.col("diversity")).alias("a")).select("doc_id", "quality", "a.*")
    return d.select("doc_id", "quality", *[r(c).alias(c) for c in ("length", "structure", "readability", "informativeness", "score")], F.array_join("issues", ",").alias("issues"))


_SYLLABLES = f"list_sum(list_transform({_LOW}, lambda w: greatest(len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)))"


@C.add("text_readability", f"""
SELECT doc_id, round(CASE WHEN {SQL_N_WORDS} = 0 THEN 0.0 ELSE least(greatest(206.835 - 1.015 * {SQL_N_WORDS} / {SQL_MARKS} - 84.6 * {_SYLLABLES} / {SQL_N_WORDS}, 0.0), 100.0) END, 9) AS flesch,
       round(CASE WHEN {SQL_N_WORDS} = 0 THEN 0.0 ELSE least(greatest(100 - 1.015 * {SQL_N_WORDS} / {SQL_MARKS} - 84.6 * strlen(text) / {SQL_N_WORDS}, 0.0), 100.0) END, 6) AS simple FROM documents
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", r(T.flesch(text_()), 9).alias("flesch"), r(T.readability_simple(text_())).alias("simple"))


@C.add("text_structure", f"""
SELECT doc_id, {sql_count("text", "#")} + {sql_count("text", "<h")} AS headers, {sql_count("text", "- ")} + {sql_count("text", "[*] ")} AS lists,
       {sql_count("text", "```")} // 2 AS code_blocks, {sql_count("text", "[|]")} // 3 AS tables, {sql_count("text", "[.!?]+")} AS sentences, {SQL_N_WORDS} AS words,
       strlen(text) AS bytes, contains(text, '?') AS has_question, contains(text, '!') AS has_emphasis,
       round(coalesce(strlen(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) / nullif(strlen(text), 0), 0.0), 6) AS density FROM documents
""")  # fmt: skip
def _(t):
    d = t("documents").select("doc_id", T.structure_counts(text_()).alias("a"), T.chunk_structure(text_()).alias("b"), r(T.content_density(text_())).alias("density"))
    return d.select("doc_id", "a.headers", "a.lists", "a.code_blocks", "a.tables", "b.sentences", "b.words", "b.bytes", "b.has_question", "b.has_emphasis", "density")


@C.add("text_language_and_type", f"""
SELECT doc_id, CASE WHEN coalesce(len(list_filter({sql_words("lower(substr(text, 1, 1000))")}, lambda w: w IN ({_quoted(T.ENGLISH)}))) / nullif(len({sql_words("lower(substr(text, 1, 1000))")}), 0), 0.0) > 0.1 THEN 'en' ELSE 'unknown' END AS language,
       CASE WHEN regexp_matches(text, 'function|class |import |```') THEN 'code' WHEN regexp_matches(text, 'https?://|www\\.') THEN 'web_content'
            WHEN contains(text, '@') AND contains(text, '.') THEN 'contact_info' ELSE 'text' END AS content_type FROM documents
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", T.detect_language(text_()).alias("language"), T.content_type(text_()).alias("content_type"))


_PUNCT = sql_count("text", "[.,!?;:()\\[\\]{}\"'']")


@C.add("text_token_counts", f"""
SELECT doc_id, {SQL_N_WORDS} + {_PUNCT} // 2 AS by_word, {SQL_N_WORDS} + {_PUNCT} + {sql_count("text", chr(92) + "n")} + {sql_count("text", chr(92) + "t")} AS simple,
       {sql_count("text", "''(?:s|t|re|ve|m|ll|d)" + chr(92) + "b")} + {sql_count("text", "[^" + chr(92) + "w" + chr(92) + "s]")} + {sql_count("text", chr(92) + "w+")} AS by_regex,
       coalesce(list_sum(list_transform({sql_words("text")}, lambda w: 1 + greatest((strlen(w) - 6) // 3, 0))), 0)::BIGINT + {sql_count("text", "[.,!?;:]")} AS long_words,
       2 + coalesce(list_sum(list_transform({sql_words("text")}, lambda w: CASE WHEN strlen(w) <= 4 THEN 1 WHEN strlen(w) <= 8 THEN 2 ELSE ceil(strlen(w) / 4)::INT END)), 0)::BIGINT AS pieces,
       strlen(text) // 4 AS chars FROM documents
""")  # fmt: skip
def _(t):
    kinds = {"by_word": "word", "simple": "simple", "by_regex": "regex", "long_words": "long_words", "pieces": "pieces", "chars": "chars"}
    return t("documents").select("doc_id", *[T.count_tokens(text_(), k).alias(n) for n, k in kinds.items()])


@C.add("text_preprocess", """
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE regexp_replace(substr(s, 1, 200), ' [^ ]*$', '') END AS text FROM s
""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", T.preprocess_text(text_(), 50).alias("text"))


_OPENERS = T.TRANSITIONS + T.LIST_OPENERS


@C.add("text_topic_boundary", f"""
WITH cw AS (
  SELECT conv_id, turn, text, list_filter(list_transform({_LOW}, lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:"''()\\[\\]{{}}]+', ''), '[.,!?;:"''()\\[\\]{{}}]+$', '')),
      lambda w: strlen(w) > 2 AND NOT w IN ({_quoted(T.STOP_WORDS)})) AS w FROM conversations),
p AS (SELECT conv_id, turn, text, w, lead(text) OVER o AS nt, lead(w) OVER o AS nw FROM cw WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, ({" OR ".join(f"starts_with(lower(nt), '{o}')" for o in _OPENERS)}) OR (ends_with(text, '?') AND NOT ends_with(nt, '?'))
       OR (len(w) > 0 AND len(nw) > 0 AND len(list_intersect(w, nw)) / len(list_distinct(w || nw)) < 0.2) AS boundary
FROM p WHERE nt IS NOT NULL
""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    o = Window.partitionBy("conv_id").orderBy("turn")
    p = t("conversations").select("conv_id", "turn", "text", F.lead("text").over(o).alias("after")).filter("after is not null")
    return p.select("conv_id", "turn", T.is_topic_boundary(text_(), F.col("after")).alias("boundary"))


_RULE_SQL = "CASE " + " ".join(f"WHEN strlen(text) BETWEEN {lo} AND {hi} AND regexp_matches(lower(text), '{'|'.join(k)}') THEN '{rule}'" for rule, _, _, k, lo, hi in T.MEMORY_RULES) + " END"


@C.add("text_extract_memory", f"""
WITH m AS (SELECT conv_id, turn, text, {_RULE_SQL} AS rule FROM conversations)
SELECT conv_id, turn, rule, CASE rule WHEN 'important_facts' THEN 'fact' WHEN 'preferences' THEN 'preference' ELSE 'personal' END AS category,
       CASE rule WHEN 'important_facts' THEN 0.8 WHEN 'preferences' THEN 0.7 ELSE 0.9 END::DOUBLE AS importance FROM m WHERE rule IS NOT NULL
""")  # fmt: skip
def _(t):
    return t("conversations").select("conv_id", "turn", T.extract_memory(text_()).alias("m")).filter("m is not null").select("conv_id", "turn", "m.*")


@C.add("text_insights", """
SELECT event_id, array_to_string(list_filter([CASE WHEN strlen(props) > 500 THEN 'long content' END, CASE WHEN strlen(props) < 50 THEN 'short content' END,
  CASE WHEN contains(props, '?') THEN 'holds questions' END, CASE WHEN contains(props, '!') THEN 'holds emphasis' END,
  CASE WHEN epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts) > 30 * 86400000000 THEN 'older than a month' END], lambda x: x IS NOT NULL), ',') AS insights FROM events
""")  # fmt: skip
def _(t):
    now = F.to_timestamp(F.lit("2024-03-01"))
    return t("events").select("event_id", F.array_join(T.insights(F.col("props"), F.col("ts"), F.col("ts"), now), ",").alias("insights"))


@C.add("text_relevance", f"""
SELECT event_id, round(0.4 * {_QUALITY.replace("text", "props")} + 0.3 * exp(-((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 86400000000) / 30)
       + 0.3 * least(len(regexp_extract_all(props, '\\S+')) / 100, 1.0), 6) AS relevance FROM events
""")  # fmt: skip
def _(t):
    return t("events").select("event_id", r(T.relevance(F.col("props"), F.col("ts"), F.to_timestamp(F.lit("2024-03-01")))).alias("relevance"))


_E = "embedding::DOUBLE[]"


@C.add("vector_stats", f"""
SELECT vec_id, len(embedding) AS dims, round(list_avg({_E}), 6) AS mean, round(list_stddev_pop({_E}), 6) AS stddev,
       round(list_min({_E}), 6) AS min, round(list_max({_E}), 6) AS max, round(sqrt(list_dot_product({_E}, {_E})), 6) AS norm FROM embeddings
""")  # fmt: skip
def _(t):
    s = t("embeddings").select("vec_id", V.vector_stats(F.col("embedding")).alias("s")).select("vec_id", "s.*")
    return s.select("vec_id", "dims", *[r(c).alias(c) for c in ("mean", "stddev", "min", "max", "norm")])


@C.add("vector_similarities", f"""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity({_E}, q), 6) AS cosine, round(list_distance({_E}, q), 6) AS l2, round(list_dot_product({_E}, q), 6) AS dot FROM embeddings, q
""")  # fmt: skip
def _(t):
    e = t("embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    both, a, b = e.join(F.broadcast(q)), F.col("embedding"), F.col("q")  # one row
    return both.select("vec_id", r(V.cosine(a, b)).alias("cosine"), r(V.l2(a, b)).alias("l2"), r(V.dot(a, b)).alias("dot"))


@C.add("vector_prune_quantize", f"""
SELECT vec_id, round(list_sum(list_transform({_E}, lambda x: CASE WHEN abs(x) < 0.1 THEN 0 ELSE x END)), 6) AS pruned_sum,
       len(list_filter({_E}, lambda x: abs(x) < 0.1)) AS n_pruned, round(list_sum(list_transform({_E}, lambda x: trunc(x * 16) / 16)), 6) AS quantized_sum FROM embeddings
""")  # fmt: skip
def _(t):
    e = F.col("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return t("embeddings").select("vec_id", r(total(V.prune_weights(e, 0.1))).alias("pruned_sum"), F.size(F.filter(e, lambda x: F.abs(x) < 0.1)).alias("n_pruned"), r(total(V.quantize(e, 4))).alias("quantized_sum"))


@C.add("vector_valid", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("valid"))
