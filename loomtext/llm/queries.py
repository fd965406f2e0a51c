"""The registered queries of the thirteen operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, merkle, mixing, near_dedup, quality_rules, ranked_search, secret_scan, substring_dedup, token_files, url_filter, winnowing
from .stage import tables


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = tables(spark, sf_dir, "documents", "benchmark")
    return decontaminate.find_leaks(docs, items)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return substring_dedup.dedup_substrings(docs)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return mixing.mix_sources(docs)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages)


def word_tokenizer() -> str:
    """Where the vocabulary of the registered queries lies."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return token_files.token_table(docs, word_tokenizer())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return quality_rules.assess(docs)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the checksum of the id, the text loses its line ends before its leaf is folded."""
    (docs,) = tables(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return merkle.merkle_manifest(docs, F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = tables(spark, sf_dir, "documents", "benchmark")
    return ranked_search.search(docs, items)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return winnowing.compare_edits(docs)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_document_fingerprints": op13_document_fingerprints,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# A row is a document of its own (rid), whatever its id; a null id is smaller than all others.
_ROWS = "docs AS (SELECT *, row_number() OVER () AS rid, coalesce(doc_id, -9223372036854775808) AS id FROM documents)"

_OP3_SQL = rf"""
WITH {_ROWS}, lines AS (
  SELECT rid, id, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM docs),
keyed AS (
  SELECT *, regexp_replace({_LOWER.format("line")}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM lines),
often AS (
  SELECT key, max(id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT rid) >= 5),
marked AS (
  SELECT k.*, o.key IS NOT NULL AND o.keeper <> k.id AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

# For links an id is one node, and null ids are none.
_OP1_SQL = rf"""
WITH RECURSIVE {_ROWS}, words AS (
  SELECT rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM docs),
sets AS (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
items AS MATERIALIZED (SELECT rid, doc_id, len(s) AS n, unnest(s) AS g FROM sets WHERE doc_id IS NOT NULL),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.rid, b.rid, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM sets LEFT JOIN component ON node = doc_id
"""

_OP4_SQL = rf"""
WITH {_ROWS}, words AS (
  SELECT rid, id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT rid, id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS h FROM words),
later AS (
  SELECT rid, p FROM (SELECT rid, p, id > min(id) OVER (PARTITION BY h) OR p > min(p) OVER (PARTITION BY h, rid) AS again FROM windows) WHERE again),
gone AS (SELECT DISTINCT rid, p + o AS p FROM later, range(0, 20) AS r(o)),
each AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
marked AS (SELECT e.*, g.p IS NOT NULL AS removed FROM each e LEFT JOIN gone g USING (rid, p)),
summed AS (
  SELECT rid, count(*) FILTER (removed) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS kept FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN summed USING (rid)
"""

_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(license_scan.TEMPLATES))
_OP9_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
each AS (
  SELECT rid, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c
  FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM words)),
base AS (
  SELECT rid, i, CASE WHEN a = 'mit' THEN 'mit' WHEN a = 'apache' THEN 'apache' ELSE 'gpl' END AS label FROM each
  WHERE (a IN ('mit', 'apache') AND b = 'license') OR (a = 'general' AND b = 'public' AND c = 'license')),
templates AS (SELECT t.*, string_split(text, ' ') AS tw FROM (VALUES {_TEMPLATE_ROWS}) AS t(template, label, text)),
grams AS (
  SELECT template, label, len(tw) AS length, j, tw[j + 1] AS a, tw[j + 2] AS b, tw[j + 3] AS c
  FROM (SELECT *, unnest(range(0, len(tw) - 2)) AS j FROM templates)),
diagonals AS (
  SELECT rid, template, label, length, i - j AS d, list([i, j]) AS votes, min(i) AS lo, max(i) AS hi
  FROM each JOIN grams USING (a, b, c) GROUP BY ALL),
marked AS (
  SELECT *, coalesce(d - lag(d) OVER (PARTITION BY rid, template ORDER BY d) > 2, true)::INT AS apart FROM diagonals),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY d) AS span FROM marked),
merged AS (
  SELECT rid, template, label, length, span, min(lo) AS lo, max(hi) + 2 AS hi,
         list_reduce(list_transform(list_sort(flatten(list(votes))), lambda v: [v[2], 3]), lambda a, b: CASE WHEN b[1] > a[1] THEN [b[1], a[2] + least(3, b[1] - a[1])] ELSE a END)[2] AS covered
  FROM numbered GROUP BY rid, template, label, length, span),
good AS (
  SELECT rid, label, covered / length AS cover FROM merged
  WHERE covered / length >= 0.7 AND hi - lo + 1 <= 1.5 * length),
scored AS (SELECT rid, max(cover) AS score FROM good GROUP BY rid),
labelled AS (SELECT rid, label FROM base UNION SELECT rid, label FROM good),
named AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY rid),
summed AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words LEFT JOIN summed USING (rid) LEFT JOIN named USING (rid) LEFT JOIN scored USING (rid)
"""

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{what}')" for host, path, what in url_filter.RULES)
_OP6_SQL = rf"""
WITH parsed AS (
  SELECT page_id, coalesce(url, '') AS url,
         {_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query FROM pages),
tokens AS (
  SELECT *, list_sort(list_distinct(list_transform(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
    || list_transform(list_filter([array_to_string(string_split(host, '.')[-2:], '.')], lambda x: x <> ''), lambda x: 'd:' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || x)
    || list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x),
    lambda x: x[1:2] || regexp_replace(x[3:], '[0-9]+', '#', 'g')))) AS t FROM parsed),
rules(rule_host, rule_path, what) AS (VALUES {_RULE_ROWS}),
fixed AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(what, length(rule_host || rule_path)) AS fixed
  FROM tokens JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
judged AS MATERIALIZED (SELECT * FROM tokens LEFT JOIN fixed USING (page_id)),
known AS (SELECT page_id, t, fixed AS label FROM judged WHERE fixed IS NOT NULL AND len(t) > 0),
one AS (SELECT page_id, label, unnest(t) AS a FROM known),
ante AS (
  SELECT page_id, label, [a] AS x FROM one
  UNION ALL SELECT p.page_id, p.label, [p.a, q.a] FROM one p JOIN one q ON p.page_id = q.page_id AND p.a < q.a),
counted AS (SELECT x, count(*) AS n, count(*) FILTER (label = 'block') AS block, count(*) FILTER (label = 'allow') AS allow FROM ante GROUP BY x),
mined AS (
  SELECT x, label, m / n AS confidence FROM counted, LATERAL (VALUES ('block', block), ('allow', allow)) AS v(label, m)
  WHERE m >= ceil({url_filter.MIN_SUPPORT} * (SELECT count(*) FROM known)) AND m / n >= {url_filter.MIN_CONFIDENCE}),
open AS (SELECT DISTINCT t FROM judged WHERE fixed IS NULL),
best AS (
  SELECT t, coalesce(max(confidence) FILTER (label = 'block'), 0) > coalesce(max(confidence) FILTER (label = 'allow'), 0) AS blocked
  FROM open JOIN mined ON list_has_all(t, x) GROUP BY t)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN best USING (t)
"""

_BOILERPLATE = "|".join(quality_rules.BOILERPLATE)
_SOLID = r"[^\x20\x09-\x0D]+"
_count = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_OP8_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SOLID}') AS w FROM documents),
grams AS (SELECT doc_id, p, w[p:p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM texts)),
often AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM often, range(0, 3) AS r(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '{_SOLID}') AS w, {_count("line", "[|]")} AS bars, {_count("line", "[#*$%&<>]")} AS symbols,
         {_count("line", "[A-Z]")} AS upper, {_count("line", "[a-z]")} AS lower, {_count("line", f"[{quality_rules.MARKS}]")} AS marks
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)),
judged AS (
  SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars, len(w) > 0 AND (
    (bars >= {quality_rules.NAV_BARS} AND bars >= {quality_rules.NAV_SHARE} * len(w)) OR symbols >= greatest(1, {quality_rules.SYMBOL_SHARE} * len(w))
    OR (upper > lower AND len(w) > 2) OR (len(w) >= {quality_rules.FILLER_WORDS} AND 3 * len(list_distinct(w)) < len(w))
    OR (len(w) >= {quality_rules.MARK_WORDS} AND marks = 0) OR (len(w) <= {quality_rules.FURNITURE_WORDS} AND regexp_matches({_LOWER.format("line")}, '{_BOILERPLATE}'))) AS failed FROM lines),
summed AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS failed_chars,
         count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count("text", "[#*$%&|<>]")} AS n_symbols, n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, n_lines, n_failed_lines, failed_chars
  FROM texts JOIN summed USING (doc_id) LEFT JOIN repeated USING (doc_id)),
failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND failed_chars <= {quality_rules.MAX_LOST} * word_chars AS kept FROM failing
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """The nodes of trees of runs of three: {name}(tree, level, i, h) from a query of (tree, i, h), and {name}_top(tree, h)."""
    return f"""{name}(tree, level, i, h, n) AS (
  SELECT tree, 0, i, h, count(*) OVER (PARTITION BY tree) FROM ({leaves})
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3),
{name}_runs AS MATERIALIZED (SELECT tree, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL),
{name}_top AS MATERIALIZED (SELECT tree, h FROM {name} WHERE n = 1)"""


def _proof_sql(name: str, starts: str) -> str:
    """{name}_proof(rid, proof, top): the ways of a query of (rid, tree, i, h) to the tops, h folded with the siblings."""
    return f"""{name}_way(rid, tree, level, i, h, proof) AS (
  SELECT rid, tree, 0, i, h, '' FROM ({starts})
  UNION ALL
  SELECT rid, tree, level + 1, i // 3,
         sha256(array_to_string(list_transform(hs, lambda x, k: CASE WHEN k = i % 3 + 1 THEN h ELSE x END), '')),
         proof || array_to_string(list_filter(hs, lambda x, k: k <> i % 3 + 1), '')
  FROM {name}_way JOIN {name}_runs USING (tree, level) WHERE run = i // 3),
{name}_proof AS MATERIALIZED (SELECT rid, arg_max(proof, level) AS proof, arg_max(h, level) AS top FROM {name}_way GROUP BY rid)"""


_OP11_SQL = f"""
WITH RECURSIVE crc_bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
docs AS (SELECT *, row_number() OVER () AS rid FROM documents),
altered AS (
  SELECT rid, doc_id, coalesce(source, '') AS name, source IS NOT NULL AS named, {_LEAF.format("text")} AS leaf,
         CASE WHEN coalesce(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1, false)
           THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS changed
  FROM docs, crc_table),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY named, name) - 1 AS tree,
         row_number() OVER (PARTITION BY named, name ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i FROM altered),
{_tree_sql("nodes", "SELECT tree, i, leaf AS h FROM placed")},
{_tree_sql("upper", "SELECT 0 AS tree, tree AS i, h FROM nodes_top")},
{_proof_sql("own", "SELECT rid, tree, i, leaf AS h FROM placed")},
{_proof_sql("new", "SELECT rid, tree, i, changed AS h FROM placed").replace("new_runs", "nodes_runs")},
{_proof_sql("above", "SELECT rid, 0 AS tree, tree AS i, h FROM placed JOIN nodes_top USING (tree)")},
{_proof_sql("last", "SELECT p.rid, 0 AS tree, tree AS i, n.top AS h FROM placed p JOIN new_proof n USING (rid)")}
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(o.proof || a.proof) AS proof_sha256, l.top AS folded_root, l.top = r.h AS verified
FROM placed p JOIN nodes_top s USING (tree) CROSS JOIN upper_top r JOIN own_proof o USING (rid) JOIN above_proof a USING (rid) JOIN last_proof l USING (rid)
""".replace("own_runs", "nodes_runs").replace("above_runs", "upper_runs").replace("last_runs", "upper_runs")

_OP12_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents),
items AS (SELECT item_id, list_distinct(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w, row_number() OVER () AS item FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT rid, doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY rid, doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
scored AS (
  SELECT item, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM (SELECT item, item_id, unnest(w) AS term FROM items) JOIN weights USING (term) JOIN tf USING (term), total GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {ranked_search.K_BEST}
"""

ORACLE_SQL: dict[str, str] = {
    "op12_ranked_search": _OP12_SQL,
    "op11_merkle_manifest": _OP11_SQL,
    "op8_quality_rules": _OP8_SQL,
    "op6_url_filter": _OP6_SQL,
    "op9_license_scan": _OP9_SQL,
    "op4_substring_dedup": _OP4_SQL,
    "op1_near_dedup": _OP1_SQL,
    "op3_line_dedup": _OP3_SQL,
}
