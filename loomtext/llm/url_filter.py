"""URL filters: fixed host/path rules, then association rules over URL tokens.

A fixed rule fits its host and all subdomains if the url's path starts with
the rule's; the longest fitting rule decides.  Urls that no rule fits are
judged by association rules: the labelled urls (by default those the fixed
rules decide) give transactions of tokens plus the label, FP-growth mines the
frequent ones, and rules {tokens} -> label with enough support and confidence
are kept, however many tokens they have, unless a part of the tokens tells the
label as surely.  A url is blocked when the most confident rule for "block" among
those that fit is more confident than every fitting rule for "allow".

A token that only urls of one label have is a rule of its own, as sure as can be,
so no larger set with it can change a verdict: it is left out of the mining, and
any number of such tokens that often stand together cost nothing.
Tokens that the labelled urls always have together (a host's labels, say) are
one item for mining, so k of them don't make 2**k itemsets; a url with any of
them has the item, since a rule with another one of them is as sure.  Only
tokens frequent enough to be in a rule are mined; there are at most tokens a
url / MIN_SUPPORT of them.

Rules are matched by an inverted index on their rarest token.  Urls are
matched once per distinct token set (numbers are folded), so a host with a
third of all pages costs one set for each shape of its urls; the verdict is
joined back on the set.

Edge cases: a null url or one without "://" has empty host and path, no
tokens, no rule and is allowed; repeated rows are judged alike; an empty
table, or no labelled rows, gives no association rules; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import Scratch

# Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Host labels, the last two together, path segments and query keys; digit runs become '#'."""
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), fold(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    domain = F.substring_index(host, ".", -2)
    parts = F.concat(named("h:", F.split(host, r"\.")), named("d:", F.array(domain)), named("p:", F.split(path, "/")), named("q:", keys))
    return F.array_sort(F.array_distinct(parts))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(the fitting rule as text, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def frequent_items(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, item): the tokens of rows (tokens, label) that reach the support; those that always stand together share an item."""
    least = labelled.agg(F.ceil(F.count("*") * min_support).alias("least"))
    each = labelled.withColumn("row", F.xxhash64("tokens", "label")).select("row", F.explode("tokens").alias("token"))
    # equal counts and equal sums of row hashes: the same rows (up to a chance of about 2**-64 a pair)
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("rows"))
    often = marks.join(F.broadcast(least)).filter("n >= least")  # one row
    return often.groupBy("n", "rows").agg(F.collect_list("token").alias("tokens"), F.min("token").alias("item")).select(F.explode("tokens").alias("token"), "item")


def as_items(rows: DataFrame, items: DataFrame, *keep: str) -> DataFrame:
    """Rows with tokens, each set written as its items; sets without one drop out."""
    each = rows.select(*keep, "tokens", F.explode("tokens").alias("token")).join(F.broadcast(items), "token")  # at most tokens a url / MIN_SUPPORT rows
    return each.groupBy(*keep, "tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, support_of: int | None = None) -> DataFrame:
    """(antecedent, label, confidence, index_token) from rows (tokens, label); support counts of support_of rows, by default these."""
    if support_of is not None:
        min_support = min(1.0, min_support * support_of / max(1, labelled.count()))
    scratch = Scratch(labelled.sparkSession, "url-rules")
    least = F.lit(math.ceil(min_support * labelled.count() - 1e-9))
    each = labelled.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.max("label").alias("other"))
    pure = scratch.keep(each.filter((F.col("label") == F.col("other")) & (F.col("n") >= least)).select("token", "label"))
    listed = pure.agg(F.collect_list("token").alias("pure"))  # at most tokens a url / MIN_SUPPORT
    items = labelled.join(F.broadcast(listed)).select(F.concat(F.array_except("tokens", "pure"), F.array(F.concat(F.lit("="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.select("antecedent", F.col("consequent")[0].alias("label"), "confidence")
    rules = rules.filter(F.col("label").startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rules = rules.select("antecedent", F.expr("substring(label, 2)").alias("label"), "confidence")
    rarest = rules.select("antecedent", F.explode("antecedent").alias("token")).distinct().join(often, "token").groupBy("antecedent").agg(F.min(F.struct("n", "token")).alias("r"))
    rules = rules.join(rarest, "antecedent").select("antecedent", "label", "confidence", F.col("r.token").alias("index_token"))
    alone = pure.select(F.array("token").alias("antecedent"), "label", F.lit(1.0).alias("confidence"), F.col("token").alias("index_token"))
    return without_redundant(scratch.keep(rules)).unionByName(alone)


def without_redundant(rules: DataFrame) -> DataFrame:
    """Rules of which no proper subset has the same label and at least the same confidence.

    A subset fits wherever the rule does, so no verdict changes.
    """
    smaller = rules.toDF("subset", "label", "at_least", "index_token")
    each = rules.select("antecedent", "label", "confidence", F.explode("antecedent").alias("index_token"))
    found = each.join(smaller, ["index_token", "label"]).filter((F.size("subset") < F.size("antecedent")) & (F.col("at_least") >= F.col("confidence")))
    redundant = found.filter(F.size(F.array_except("subset", "antecedent")) == 0).select("antecedent", "label").distinct()
    return rules.join(redundant, ["antecedent", "label"], "left_anti").select(rules.columns)


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) for each distinct token set that a rule fits."""
    found = sets.select("tokens", F.explode("tokens").alias("index_token")).join(rules, "index_token")
    found = found.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = lambda label: F.coalesce(F.max(F.when(F.col("label") == label, F.col("confidence"))), F.lit(0.0))
    return found.groupBy("tokens").agg(F.when(best("block") > best("allow"), "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    labelled, if given, has (url, label) rows with labels allow or block.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")

    def parsed(df: DataFrame, *keep: str) -> DataFrame:
        url = F.col("url")
        split = df.select(*keep, "url", url_host(url).alias("host"), url_path(url).alias("path"))
        return split.select(*keep, "host", "path", url_tokens(url, F.col("host"), F.col("path")).alias("tokens"))

    seen = parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "id")
    rule, fixed = longest_rule(F.col("host"), F.col("path"), rules)
    seen = scratch.keep(seen.select("*", rule.alias("rule"), fixed.alias("fixed")))
    known = seen.filter("fixed is not null").select("tokens", F.col("fixed").alias("label")) if labelled is None else parsed(labelled, "label").select("tokens", "label")
    known = known.filter(F.size("tokens") > 0)
    verdicts = None
    if not known.isEmpty():
        items = scratch.keep(frequent_items(known))
        # rows are told apart by their number, as equal ones all count
        numbered = known.withColumn("row", F.monotonically_increasing_id())
        mined = scratch.keep(mine_rules(as_items(scratch.keep(numbered), items, "row", "label").select(F.col("items").alias("tokens"), "label"), support_of=known.count()))
        open_sets = as_items(seen.filter("fixed is null").select("tokens").distinct(), items)
        verdicts = match_rules(open_sets.select(F.col("items").alias("tokens")).distinct(), mined)
        verdicts = open_sets.join(verdicts.withColumnRenamed("tokens", "items"), "items").select("tokens", "verdict")
    open_ = seen.join(verdicts, "tokens", "left") if verdicts is not None else seen.withColumn("verdict", F.lit(None).cast("string"))
    return open_.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", "verdict", F.lit("allow")).alias("verdict"))
