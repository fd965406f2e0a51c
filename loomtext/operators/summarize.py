"""Summaries of collections, one-memory analyses, sequences and memories that fit no pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T

from .analyze import micros, shared_keywords
from .words import of_ids, repeated_ids, top_words

#: Hash functions of the coherence estimate.
ESTIMATES = 64


def mean_jaccard(df: DataFrame, estimate: bool = False) -> DataFrame:
    """(group, coherence): the mean Jaccard similarity of the word sets of all pairs of a group (id, group, text); 1 for one memory.

    Exact: pairs that share a word are joined within their group; the others
    add nothing.  With estimate: the share of pairs whose smallest word hash
    agrees, over ESTIMATES hash functions, which is their mean similarity in
    expectation; it counts equal values, so its work doesn't grow with pairs.
    """
    sizes = df.groupBy("group").agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    sets = df.select("group", "id", F.array_distinct(T.words(F.lower("text"))).alias("w")).filter(F.size("w") > 0)
    if estimate:
        # compiled aggregates by row, which Spark cuts to a row each before it shuffles
        each = sets.withColumn("row", F.monotonically_increasing_id()).select("group", "row", F.explode("w").alias("word"))
        least = each.groupBy("group", "row").agg(*[F.min(F.xxhash64(F.lit(k), F.col("word"))).alias(f"least_{k}") for k in range(ESTIMATES)])
        hashed = least.select("group", F.posexplode(F.array(*[f"least_{k}" for k in range(ESTIMATES)])).alias("k", "least"))
        alike = hashed.groupBy("group", "k", "least").agg(F.count("*").alias("c")).groupBy("group").agg((F.sum(F.col("c") * (F.col("c") - 1) / 2) / ESTIMATES).alias("total"))
    else:
        each = sets.select("group", "id", F.size("w").alias("m"), F.explode("w").alias("word"))
        other = each.select("group", F.col("id").alias("id_2"), F.col("m").alias("m_2"), "word")
        shared = each.join(other, ["group", "word"]).filter("id < id_2").groupBy("group", "id", "id_2").agg(F.count("*").alias("s"), (F.first("m") + F.first("m_2")).alias("m"))
        alike = shared.groupBy("group").agg(F.sum(F.col("s") / (F.col("m") - F.col("s"))).alias("total"))
    return sizes.join(alike, "group", "left").select("group", F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce("total", F.lit(0.0)) / pairs).alias("coherence"))


def capitalised(c: Column) -> Column:
    """The words whose first character isn't a small letter; only ASCII counts."""
    return F.filter(T.words(c), lambda w: w.rlike(r"^[\x00-\x60\x7B-\x7F]"))


def entities(df: DataFrame) -> DataFrame:
    """(group, entity, n): the capitalised words of each group."""
    return df.select("group", F.explode(capitalised(F.col("text"))).alias("entity")).groupBy("group", "entity").agg(F.count("*").alias("n"))


def first_sentences(df: DataFrame, max_bytes: int, points: int) -> DataFrame:
    """(group, summary, key_points): sentences of (id, group, text) by id and place, up to so many bytes; the first few as points.

    A sentence has a byte at least, so only the first max_bytes or points of a
    group can matter; Spark cuts each partition to those before it shuffles.
    """
    each = df.select("group", "id", F.posexplode(F.transform(F.split("text", r"\."), lambda s: F.trim(s))).alias("k", "s")).filter("s <> ''")
    order = Window.partitionBy("group").orderBy("id", "k")
    each = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(max_bytes, points))
    each = each.withColumn("bytes", F.sum(F.octet_length("s") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = lambda fits: F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("place", "s")))), lambda x: x["s"])
    out = each.groupBy("group").agg(listed(F.col("bytes") <= max_bytes).alias("kept"), listed(F.col("place") <= points).alias("key_points"))
    return out.select("group", F.array_join(F.transform("kept", lambda s: F.concat(s, F.lit("."))), " ").alias("summary"), "key_points")


def summarize_collection(df: DataFrame, max_bytes: int = 500, points: int = 5, top_themes: int = 5, estimate: bool = False) -> DataFrame:
    """One row per group of (id, group, text): summary, key points, top themes, capitalised words, complexity, coherence, completeness."""
    text = F.col("text")
    figures = df.groupBy("group").agg(F.count("*").alias("memories"), F.avg(T.complexity(text)).alias("complexity"), F.least(F.avg(F.octet_length(text)) / 200, F.lit(1.0)).alias("completeness"), F.sum(F.size(capitalised(text))).alias("n_entities"))
    counted = df.select("group", F.explode(T.themes(text)).alias("theme")).groupBy("group", "theme").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "theme"))).filter(F.col("k") <= top_themes)
    themes = ranked.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "theme"))), lambda x: x["theme"]).alias("themes"))
    out = figures.join(first_sentences(df, max_bytes, points), "group", "left").join(themes, "group", "left").join(mean_jaccard(df, estimate), "group")
    none = F.array().cast("array<string>")
    return out.select("group", "memories", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("key_points", none).alias("key_points"), F.coalesce("themes", none).alias("themes"), "n_entities", "complexity", "coherence", "completeness")


def analyze_memory(df: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """(id, keywords, themes, sentiment, complexity, quality, insights) of each (id, text, created_at, updated_at).

    Each in its row; only rows whose id stands in several get their common keywords by a join.
    """
    c, none = F.col("text"), F.array().cast("array<string>")
    repeated = repeated_ids(df)
    rows = df.select("id", T.themes(c).alias("themes"), T.word_count(c).alias("n"), T.complexity(c).alias("complexity"), T.quality(c).alias("quality"), T.insights(c, F.col("created_at"), F.col("updated_at"), now).alias("insights"), T.words(F.lower(c)).alias("words"))
    found = top_words(rows, k, 3)
    found = found.withColumn("sentiment", T.sentiment_of(F.col("positive"), F.col("negative"), F.col("n")))
    out = found.select("id", F.when(F.col("id").isNotNull(), F.col("keywords")).otherwise(none).alias("keywords"), "themes", "sentiment", "complexity", "quality", "insights")
    if repeated is None:
        return out
    common = shared_keywords(of_ids(df, repeated, True), k, 3)
    joined = of_ids(out, repeated, True).drop("keywords").join(common, "id", "left").withColumn("keywords", F.coalesce("keywords", none))
    return of_ids(out, repeated, False).unionByName(joined)


def frequent_openers(df: DataFrame, k: int = 5) -> DataFrame:
    """(id, word, n, rank): words of more than four bytes among the first five of the longer sentences, the k most frequent; ties by word."""
    s = df.select("id", F.explode(F.transform(F.split("text", r"\."), lambda s: F.trim(s))).alias("s")).filter(F.octet_length("s") > 20)
    w = s.select("id", T.words(F.lower("s")).alias("w")).filter(F.size("w") > 5)
    counted = w.select("id", F.explode(F.slice("w", 1, 5)).alias("word")).filter(F.octet_length("word") > 4).groupBy("id", "word").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= k)


def next_within(df: DataFrame, hours: float) -> DataFrame:
    """(group, id, next_id): each memory of (id, group, ts) and the next one of its group, if that is less than so many hours later.

    Memories are dealt by group and time bucket, each to its own bucket and
    the one before, where it is only looked at; so a group is many tasks' work.
    """
    width = int(hours * 3_600_000_000)
    timed = df.select("id", "group", micros("ts").alias("us")).withColumn("own", F.floor(F.col("us") / width))
    dealt = timed.select("id", "group", "us", "own", F.explode(F.array("own", F.col("own") - 1)).alias("bucket"))
    order = Window.partitionBy("group", "bucket").orderBy("us", "id")
    ahead = dealt.withColumn("next_id", F.lead("id").over(order)).withColumn("next_us", F.lead("us").over(order))
    return ahead.filter(F.col("own") == F.col("bucket")).filter(F.col("next_us") - F.col("us") < width).select("group", "id", "next_id")


def temporal_triples(df: DataFrame, hours: float = 24, overlap: float = 0.5) -> DataFrame:
    """(group, a, b, c, support): three memories in a row of (id, group, ts, text), each less than so many hours and above a word overlap from the next."""
    sets = df.select("id", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    near = next_within(df, hours)
    alike = near.join(sets.toDF("id", "w1"), "id").join(sets.toDF("next_id", "w2"), "next_id").select("group", "id", "next_id", T.set_jaccard(F.col("w1"), F.col("w2")).alias("s")).filter(F.col("s") > overlap)
    after = alike.select("group", F.col("id").alias("b"), F.col("next_id").alias("c"), F.col("s").alias("s2"))
    return alike.select("group", F.col("id").alias("a"), F.col("next_id").alias("b"), "s").join(after, ["group", "b"]).select("group", "a", "b", "c", ((F.col("s") + F.col("s2")) / 2).alias("support"))


def pattern_outliers(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id): memories of (id, text) that fit none of the patterns (type, instances ARRAY); none if there are no patterns.

    A memory fits a semantic pattern with more than 50 bytes, a topic or
    sentiment pattern that names one of its themes or its emotion, any
    temporal pattern, and a structural one (short, long, structured,
    questions) by its form.  The patterns make one row, which is broadcast:
    themes, emotions and forms are a few fixed names.
    """
    named = lambda kind: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == kind, F.col("instances"))))).alias(kind)
    held = patterns.agg(F.count("*").alias("patterns"), F.coalesce(F.max(F.col("type") == "semantic"), F.lit(False)).alias("semantic"), F.coalesce(F.max(F.col("type") == "temporal"), F.lit(False)).alias("temporal"), named("topic"), named("sentiment"), named("structural"))
    c, n = F.col("text"), F.octet_length("text")
    forms = {"short": n < 100, "long": n > 500, "structured": F.contains(c, F.lit("\n")) & F.contains(c, F.lit(".")), "questions": F.contains(c, F.lit("?"))}
    fits = [F.col("temporal"), F.col("semantic") & (n > 50), F.arrays_overlap("topic", T.themes(c)), F.array_contains("sentiment", T.sentiment(c)["emotion"])]
    fits += [F.array_contains("structural", name) & form for name, form in forms.items()]
    # the cheap tests first: themes and sentiment are worked out for what is left, and only if a pattern asks
    fits = fits[:2] + fits[4:] + [(F.size("topic") > 0) & fits[2], (F.size("sentiment") > 0) & fits[3]]
    any_fit = reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in fits])
    return df.join(F.broadcast(held)).filter((F.col("patterns") > 0) & ~any_fit).select("id")
