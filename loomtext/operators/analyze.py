"""Analyses of whole collections: statistics, patterns, timelines, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.shared import Scratch, bounded

from . import ordered as O
from .words import of_ids, repeated_ids, top_words

DAY = 86_400_000_000


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def collection_stats(df: DataFrame) -> DataFrame:
    n, q = F.octet_length("text"), T.quality(F.col("text"))
    return df.select(n.alias("n"), q.alias("q")).agg(F.count("*").alias("items"), F.avg("n").alias("avg_length"), F.median("n").alias("median_length"), F.stddev_pop("n").alias("stddev_length"), F.avg("q").alias("avg_quality"), F.stddev_pop("q").alias("stddev_quality"))


def collection_quality(df: DataFrame) -> DataFrame:
    a = df.select(T.assess_quality(F.col("text")).alias("a")).select("a.*")
    return a.agg(*[F.avg(c).alias(c) for c in ("length", "structure", "readability", "informativeness", "score")])


def creation_rate(df: DataFrame, *by: str) -> DataFrame:
    """Items per hour between the first and the last, by group."""
    hours = (F.max("us") - F.min("us")) / 3_600_000_000
    return df.withColumn("us", micros("ts")).groupBy(*by).agg(F.count("*").alias("items"), F.coalesce(F.try_divide(F.count("*"), hours), F.lit(0.0)).alias("per_hour"))


def update_frequency(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("updated_at") > F.col("created_at")).cast("double")).alias("updated_share"))


def theme_histogram(df: DataFrame) -> DataFrame:
    return df.select(F.explode(T.themes(F.col("text"))).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


def daily_timeline(df: DataFrame) -> DataFrame:
    """(id, ts, text) per day: count, and what kind of day it was."""
    long, asks = F.avg(F.octet_length("text")), F.avg(F.contains("text", F.lit("?")).cast("double"))
    kinds = F.array_compact(F.array(F.when(F.count("*") > 10, "high_activity"), F.when(long > 500, "long_form"), F.when(asks > 0.5, "inquiry")))
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.array_join(kinds, ",").alias("kinds"))


def frequent_words(df: DataFrame, min_support: float = 0.01, n: int | None = None) -> DataFrame:
    """Words of more than 3 bytes: occurrences divided by memories, at least min_support."""
    total = df.agg(F.count("*").alias("total"))
    counted = df.select(F.explode(T.words(F.lower("text"))).alias("word")).filter(F.octet_length("word") > 3).groupBy("word").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total)).withColumn("support", F.col("n") / F.col("total")).filter(F.col("support") >= min_support).select("word", "n", "support")


def corpus_tfidf(df: DataFrame) -> DataFrame:
    """Words of more than 3 bytes in more than one memory: int(1000 * df / N * ln(N / df))."""
    total = df.agg(F.count("*").alias("total"))
    each = df.select("id", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("word")).filter(F.octet_length("word") > 3)
    counted = each.groupBy("word").agg(F.count("*").alias("df")).filter("df > 1").join(F.broadcast(total))
    return counted.select("word", "df", F.floor(1000 * F.col("df") / F.col("total") * F.ln(F.col("total") / F.col("df"))).cast("int").alias("weight"))


def format_frequencies(df: DataFrame) -> DataFrame:
    has = {"question": F.contains("text", F.lit("?")), "statement": F.contains("text", F.lit(".")), "exclamation": F.contains("text", F.lit("!")), "list": F.col("text").rlike(r"(?m)^\s*[-*] ")}
    return df.agg(*[F.count_if(c).alias(k) for k, c in has.items()]).unpivot([], list(has), "format", "n")


def length_profile(df: DataFrame) -> DataFrame:
    """Shares of short and long memories against the whole-number mean length, and of formats."""
    n = F.octet_length("text")
    mean = df.agg(F.floor(F.avg(n)).alias("mean"))
    both = df.select(n.alias("n"), "text").join(F.broadcast(mean))
    return both.agg(F.avg((F.col("n") < F.floor(F.col("mean") / 2)).cast("double")).alias("short"), F.avg((F.col("n") > 2 * F.col("mean")).cast("double")).alias("long"), F.avg((F.contains("text", F.lit("\n")) & F.contains("text", F.lit("."))).cast("double")).alias("structured"), F.avg(F.contains("text", F.lit("?")).cast("double")).alias("questions"))


def topic_patterns(df: DataFrame, min_support: float) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return theme_histogram(df).join(F.broadcast(total)).withColumn("support", F.col("n") / F.col("total")).filter(F.col("support") >= min_support).select("theme", "n", "support")


def sentiment_patterns(df: DataFrame, min_support: float) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    counted = df.select(T.sentiment(F.col("text"))["emotion"].alias("emotion")).groupBy("emotion").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total)).withColumn("support", F.col("n") / F.col("total")).filter(F.col("support") >= min_support).select("emotion", "n", "support")


def keywords(df: DataFrame, k: int = 5, min_bytes: int = 3) -> DataFrame:
    """(id, keywords): the k most frequent words of more than min_bytes bytes, edge marks trimmed; ties by word.

    Counted in a row; only rows whose id stands in several count together, by a shuffle.
    """
    repeated = repeated_ids(df)
    single = df if repeated is None else of_ids(df, repeated, False)
    out = top_words(single.select("id", T.words(F.lower("text")).alias("words")), k, min_bytes).filter(F.size("keywords") > 0).select("id", "keywords")
    return out if repeated is None else out.unionByName(shared_keywords(of_ids(df, repeated, True), k, min_bytes))


def shared_keywords(df: DataFrame, k: int, min_bytes: int) -> DataFrame:
    """keywords() where rows of one id count together."""
    each = df.select("id", F.explode(T.words(F.lower("text"))).alias("word")).filter(F.octet_length("word") > min_bytes).withColumn("word", T.trim_marks(F.col("word"))).filter("word <> ''")
    counted = each.groupBy("id", "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).filter(F.col("k") <= k)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w")).select("id", F.transform("w", lambda x: x["word"]).alias("keywords"))


def word_anomalies(df: DataFrame, share: float = 0.3, least: int = 10) -> DataFrame:
    """(id, share): texts of (id, text) with at least so many lower-cased words, of which one makes up more than a share.

    In sorted words such a word stands at one of the places that are so far
    apart as it has to be frequent, so a text's few words at those places are
    counted in its row.  Only the words of ids found so are shuffled (rows of
    one id count together, and a word above the share of all is so in one row).
    """
    # the explode keeps the planner from sorting the words again for each use
    words = df.select("id", F.explode(F.array(F.sort_array(T.words(F.lower("text"))))).alias("w")).filter(F.size("w") > 0)
    many = F.floor(F.size("w") * share).cast("int")
    step = F.greatest(many, F.lit(1))
    at = words.select("id", "w", many.alias("many"), F.explode(F.transform(F.sequence(step, F.size("w"), step), lambda k: F.get("w", k - 1))).alias("word"))
    often = at.filter(F.get("w", (F.array_position("w", F.col("word")) - 1 + F.col("many")).cast("int")) == F.col("word"))
    ids = bounded(Scratch(df.sparkSession, "anomalies").keep(often.select(F.col("id").alias("found")).distinct()))
    each = df.join(ids, F.col("id").eqNullSafe(F.col("found")), "left_semi").select("id", F.explode(T.words(F.lower("text"))).alias("w"))
    g = each.groupBy("id", "w").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    return g.filter((F.col("total") >= least) & (F.col("most") / F.col("total") > share)).select("id", (F.col("most") / F.col("total")).alias("share"))


def memory_size(df: DataFrame) -> DataFrame:
    return df.groupBy("memory_type").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes"))


# --- ordered analyses, by group -------------------------------------------


def _gaps(df: DataFrame) -> DataFrame:
    """Rows with the hours since the one before in their group; a group may be many tasks' work."""
    rows = O.stretches(df.select("group", "id", "ts"), ["group"], ["ts", "id"])
    near = O.neighbours(rows, ["group"], ["ts", "id"], ["ts"], back=1)
    return near.withColumn("gap", (micros("ts") - micros("prev1.ts")) / 3_600_000_000).filter("gap is not null")


def regular_creation(df: DataFrame) -> DataFrame:
    """(group, id, ts): share of gaps within one sample deviation of the mean gap."""
    gaps = O.with_totals(_gaps(df).select("group", "gap"), ["group"], mean=F.avg("gap"), sd=F.stddev_samp("gap"))
    near = F.abs(F.col("gap") - F.col("mean")) <= F.col("sd")
    return gaps.groupBy("group").agg(F.avg(near.cast("double")).alias("regularity"), F.count("*").alias("gaps"))


def activity_bursts(df: DataFrame) -> DataFrame:
    """Days of a group with more than twice its whole-number mean of items a day."""
    days = df.groupBy("group", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    mean = F.floor(F.sum("n").over(Window.partitionBy("group")) / F.count("*").over(Window.partitionBy("group")))
    return days.withColumn("mean", mean).filter("n > 2 * mean").select("group", "day", "n")


def related_runs(df: DataFrame, hours: float = 24, overlap: float = 0.5, least: int = 3) -> DataFrame:
    """The longest run of each group: neighbours less than so many hours and above an overlap of words apart."""
    rows = O.stretches(df.select("group", "id", "ts", F.array_distinct(T.words(F.lower("text"))).alias("w")), ["group"], ["ts", "id"])
    near = O.neighbours(rows, ["group"], ["ts", "id"], ["ts", "w"], back=1)
    close = (micros("ts") - micros("prev1.ts")) / 3_600_000_000 < hours
    alike = T.set_jaccard(F.col("w"), F.col("prev1.w")) > overlap
    cut = near.select("group", O.STRETCH, "id", "ts", (~F.coalesce(close & alike, F.lit(False))).cast("int").alias("cut"))
    runs = O.running_sum(cut, ["group"], ["ts", "id"], F.col("cut"), "earlier").withColumn("run", F.col("earlier") + F.col("cut"))
    sizes = runs.groupBy("group", "run").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    best = sizes.groupBy("group").agg(F.max(F.struct("n", -F.col("first_id"))).alias("b"))
    return best.select("group", F.col("b.n").alias("n")).filter(F.col("n") >= least)


def theme_trigrams(df: DataFrame) -> DataFrame:
    """First themes of three neighbours in a group that occur more than once."""
    first = F.coalesce(F.try_element_at(T.themes(F.col("text")), F.lit(1)), F.lit("general"))
    rows = O.stretches(df.select("group", "id", first.alias("a")), ["group"], ["id"])
    t = O.neighbours(rows, ["group"], ["id"], ["a"], ahead=2).select("a", F.col("next1.a").alias("b"), F.col("next2.a").alias("c")).filter("c is not null")
    return t.groupBy("a", "b", "c").agg(F.count("*").alias("n")).filter("n > 1")


def thematic_progression(df: DataFrame) -> DataFrame:
    """(group, id): memories that share a theme with the next of their group, which shares one with the one after."""
    rows = O.stretches(df.select("group", "id", T.themes(F.col("text")).alias("a")), ["group"], ["id"])
    t = O.neighbours(rows, ["group"], ["id"], ["a"], ahead=2)
    return t.filter(F.arrays_overlap("a", "next1.a") & F.arrays_overlap("next1.a", "next2.a")).select("group", "id")


def length_outliers(df: DataFrame) -> DataFrame:
    """Memories whose length is more than two deviations from the mean, both in whole numbers."""
    n = F.octet_length("text")
    moments = df.agg(F.floor(F.avg(n)).alias("mean"), F.floor(F.stddev_pop(n)).alias("sd"))
    return df.select("id", n.alias("n")).join(F.broadcast(moments)).filter(F.abs(F.col("n") - F.col("mean")) > 2 * F.col("sd")).select("id", "n")


def time_gap_anomalies(df: DataFrame) -> DataFrame:
    """Gaps above mean + 2 deviations of their group; severity min(0.8, gap / limit)."""
    limited = O.with_totals(_gaps(df).select("group", "id", "gap"), ["group"], limit=F.avg("gap") + 2 * F.stddev_pop("gap"))
    return limited.filter("gap > limit").select("group", "id", "gap", F.least(F.lit(0.8), F.col("gap") / F.col("limit")).alias("severity"))


def turn_window(messages: DataFrame, turns: int = 10) -> DataFrame:
    """The last 2 * turns messages of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= 2 * turns).drop("k")


def evict_lru(df: DataFrame, max_bytes: int) -> DataFrame:
    """(owner, id, accessed, size): the rows to drop, oldest first, until each owner's excess is covered."""
    rows = O.stretches(df, ["owner"], ["accessed", "id"])
    freed = O.running_sum(rows, ["owner"], ["accessed", "id"], F.col("size"), "freed")
    return O.with_totals(freed, ["owner"], total=F.sum("size")).filter(F.col("freed") < F.col("total") - max_bytes).select(df.columns)


def keep_last_versions(df: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("owner").orderBy(F.desc("version"))
    return df.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).drop("k")


def chat_metrics(messages: DataFrame) -> DataFrame:
    text = F.col("text")
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(T.count_tokens(text, "chars")).alias("tokens"), F.max("turn").alias("last_turn"))


def chat_history(messages: DataFrame) -> DataFrame:
    """One ordered history per conversation."""
    listed = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.count("*").alias("messages"))
    return listed.select("conv_id", "messages", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("history"))


def operation_metrics(log: DataFrame) -> DataFrame:
    """(operation, duration, failed) summed per operation."""
    return log.groupBy("operation").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"), F.min("duration").alias("min"), F.max("duration").alias("max"), F.avg("duration").alias("avg"))


def quality_trend(scores: DataFrame, last: int = 10, step: float = 0.01) -> DataFrame:
    """(group, n, score): mean and slope of the last rows of each group."""
    order = Window.partitionBy("group").orderBy(F.desc("n"))
    recent = scores.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= last)
    out = recent.groupBy("group").agg(F.count("*").alias("rows"), F.avg("score").alias("mean"), F.regr_slope("score", -F.col("k")).alias("slope"))
    return out.withColumn("trend", F.when(F.col("rows") < 3, "insufficient").when(F.col("slope") > step, "improving").when(F.col("slope") < -step, "declining").otherwise("stable"))


def welch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of the means of two score columns, and Welch's t."""
    moments = lambda df, s: df.agg(F.avg("score").alias(f"mean_{s}"), F.var_samp("score").alias(f"var_{s}"), F.count("*").alias(f"n_{s}"))
    both = moments(a, "a").join(moments(b, "b"))  # one row each
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return both.select((F.col("mean_b") - F.col("mean_a")).alias("difference"), F.try_divide(F.col("mean_b") - F.col("mean_a"), error).alias("t"))


def detect_regressions(base: DataFrame, now: DataFrame) -> DataFrame:
    """(name, metric, value) rows joined; relative change and its severity."""
    both = base.toDF("name", "metric", "before").join(now.toDF("name", "metric", "after"), ["name", "metric"])
    change = F.try_divide(F.col("after") - F.col("before"), F.col("before"))
    size = F.abs(F.col("change"))
    return both.withColumn("change", change).withColumn("severity", F.when(size > 0.5, "critical").when(size > 0.2, "high").when(size > 0.1, "medium").otherwise("low"))
