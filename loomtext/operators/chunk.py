"""Chunkers: one row per document in, one row per chunk out.

A chunker turns a document into units (words, sentences, paragraphs) and their
token counts by built-in functions; one Arrow map packs the units into chunks, in
time linear in them (``packing``).  No shuffle but in chunk_semantic.  Input has
``doc_id, text``; output ``doc_id, chunk_no, text, tokens`` (chunk_no from 1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import features as X
from loomtext.functions import text as T
from loomtext.functions import vectors as V
from loomtext.plans.shared import Scratch

from .packing import NO_LIMIT, Rule, cut_at, packed, windows
from .words import word_figures

STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_strategy(name: str, chunker: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a chunker for evaluate_strategies()."""
    STRATEGIES[name] = chunker


def split_sentences(c: Column) -> Column:
    """Sentences with their marks; cut after [.!?] and white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def split_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n[ \t]*\n\s*"), lambda s: F.trim(s)), lambda s: s != "")


def _packed(docs: DataFrame, units: Column, joiner: str, kind: str, rule: Rule) -> DataFrame:
    u = docs.select("doc_id", units.alias("units"))
    return packed(u.select("doc_id", "units", F.transform("units", lambda s: T.count_tokens(s, kind).cast("int")).alias("sizes")), joiner, rule)


def chunk_fixed(docs: DataFrame, size: int = 512, kind: str = "word", overlap: int = 0) -> DataFrame:
    """Words packed to size tokens; with overlap, a chunk begins with the last words of the one before that fit so many tokens."""
    return _packed(docs, T.words(F.col("text")), " ", kind, Rule(size, overlap=overlap))


def chunk_sentence(docs: DataFrame, size: int = 512, kind: str = "word", max_sentences: int = 100, min_sentences: int = 1, overlap: int = 0) -> DataFrame:
    return _packed(docs, split_sentences(F.col("text")), " ", kind, Rule(size, max_sentences, min_sentences, overlap))


def chunk_paragraph(docs: DataFrame, size: int = 512, kind: str = "word", max_paragraphs: int = NO_LIMIT, overlap: int = 0) -> DataFrame:
    return _packed(docs, split_paragraphs(F.col("text")), "\n\n", kind, Rule(size, max_paragraphs, overlap=overlap))


def chunk_semantic(docs: DataFrame, size: int = 512, kind: str = "word", max_sentences: int = 100, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sentences packed past the budget up to the next topic boundary.

    A boundary is told by the words; with embed (a function that adds a column
    vector to rows with a text) also by a cosine below the document's mean
    less its deviation.  One shuffle, by document.
    """
    u = docs.select("doc_id", split_sentences(F.col("text")).alias("units"))
    each = u.select("doc_id", F.posexplode_outer("units").alias("k", "s")).filter("s is not null")
    order, whole = Window.partitionBy("doc_id").orderBy("k"), Window.partitionBy("doc_id")
    # what a sentence gives by itself is worked out once, before it is compared
    each = each.select("doc_id", "k", "s", T.count_tokens(F.col("s"), kind).cast("int").alias("size"), F.array_distinct(F.transform(T.content_words(F.col("s")), lambda w: F.xxhash64(w))).alias("w"))
    edge = F.coalesce(T.is_topic_boundary(F.col("before"), F.col("s"), sets=(F.col("w_before"), F.col("w"))), F.lit(True))
    if embed is not None:
        each = embed(each.withColumnRenamed("s", "text")).withColumnRenamed("text", "s")
        each = each.withColumn("near", V.cosine(F.lag("vector").over(order), F.col("vector"))).drop("vector")
        each = each.withColumn("limit", F.avg("near").over(whole) - F.stddev_pop("near").over(whole))
        edge = edge | F.coalesce(F.col("near") < F.col("limit"), F.lit(False))
    flagged = each.withColumns({"before": F.lag("s").over(order), "w_before": F.lag("w").over(order)}).select("doc_id", "k", "s", "size", edge.alias("edge"))
    rows = flagged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "s", "size", "edge"))).alias("r"))
    sized = rows.select("doc_id", F.col("r.s").alias("units"), F.col("r.size").alias("sizes"), F.col("r.edge").alias("flags"))
    return packed(sized, " ", Rule(size, max_sentences))


def window_words(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Word windows with step size - overlap (overlap of size or more counts as size / 2)."""
    step = size - (overlap if overlap < size else size // 2)
    u = docs.select("doc_id", T.words(F.col("text")).alias("units"))
    return windows(u.select("doc_id", "units", F.transform("units", lambda w: F.lit(1)).alias("sizes")), " ", size, step).select("doc_id", "chunk_no", "text")


def chunk_at_boundaries(docs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Cuts sentences at given indexes (doc_id, cuts ARRAY<INT>): sorted, in range, unique."""
    u = docs.select("doc_id", split_sentences(F.col("text")).alias("units")).join(boundaries, "doc_id", "left")
    inside = F.array_sort(F.array_distinct(F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda k: (k > 0) & (k < F.size("units")))))
    return cut_at(u.select("doc_id", "units", F.transform("units", lambda s: T.word_count(s)).alias("sizes"), inside.alias("cuts")), " ")


def propositions(docs: DataFrame, most: int = 10) -> DataFrame:
    """Sentences of 20 to 200 bytes that look like statements: capital start, end mark, a verb-like word."""
    s = docs.select("doc_id", F.posexplode_outer(split_sentences(F.col("text"))).alias("k", "s"))
    good = s.filter(F.octet_length("s").between(20, 200) & F.col("s").rlike("^[A-Z]") & F.col("s").rlike(r"[.!?]$") & F.col("s").rlike(T.ascii_edges(r"(?i)\b(is|are|was|were|has|have|had|will|can)\b")))
    order = Window.partitionBy("doc_id").orderBy("k")
    return good.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("doc_id", "n", "s")


def _section_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k, line, kind, section): the lines of each section, without those that part blocks."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("k", "line"))
    order, whole = Window.partitionBy("doc_id").orderBy("k"), Window.partitionBy("doc_id")
    marked, numbered = F.col("line").rlike(r"^#{1,6}\s"), F.col("line").rlike(r"^[0-9]+(\.[0-9]+)*\.\s+\S")
    kind = F.when(F.max(marked).over(whole), "heading").when(F.max(numbered).over(whole), "number").otherwise("block")
    blank = F.trim("line") == ""
    opens = F.when(F.col("kind") == "heading", marked).when(F.col("kind") == "number", numbered).otherwise(~blank & F.coalesce(F.lag(blank).over(order), F.lit(False)))
    placed = lines.withColumn("kind", kind).withColumn("head", opens.cast("int")).withColumn("section", F.sum("head").over(order))
    return placed.filter((F.col("kind") != "block") | ~blank).select("doc_id", "k", "line", "kind", "section")


def _title() -> Column:
    return F.when(F.col("kind") == "heading", F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)).when(F.col("kind") == "number", F.regexp_extract("line", r"^[0-9]+(\.[0-9]+)*\.\s+(.*)$", 2)).otherwise("")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, title, lines): cut before Markdown headings, else before numbered ones, else at blank lines.

    What stands before the first heading is section 0; a block at blank lines
    has no title.
    """
    return _section_lines(docs).groupBy("doc_id", "section").agg(F.min_by(_title(), "k").alias("title"), F.count("*").alias("lines"))


def section_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, section, title, text): the sections with their lines."""
    g = _section_lines(docs).groupBy("doc_id", "section").agg(F.min_by(_title(), "k").alias("title"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    return g.select("doc_id", "section", "title", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


# --- chunk statistics -----------------------------------------------------


def chunk_stats(chunks: DataFrame) -> DataFrame:
    out = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("min"), F.max("tokens").alias("max"), F.avg("tokens").alias("avg"))
    per = F.floor(F.floor(F.col("total") / F.col("n")) / 4)
    return out.withColumn("overlap_estimate", F.when(F.col("n") > 1, (F.col("n") - 1) * per).otherwise(0))


def keywords_of(c: Column) -> Column:
    """Different lower-cased words of more than two bytes, edge marks trimmed, the commonest words left out."""
    trimmed = T.trimmed_words(F.lower(c), r"""[.,!?;:"'()\[\]{}]""")
    return F.array_distinct(F.filter(trimmed, lambda w: (F.octet_length(w) > 2) & ~w.isin(*T.STOP_WORDS[:20])))


def _measured(chunks: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, chunk_no, vector if there, more, keys, s and what ``words.word_figures`` adds): keywords and sentences as hashes."""
    vector = ["vector"] if "vector" in chunks.columns else []
    hashed = F.transform(split_sentences(F.col("text")), lambda s: F.xxhash64(s))
    return word_figures(chunks.select("doc_id", "chunk_no", *vector, *more, hashed.alias("s"), T.words(F.lower("text")).alias("words")))


def _beside_next(measured: DataFrame) -> DataFrame:
    """Adds similarity, shared, redundant and perhaps cosine, against the next chunk of the document; null for the last one."""
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    columns = ["keys", "s"] + (["vector"] if "vector" in measured.columns else [])
    both = measured.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    same = F.size(F.array_intersect("keys", "next_keys"))  # keys are sets
    out = both.withColumn("similarity", F.when(F.col("next_keys").isNotNull(), F.coalesce(F.try_divide(same, F.size("keys") + F.size("next_keys") - same), F.lit(0.0))))
    # the filter is worked out for chunks that share a sentence alone
    overlap = F.when(F.arrays_overlap("s", "next_s"), F.size(F.filter("s", lambda x: F.array_contains("next_s", x)))).otherwise(0)
    out = out.withColumn("shared", F.when(F.col("next_keys").isNotNull(), overlap))
    if "vector" in columns:
        out = out.withColumn("cosine", V.cosine(F.col("vector"), F.col("next_vector")))
    return out.withColumn("redundant", F.col("shared") > 0.5 * F.least(F.size("s"), F.size("next_s")))


def adjacent_features(chunks: DataFrame) -> DataFrame:
    """Per neighbouring pair: keyword similarity, sentences of the first that the second repeats, and whether those are most of the smaller's.

    Chunks with a column vector also get its cosine with the next one's.
    """
    cosine = ["cosine"] if "vector" in chunks.columns else []
    return _beside_next(_measured(chunks)).filter("next_keys is not null").select("doc_id", "chunk_no", "similarity", "shared", "redundant", *cosine)


#: The metrics of a document's chunks and their weights.
CHUNK_WEIGHTS = {"coherence": 0.20, "completeness": 0.15, "relevance": 0.15, "information": 0.10, "readability": 0.10, "integrity": 0.20, "structure": 0.05, "overlap": 0.05}


def _elements(c: Column) -> Column:
    """Number of headers, list items, paragraphs, code blocks and tables."""
    count = lambda found: F.floor((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(found), F.lit("")))) / len(found))
    return (count("#") + count("<h") + count("- ") + count("* ") + count("<li>") + count("\n\n") + 1 + F.floor(count("```") / 2) + F.floor(count("|") / 3)).cast("long")


def repeated_share(c: Column) -> Column:
    """Twice the share of words (more than two bytes, edge marks trimmed) that repeat an earlier one, at most 1; 1 for a text of one sentence or no word."""
    w = F.filter(T.trimmed_words(F.lower(c), r"""[.,!?;:"'()\[\]{}]"""), lambda x: F.octet_length(x) > 2)
    share = F.try_divide(2.0 * (F.size(w) - F.size(F.array_distinct(w))), F.size(w))
    return F.when(F.size(split_sentences(c)) <= 1, 1.0).otherwise(F.least(F.coalesce(share, F.lit(1.0)), F.lit(1.0)))


def _wholes(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", F.octet_length("text").alias("bytes"), T.word_count(text).alias("words"), _elements(text).alias("elements"))


def assess_chunks(docs: DataFrame, chunks: DataFrame, weights: dict[str, float] = CHUNK_WEIGHTS) -> DataFrame:
    """Eight metrics of each document's chunks and their weighted mean.

    coherence within and between neighbours, completeness, relevance,
    information, readability, integrity (neighbours alone), structure kept and
    overlap that isn't redundant; beside them the size consistency and the
    share of chunks that end with a sentence.  With a column vector in chunks,
    neighbours are compared by cosine.  The chunks are read once and dealt by
    document, as figures and hashes.
    """
    return _assessed(_wholes(docs), chunks, weights)


def _assessed(wholes: DataFrame, chunks: DataFrame, weights: dict[str, float]) -> DataFrame:
    text, n = F.col("text"), F.col("n_words")
    measured = _measured(
        chunks,
        (F.octet_length(text) + 1).alias("b"),
        X.density(text, F.col("tokens")).alias("information"),
        T.sentence_marks(text).alias("marks"),
        _elements(text).alias("e"),
        F.col("tokens").cast("double").alias("tokens"),
        text.rlike(r"[.!?]$").cast("double").alias("ends"),
    )
    share = F.try_divide(2.0 * (F.col("n_long") - F.col("n_long_different")), F.col("n_long"))
    ease = 206.835 - 1.015 * n / F.col("marks") - 84.6 * F.col("syllables") / n
    measured = measured.select(
        "*",
        F.when(F.size("s") <= 1, 1.0).otherwise(F.least(F.coalesce(share, F.lit(1.0)), F.lit(1.0))).alias("within"),
        F.coalesce(F.try_divide(F.col("n_telling") + F.col("n_telling_different"), 2 * n), F.lit(0.0)).alias("relevance"),
        (F.when(n == 0, 0.0).otherwise(F.least(F.greatest(ease, F.lit(0.0)), F.lit(100.0))) / 100).alias("readability"),
    ).drop("marks", "syllables", "n_long", "n_long_different", "n_telling", "n_telling_different")
    mean = lambda c: F.avg(c).alias(c)
    g = _beside_next(measured).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("n_words").alias("w"), F.sum("e").alias("e"), mean("within"), mean("relevance"), mean("information"), mean("readability"), F.avg("tokens").alias("m"), F.stddev_pop("tokens").alias("sd"), F.avg("ends").alias("boundary"),
        F.avg("cosine" if "vector" in chunks.columns else "similarity").alias("near"), F.sum("shared").alias("shared"), F.sum(F.when(F.col("redundant"), F.col("shared")).otherwise(0)).alias("redundant"),
    )
    out = g.join(wholes, "doc_id")
    near = F.coalesce("near", F.lit(1.0))
    out = out.select(
        "doc_id",
        F.when(F.col("n") <= 1, 1.0).otherwise(0.7 * F.col("within") + 0.3 * near).alias("coherence"),
        F.least(F.coalesce(0.3 * F.try_divide("b", "bytes") + 0.7 * F.try_divide("w", "words"), F.lit(1.0)), F.lit(1.0)).alias("completeness"),
        "relevance",
        "information",
        "readability",
        near.alias("integrity"),
        F.least(F.col("e") / F.col("elements"), F.lit(1.0)).alias("structure"),
        F.coalesce(1 - F.try_divide("redundant", "shared"), F.lit(1.0)).alias("overlap"),
        F.greatest(1 - F.coalesce(F.try_divide("sd", "m"), F.lit(0.0)), F.lit(0.0)).alias("consistency"),
        "boundary",
    )
    return out.withColumn("score", sum(w * F.col(c) for c, w in weights.items()) / sum(weights.values()))


#: Chunk issues: metric, least value, severity, and how much missing it weighs.
CHUNK_ISSUES = (("completeness", 0.8, "high", 0.9), ("relevance", 0.4, "moderate", 0.3), ("information", 0.3, "low", 0.2), ("readability", 0.3, "moderate", 0.3), ("integrity", 0.6, "high", 0.8), ("structure", 0.7, "moderate", 0.6), ("overlap", 0.7, "moderate", 0.4))


def chunk_issues(assessed: DataFrame) -> DataFrame:
    """(doc_id, metric, severity, impact): the metrics of assess_chunks below their least values."""
    found = [F.when(F.col(m) < least, F.struct(F.lit(m).alias("metric"), F.lit(severity).alias("severity"), ((least - F.col(m)) * weight).alias("impact"))) for m, least, severity, weight in CHUNK_ISSUES]
    return assessed.select("doc_id", F.inline(F.array_compact(F.array(*found))))


def weighted_quality(weights: dict[str, float] | None = None, columns: tuple[str, ...] = ("coherence", "completeness", "size_balance", "boundary_quality")) -> Column:
    """The weighted mean of quality columns; the plain mean without weights, or if they sum to nothing."""
    given = {c: w for c, w in (weights or {}).items() if c in columns}
    if sum(given.values()) <= 0:
        given = dict.fromkeys(columns, 1.0)
    return sum(w * F.col(c) for c, w in given.items()) / sum(given.values())


METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_metric(name: str, metric: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Adds a metric for evaluate_strategies(): (docs, chunks) to (doc_id, value)."""
    METRICS[name] = metric


def evaluate_strategies(docs: DataFrame, names: list[str], min_score: float = 0.5, metrics: list[str] | None = None) -> DataFrame:
    """Mean scores of registered chunkers over one collection, with registered metrics beside them.

    What is measured on whole documents is written once for all chunkers, and a
    chunker's chunks once for all its metrics.
    """
    scratch = Scratch(docs.sparkSession, "strategies")
    wholes, out = scratch.keep(_wholes(docs)), None
    for name in names:
        chunks = STRATEGIES[name](docs)
        if metrics:
            chunks = scratch.keep(chunks)
        scored = _assessed(wholes, chunks, CHUNK_WEIGHTS)
        for metric in metrics or []:
            scored = scored.join(METRICS[metric](docs, chunks).select("doc_id", F.col("value").alias(metric)), "doc_id", "left")
        scored = scored.withColumn("strategy", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    g = out.groupBy("strategy").agg(F.count("*").alias("docs"), *[F.avg(c).alias(c) for c in (*CHUNK_WEIGHTS, "consistency", "boundary", "score", *(metrics or []))])
    return g.withColumn("passed", F.col("score") >= min_score)


def strategy_metrics(log: DataFrame, day_rows: str = "1 day") -> DataFrame:
    """(strategy, successes, errors, avg_latency, health, enabled) of a run log (strategy, ts, id, ok, latency).

    Health falls by a tenth at every error that makes errors outnumber the
    successes so far; below 0.1 a strategy is off.  Counts so far are summed
    over days first, then within a day, so that one strategy's log is many tasks' work.
    """
    dated = log.withColumn("day", F.window("ts", day_rows)["start"]) if day_rows else log
    ok = F.col("ok").cast("int")
    days = dated.groupBy("strategy", "day").agg(F.sum(2 * ok - 1).alias("gain"))
    before = Window.partitionBy("strategy").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("strategy", "day", F.coalesce(F.sum("gain").over(before), F.lit(0)).alias("earlier"))
    so_far = Window.partitionBy("strategy", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = dated.withColumn("gain", F.sum(2 * ok - 1).over(so_far)).join(days, ["strategy", "day"])
    falls = F.sum((~F.col("ok") & (F.col("gain") + F.col("earlier") < 0)).cast("int"))
    g = rows.groupBy("strategy").agg(F.sum(ok).alias("successes"), F.sum(1 - ok).alias("errors"), F.avg(F.when(F.col("ok"), F.col("latency"))).alias("avg_latency"), F.pow(F.lit(0.9), falls).alias("health"))
    return g.withColumn("enabled", F.col("health") >= 0.1)


register_strategy("fixed", chunk_fixed)
register_strategy("sentence", chunk_sentence)
register_strategy("paragraph", chunk_paragraph)
register_strategy("semantic", chunk_semantic)
