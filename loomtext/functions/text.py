"""Column functions over text: words, themes, sentiment, complexity, quality.

All are native expressions.  Lengths called "bytes" are UTF-8 lengths; words
are runs between ASCII white space.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic indicators, found as substrings of the lower-cased text.
THEMES = {
    "academic": ("study", "research", "analysis", "conclusion", "hypothesis", "theory"),
    "business": ("market", "company", "revenue", "profit", "strategy", "customer"),
    "creative": ("design", "art", "creative", "imagine", "inspiration", "artistic"),
    "personal": ("feel", "think", "believe", "experience", "emotion", "memory"),
    "technical": ("technology", "software", "system", "computer", "data", "algorithm"),
}
# The sentiment lexicon.
POSITIVE = ("good", "great", "excellent", "amazing", "wonderful", "fantastic", "positive", "happy", "joy", "success", "love", "best", "perfect", "outstanding")
NEGATIVE = ("bad", "terrible", "awful", "horrible", "negative", "sad", "angry", "hate", "worst", "failure", "problem", "issue", "difficult", "poor")
# Stop words of content words.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "it",
    "he", "she", "they", "we", "you", "i",
)
# Openings of a new topic, and of a list item.
TRANSITIONS = ("however", "nevertheless", "on the other hand", "meanwhile", "furthermore", "moreover", "in addition", "subsequently", "consequently", "therefore", "thus", "hence", "in contrast", "alternatively", "similarly", "likewise", "conversely")
LIST_OPENERS = ("first", "second", "third", "finally", "lastly", "next")
#: Marks that may stand around a word.
EDGE_MARKS = r"""[.,!?;:"'()\[\]]"""
CLEANED_MARKS = r"""[.,!?;:()\[\]{}"'\-]"""


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b between ASCII word characters and others (Java's own knows more letters).

    A \b that opens the pattern or an alternative stands before a word character, any other
    one after it, so one look to the other side is enough.
    """
    w = "[A-Za-z0-9_]"
    return re.sub(r"(^(?:\(\?i\))?|\|)\\b", rf"\1(?<!{w})", pattern).replace(r"\b", f"(?!{w})")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def trim_marks(w: Column) -> Column:
    return F.regexp_replace(w, rf"^{EDGE_MARKS}+|{EDGE_MARKS}+$", "")


def trimmed_words(c: Column, marks: str = EDGE_MARKS) -> Column:
    """Words without marks at their edges; the marks go from the whole text at once, which is cheaper than word by word."""
    return F.split(F.regexp_replace(c, rf"(?:(?<=\s)|^){marks}+|{marks}+(?=\s|$)", ""), r"\s+")


def clean_words(c: Column, min_bytes: int = 0) -> Column:
    """Lower-cased words without punctuation anywhere, longer than min_bytes bytes."""
    cleaned = F.split(F.regexp_replace(F.lower(c), CLEANED_MARKS, ""), r"\s+")
    return F.filter(cleaned, lambda w: F.octet_length(w) > min_bytes)


def content_words(c: Column) -> Column:
    """Lower-cased words of more than two bytes, edge marks trimmed, stop words left out."""
    trimmed = trimmed_words(F.lower(c), r"""[.,!?;:"'()\[\]{}]""")
    return F.filter(trimmed, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))


def themes(c: Column) -> Column:
    low = F.lower(c)
    holds = lambda found: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in found])
    return F.array_compact(F.array(*[F.when(holds(found), F.lit(name)) for name, found in THEMES.items()]))


def sentence_marks(c: Column) -> Column:
    """Number of sentence marks, at least one."""
    return F.greatest(F.regexp_count(c, F.lit(r"[.!?]")), F.lit(1))


def sentiment(c: Column) -> Column:
    """(polarity, subjectivity, emotion, confidence) by lexicon hits."""
    trimmed = trimmed_words(F.lower(c))
    pos = F.size(F.filter(trimmed, lambda w: w.isin(*POSITIVE)))
    neg = F.size(F.filter(trimmed, lambda w: w.isin(*NEGATIVE)))
    return sentiment_of(pos, neg, word_count(c))


def sentiment_of(pos: Column, neg: Column, n: Column) -> Column:
    """sentiment() of a text of n words, by its counted hits."""
    total = pos + neg
    polarity = F.when(total > 0, (pos - neg) / total).otherwise(0.0)
    share = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    emotion = F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral")
    return F.struct(polarity.alias("polarity"), F.least(share, F.lit(1.0)).alias("subjectivity"), emotion.alias("emotion"), F.when(total > 0, share).otherwise(0.1).alias("confidence"))


def complexity(c: Column) -> Column:
    return F.when(F.octet_length(c) == 0, 0.0).otherwise(F.least(word_count(c) / sentence_marks(c) / 20, F.lit(1.0)))


def lexical_diversity(c: Column, ws: Column | None = None) -> Column:
    """Different words per word; ws may give the lower-cased words as a column of their own."""
    ws = words(F.lower(c)) if ws is None else ws
    return F.coalesce(F.try_divide(F.size(F.array_distinct(ws)), F.size(ws)), F.lit(0.0))


def structural_complexity(c: Column) -> Column:
    marks = [".", ",", ";", ":", "!", "?", "-", "(", ")", "[", "]"]
    variety = sum(F.contains(c, F.lit(m)).cast("int") for m in marks) / len(marks)
    return variety + F.when(F.contains(c, F.lit("\n\n")), 0.2).otherwise(0.0) + F.when(F.regexp_count(c, F.lit("\n")) >= 3, 0.1).otherwise(0.0)


def semantic_complexity(c: Column) -> Column:
    per_sentence = word_count(c) / sentence_marks(c) / 20
    return F.when(word_count(c) == 0, 0.0).otherwise(F.least((lexical_diversity(c) + per_sentence + structural_complexity(c)) / 3, F.lit(1.0)))


def content_complexity(c: Column) -> Column:
    per_sentence = word_count(c) / sentence_marks(c) / 20
    return F.when(word_count(c) == 0, 0.0).otherwise(F.least(0.5 * per_sentence + 0.5 * lexical_diversity(c), F.lit(1.0)))


def length_band(c: Column) -> Column:
    n = F.octet_length(c)
    return F.when(n < 10, 0.2).when(n < 50, 0.5).when(n < 200, 0.8).otherwise(1.0)


def quality(c: Column) -> Column:
    structure = F.lit(0.5) + F.when(F.contains(c, F.lit("\n")), 0.2).otherwise(0.0) + F.when(F.contains(c, F.lit(".")), 0.2).otherwise(0.0) + F.when(word_count(c) > 5, 0.1).otherwise(0.0)
    return F.least((length_band(c) + structure) / 2, F.lit(1.0))


def assess_quality(c: Column, diversity: Column | None = None) -> Column:
    """(length, structure, readability, informativeness, score, issues).

    The parts of the struct share their inputs, and the planner may work those
    out once for each part; diversity, the dearest, can be given as a column.
    """
    has = lambda s, x: F.when(F.contains(c, F.lit(s)), x).otherwise(0.0)
    structure = has("\n", 0.3) + has(".", 0.3) + has(",", 0.2) + F.when(word_count(c) > 5, 0.2).otherwise(0.0)
    rate = word_count(c) / sentence_marks(c)
    readable = F.when(word_count(c) == 0, 0.0).when((rate >= 15) & (rate <= 20), 1.0).when((rate >= 10) & (rate <= 25), 0.8).otherwise(0.5)
    dims = {"length": length_band(c), "structure": structure, "readability": readable, "informativeness": lexical_diversity(c) if diversity is None else diversity}
    issues = F.array_compact(F.array(*[F.when(v < 0.5, F.lit(k)) for k, v in dims.items()]))
    return F.struct(*[v.alias(k) for k, v in dims.items()], (sum(dims.values()) / len(dims)).alias("score"), issues.alias("issues"))


def relevance(c: Column, updated: Column, now: Column) -> Column:
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 86_400_000_000
    return 0.4 * quality(c) + 0.3 * F.exp(-days / 30) + 0.3 * F.least(word_count(c) / 100, F.lit(1.0))


def insights(c: Column, created: Column, updated: Column, now: Column) -> Column:
    """Rule texts about one memory."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000
    return F.array_compact(F.array(
        F.when(F.octet_length(c) > 500, "long content"),
        F.when(F.octet_length(c) < 50, "short content"),
        F.when(F.contains(c, F.lit("?")), "holds questions"),
        F.when(F.contains(c, F.lit("!")), "holds emphasis"),
        F.when(days > 30, "older than a month"),
        F.when(updated > created, "was updated"),
    ))


def syllables(w: Column) -> Column:
    """Vowel groups of a lower-cased word, one less for a silent e, at least one."""
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0), F.lit(1))


def flesch(c: Column) -> Column:
    n, total = word_count(c), F.aggregate(words(F.lower(c)), F.lit(0), lambda acc, w: acc + syllables(w))
    score = 206.835 - 1.015 * n / sentence_marks(c) - 84.6 * total / n
    return F.when(n == 0, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def readability_simple(c: Column) -> Column:
    n = word_count(c)
    score = 100 - 1.015 * n / sentence_marks(c) - 84.6 * F.octet_length(c) / n
    return F.when(n == 0, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def structure_counts(c: Column) -> Column:
    count = lambda p: F.regexp_count(c, F.lit(p))
    return F.struct(
        (count("#") + count("<h")).alias("headers"),
        (count("- ") + count(r"\* ")).alias("lists"),
        count("\n\n").alias("paragraphs"),
        F.floor(count("```") / 2).alias("code_blocks"),
        F.floor(count(r"\|") / 3).alias("tables"),
    )


def chunk_structure(c: Column) -> Column:
    n_sentences = F.regexp_count(c, F.lit(r"[.!?]+"))
    return F.struct(
        n_sentences.alias("sentences"),
        (F.regexp_count(c, F.lit("\n\n")) + 1).alias("paragraphs"),
        word_count(c).alias("words"),
        F.octet_length(c).alias("bytes"),
        F.contains(c, F.lit("?")).alias("has_question"),
        c.rlike(r"(?m)^\s*([-*]|[0-9]+\.)\s").alias("has_list"),
        F.contains(c, F.lit("!")).alias("has_emphasis"),
        F.coalesce(F.try_divide(word_count(c), n_sentences), F.lit(0.0)).alias("words_per_sentence"),
    )


def content_density(c: Column) -> Column:
    """Share of bytes that aren't white space."""
    return F.coalesce(F.try_divide(F.octet_length(F.regexp_replace(c, r"[ \t\n\r]", "")), F.octet_length(c)), F.lit(0.0))


# Frequent English words.
ENGLISH = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with")


def detect_language(c: Column, share: float = 0.1, first: int | None = 1000) -> Column:
    ws = words(F.lower(F.substring(c, 1, first) if first else c))
    hits = F.size(F.filter(ws, lambda w: w.isin(*ENGLISH)))
    return F.when(F.coalesce(F.try_divide(hits, F.size(ws)), F.lit(0.0)) > share, "en").otherwise("unknown")


def content_type(c: Column) -> Column:
    return (
        F.when(c.rlike(r"function|class |import |```"), "code")
        .when(c.rlike(r"https?://|www\."), "web_content")
        .when(c.rlike(r"@") & c.rlike(r"\."), "contact_info")
        .otherwise("text")
    )


def count_tokens(c: Column, kind: str = "word") -> Column:
    count = lambda p: F.regexp_count(c, F.lit(p))
    of = lambda marks: F.length(c) - F.length(F.translate(c, marks, ""))  # noqa: E731  no regular expression where single characters are counted
    if kind == "word":
        return word_count(c) + F.floor(of(""".,!?;:()[]{}"'""") / 2)
    if kind == "simple":
        return word_count(c) + of(""".,!?;:()[]{}"'\n\t""")
    if kind == "regex":
        return count(r"'(?:s|t|re|ve|m|ll|d)\b") + count(r"[^\w\s]") + count(r"\w+")
    if kind == "long_words":
        return F.aggregate(words(c), F.lit(0), lambda acc, w: acc + 1 + F.greatest(F.floor((F.octet_length(w) - 6) / 3), F.lit(0)).cast("int")) + of(".,!?;:")
    if kind == "pieces":
        size = lambda w: F.when(F.octet_length(w) <= 4, 1).when(F.octet_length(w) <= 8, 2).otherwise(F.ceil(F.octet_length(w) / 4).cast("int"))
        return F.aggregate(words(c), F.lit(2), lambda acc, w: acc + size(w))
    if kind == "chars":
        return F.floor(F.octet_length(c) / 4)
    raise ValueError(f"unknown kind of tokens: {kind}")


def preprocess_text(c: Column, max_tokens: int) -> Column:
    """Trimmed and squeezed; cut after 4 * max_tokens characters at the last blank."""
    squeezed = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.substring(squeezed, 1, 4 * max_tokens)
    return F.when(F.length(squeezed) <= 4 * max_tokens, squeezed).otherwise(F.regexp_replace(cut, r" [^ ]*$", ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def word_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(words(F.lower(a)), words(F.lower(b)))


def is_topic_boundary(last: Column, after: Column, shift: float = 0.2, sets: tuple[Column, Column] | None = None) -> Column:
    """sets may give the different content words of both (or their hashes) as columns of their own."""
    low = F.lower(after)
    opens = F.lit(False)
    for opener in TRANSITIONS + LIST_OPENERS:
        opens = opens | low.startswith(opener)
    a, b = sets or (content_words(last), content_words(after))
    if sets:
        same = F.size(F.array_intersect(a, b))
        alike = F.coalesce(F.try_divide(same, F.size(a) + F.size(b) - same), F.lit(0.0))
    else:
        alike = set_jaccard(a, b)
    shifted = (F.size(a) > 0) & (F.size(b) > 0) & (alike < shift)
    return opens | (last.endswith("?") & ~after.endswith("?")) | shifted


# Keyword rules for memories in messages: category, importance, keywords, byte bounds.
MEMORY_RULES = (
    ("important_facts", "fact", 0.8, ("important", "key", "fact", "remember"), 10, 200),
    ("preferences", "preference", 0.7, ("prefer", "like", "dislike", "favorite", "hate"), 5, 100),
    ("personal_info", "personal", 0.9, ("name", "age", "work", "job", "location", "family"), 5, 150),
)


def extract_memory(c: Column) -> Column:
    """The first rule whose keyword occurs and whose bounds hold, or null."""
    low, n = F.lower(c), F.octet_length(c)
    out = F.lit(None).cast("struct<rule:string,category:string,importance:double>")
    for rule, category, importance, found, lo, hi in reversed(MEMORY_RULES):
        value = F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(importance).alias("importance"))
        out = F.when((n >= lo) & (n <= hi) & low.rlike("|".join(found)), value).otherwise(out)
    return out


def memory_type(metadata: Column) -> Column:
    return F.coalesce(metadata["memory_type"], F.when(metadata["url"].isNotNull(), "InternetMemory").when(metadata["user_id"].isNotNull(), "UserMemory").otherwise("WorkingMemory"))


def control_share(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")), F.length(c)), F.lit(0.0))


def extract_json(c: Column, schema: str) -> Column:
    """The whole text as JSON, else what stands from the first { to the last }."""
    whole = F.from_json(c, schema)
    return F.when(F.trim(c).startswith("{"), whole).otherwise(F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema))
