"""Further column functions: propositions, document types, strategy choice, follow-ups, anomalies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# What propositions look like.
SUBJECTS = (r"\b(the|a|an|this|that|these|those)\s+\w+", r"\b[A-Z]\w+", r"\b(he|she|it|they|we|you|I)\b")
PREDICATES = (r"\b(is|are|was|were|be|been|being)\b", r"\b(has|have|had)\b", r"\b(does|do|did)\b", r"\b\w+ed\b", r"\b\w+ing\b", r"\b\w+s\b")
RELATIONS = (r"\b(?:is|are|was|were)\s+\w+", r"\b(?:has|have|had)\s+\w+", r"\b(?:contains|includes|involves)\b", r"\b(?:causes|results in|leads to)\b", r"\b(?:located|situated|positioned)\b", r"\b(?:belongs to|part of|member of)\b")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DATES = (r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", rf"\b({'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}\b")
ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
# Keywords of document types, in the order that decides ties.
DOCUMENT_TYPES = {
    "academic": ("abstract", "methodology", "conclusion", "hypothesis", "research", "study", "analysis", "findings", "literature review"),
    "technical": ("implementation", "algorithm", "function", "method", "system", "architecture", "configuration", "protocol"),
    "legal": ("whereas", "therefore", "pursuant", "jurisdiction", "statute", "regulation", "contract", "agreement", "clause"),
    "news": ("breaking", "reported", "according to", "spokesperson", "announced", "breaking news"),
}
# Words that inform little.
DULL = ("the", "and", "that", "with", "have", "this", "will", "you", "they", "but", "not", "are", "can", "had", "her", "was", "one", "our", "out", "day")
# Follow-up questions: (asked of the response, words, question).
FOLLOW_UPS = (
    (True, ("more information", "details"), "Would you like me to elaborate on any specific aspect?"),
    (True, ("example",), "Would you like to see more examples?"),
    (True, ("alternative", "option"), "Are you interested in exploring other alternatives?"),
    (False, ("how",), "Do you need help implementing this?"),
    (False, ("what",), "Would you like to know more about this topic?"),
)


def is_proposition(c: Column) -> Column:
    return c.rlike("^[A-Z]") & c.rlike(r"[.!?]$") & c.rlike(T.ascii_edges("|".join(SUBJECTS))) & c.rlike(T.ascii_edges("|".join(PREDICATES)))


def proposition_features(c: Column) -> Column:
    found = lambda p: F.regexp_extract_all(c, F.lit(T.ascii_edges(p)), F.lit(0))
    return F.struct(
        F.array_distinct(found(ENTITY)).alias("entities"),
        F.concat(*[found(p) for p in RELATIONS]).alias("relations"),
        c.rlike(r"\d").alias("has_numbers"),
        c.rlike(T.ascii_edges("|".join(DATES))).alias("has_dates"),
        (F.regexp_count(c, F.lit("[,;]")) + 1).alias("clauses"),
    )


def document_type(c: Column, least: float = 0.1) -> Column:
    low = F.lower(c)
    scores = {k: sum(F.contains(low, F.lit(w)).cast("int") for w in found) / len(found) for k, found in DOCUMENT_TYPES.items()}
    best = F.greatest(*scores.values())
    out = F.lit("unknown")
    for kind, score in reversed(list(scores.items())):
        out = F.when(score == best, kind).otherwise(out)
    return F.when(best < least, "unknown").otherwise(out)


# Marks of code, of which one is enough, and of tables, of which two kinds must stand in a text.
CODE_MARKS = ("function", "class", "import", "def ", "var ", "const ", "let ", "public ", "private ")
TABLE_MARKS = ("|", "\t", "Table", "Column", "Row")


def _kinds(c: Column, marks: tuple[str, ...]) -> Column:
    return sum(F.contains(c, F.lit(m)).cast("int") for m in marks)


def has_code(c: Column) -> Column:
    return _kinds(c, CODE_MARKS) >= 1


def has_tables(c: Column) -> Column:
    return _kinds(c, TABLE_MARKS) >= 2


def strategy_score(strategy: Column, health: Column, weight: Column, c: Column) -> Column:
    """health * weight, raised where the content suits the strategy."""
    complexity = T.content_complexity(c)
    factor = (
        F.when((strategy == "sentence") & (complexity < 0.5), 1.2)
        .when((strategy == "semantic") & (complexity > 0.5), 1.3)
        .when((strategy == "multimodal") & (has_code(c) | has_tables(c)), 1.5)
        .when((strategy == "contextual") & (F.octet_length(c) > 1000), 1.2)
        .when((strategy == "agentic") & (complexity > 0.7), 1.4)
        .otherwise(1.0)
    )
    return health * weight * factor


def informativeness(c: Column) -> Column:
    """Mean of the share of long telling words and the share of different ones."""
    ws = T.words(F.lower(c))
    telling = F.filter(T.trimmed_words(F.lower(c)), lambda w: (F.octet_length(w) > 3) & ~w.isin(*DULL))
    n = F.size(ws)
    return F.coalesce(F.try_divide(F.size(telling) + F.size(F.array_distinct(telling)), 2 * n), F.lit(0.0))


def density(c: Column, tokens: Column) -> Column:
    """5 * (capitalised words + digits / 10) per token, at most 1."""
    found = F.regexp_count(c, F.lit(r"(?:^|\s)[A-Z]")) + F.regexp_count(c, F.lit("[0-9]")) / 10
    return F.least(F.coalesce(F.try_divide(5 * found, tokens), F.lit(0.0)), F.lit(1.0))


def follow_ups(response: Column, query: Column, most: int = 3) -> Column:
    asked = [F.when(F.lower(response if of_response else query).rlike("|".join(found)), F.lit(question)) for of_response, found, question in FOLLOW_UPS]
    return F.slice(F.array_compact(F.array(*asked)), 1, most)


def sentiment_loose(c: Column) -> Column:
    """(polarity, emotion): words that contain a lexicon word."""
    ws = T.words(F.lower(c))
    pos = F.size(F.filter(ws, lambda w: w.rlike("|".join(T.POSITIVE))))
    neg = F.size(F.filter(ws, lambda w: w.rlike("|".join(T.NEGATIVE))))
    polarity = F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))
    return F.struct(polarity.alias("polarity"), F.when(polarity > 0.2, "positive").when(polarity < -0.2, "negative").otherwise("neutral").alias("emotion"))
