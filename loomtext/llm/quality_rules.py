"""Quality rules, line first: failing lines go, then documents that lost too much.

Each line is judged by itself (navigation bars, symbol noise, shouting,
repeated filler, running text without any sentence mark, boilerplate
sentences in a short line); failing lines are removed; a document is rejected when removed
lines held more than ``max_lost`` of its code points in words, or when it
fails the base rules on its whole text.  One map over the documents: no
shuffle, whatever the sources' sizes; a verdict depends on its document alone.

Edge cases: a null or empty text has no words, fails the base rules and is
rejected; a null id stays null; repeated rows are judged one by one; an empty
table gives an empty result; columns besides id and text are ignored by
``assess`` and carried unchanged by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .stage import small_batches

# The rules' limits.
NAV_BARS, NAV_SHARE = 3, 0.25  # separators in a line, and per word
SYMBOL_SHARE = 0.5  # symbols per word
FILLER_WORDS, FILLER_DISTINCT = 10, 1 / 3  # a line of so many words, so few distinct
MARK_WORDS = 8  # a line of so many words needs a sentence mark somewhere
MARKS = ".!?。！？…।؟۔"  # sentence marks of several scripts
FURNITURE_WORDS = 30  # a boilerplate sentence fails a line of at most so many words, not running text about it
MAX_LOST = 0.5
MIN_WORDS = 50
# Sentences of page furniture, matched on the lower-cased line.
BOILERPLATE = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "subscribe to our newsletter", "terms of use", "javascript is disabled", "click here to")

_SYMBOL, _BAR, _UPPER, _LOWER, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BAR[ord("|")] = True
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_MARK[[ord(c) for c in MARKS if ord(c) < 128]] = True
_WIDE_MARKS = [c.encode() for c in MARKS if ord(c) >= 128]

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, failed_chars long"


class Lines:
    """The \\n-separated lines of a slice: byte bounds, and documents' offsets into them."""

    def __init__(self, docs: K.Docs):
        data = docs.data
        breaks = np.flatnonzero(data == 0x0A)
        doc_of_break = np.searchsorted(docs.offsets, breaks, "right") - 1
        self.starts = np.concatenate([docs.offsets[:-1], breaks + 1])
        self.ends = np.concatenate([breaks, docs.offsets[1:]])
        self.doc = np.concatenate([np.arange(docs.n), doc_of_break])
        order = np.lexsort((self.starts, self.doc))
        self.starts, self.doc = self.starts[order], self.doc[order]
        # the k-th line of a document ends at its k-th break, the last at the document's end
        ends_doc = np.concatenate([doc_of_break, np.arange(docs.n)])
        self.ends = self.ends[np.lexsort((self.ends, ends_doc))]
        self.per_doc = np.searchsorted(self.doc, np.arange(docs.n + 1))


def groups(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: how often its hash is in its document, and whether it is the first."""
    key = K.mix(hashes ^ K.mix(doc.astype(np.uint64)))
    _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), bool)
    is_first[first] = True
    return counts[inverse], is_first


def sentence_marks(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every sentence mark."""
    marks = _MARK[data]
    for mark in _WIDE_MARKS:
        at = np.flatnonzero(data[: len(data) - len(mark) + 1] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        marks[at] = True
    return marks


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[ends] - sums[starts]


def judge(docs: K.Docs, max_lost: float) -> tuple[dict[str, np.ndarray], Lines, np.ndarray]:
    """The figures of each document of a slice, its lines, and which lines fail."""
    words, lines, data = K.Words(docs, lower=False), Lines(docs), docs.data
    n_words = words.counts()
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, words.starts, 1)
    np.add.at(solid, words.ends, -1)
    in_word = np.cumsum(solid[:-1]) > 0
    letters = in_word & K.code_points(data)
    doc_chars = _within(letters, docs.offsets[:-1], docs.offsets[1:])
    # base rules
    line_hash = K.spans_hash(K._BYTE[data], lines.starts, lines.ends)
    first_word = np.searchsorted(words.starts, lines.starts)
    after_word = np.searchsorted(words.starts, lines.ends)
    line_words = after_word - first_word
    full = line_words > 0
    dup = np.zeros(len(lines.starts), bool)
    dup[full] = ~groups(lines.doc[full], line_hash[full])[1]
    at, grams = words.grams(3)
    many, _ = groups(words.doc[at], grams)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[many > 1], 1)
    np.add.at(cover, at[many > 1] + 3, -1)
    repeat = np.cumsum(cover[:-1]) > 0
    n_repeat = _within(repeat, words.per_doc[:-1], words.per_doc[1:])
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    # line rules
    line_of_word = np.searchsorted(lines.starts, words.starts, "right") - 1
    distinct = np.bincount(line_of_word[groups(line_of_word, words.hashes)[1]], minlength=len(lines.starts)) if len(words) else np.zeros(len(lines.starts), np.int64)
    count = {name: _within(table[data], lines.starts, lines.ends) for name, table in (("bar", _BAR), ("symbol", _SYMBOL), ("upper", _UPPER), ("lower", _LOWER))}
    count["mark"] = _within(sentence_marks(data), lines.starts, lines.ends)
    line_chars = _within(letters, lines.starts, lines.ends)
    failed = (count["bar"] >= NAV_BARS) & (count["bar"] >= NAV_SHARE * line_words)
    failed |= count["symbol"] - count["bar"] >= np.maximum(1, SYMBOL_SHARE * line_words)
    failed |= (count["upper"] > count["lower"]) & (line_words > 2)
    failed |= (line_words >= FILLER_WORDS) & (distinct < FILLER_DISTINCT * line_words)
    failed |= (line_words >= MARK_WORDS) & (count["mark"] == 0)
    lowered = bytes(K._LOWER[data])
    for phrase in BOILERPLATE:
        place = lowered.find(phrase.encode())
        while place >= 0:
            line = np.searchsorted(lines.starts, place, "right") - 1
            # a slice holds one document behind the other, so the phrase must end inside its line
            if place + len(phrase) <= lines.ends[line] and line_words[line] <= FURNITURE_WORDS:
                failed[line] = True
            place = lowered.find(phrase.encode(), place + 1)
    failed &= full
    per_line = lines.per_doc
    total = lambda flags: _within(flags, per_line[:-1], per_line[1:])
    failed_chars = total(np.where(failed, line_chars, 0))
    kept = ~base_failed & (failed_chars <= max_lost * doc_chars)
    return {
        "n_words": n_words,
        "word_chars": doc_chars,
        "n_symbols": _within(_SYMBOL[data], docs.offsets[:-1], docs.offsets[1:]),
        "n_dup_lines": total(dup),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": kept,
        "n_lines": np.diff(per_line),
        "n_failed_lines": total(failed),
        "failed_chars": failed_chars,
    }, lines, failed


def _assess(batches: Iterator[pa.RecordBatch], max_lost: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in K.slices(batch.column(1)):
            figures, _, _ = judge(docs, max_lost)
            ids = batch.column(0).slice(docs.first, docs.n)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in figures.values())], [batch.schema.names[0], *figures])


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per row of docs: its id, the base figures and both verdicts."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(partial(_assess, max_lost=max_lost), f"`{id_col}` {kind}, {RESULT}")


def _clean(batches: Iterator[pa.RecordBatch], text_at: int, chars_at: int | None, max_lost: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in K.slices(batch.column(text_at)):
            figures, lines, failed = judge(docs, max_lost)
            raw, texts = docs.data.tobytes(), []
            keep = np.flatnonzero(figures["kept"])
            for i in keep:
                a, b = lines.per_doc[i], lines.per_doc[i + 1]
                if failed[a:b].any():
                    texts.append(b"\n".join(raw[lines.starts[k] : lines.ends[k]] for k in range(a, b) if not failed[k]).decode("utf-8"))
                else:
                    texts.append(raw[docs.offsets[i] : docs.offsets[i + 1]].decode("utf-8"))
            rows = batch.take(pa.array(docs.first + keep))
            columns = list(rows.columns)
            columns[text_at] = pa.array(texts, pa.string()).cast(rows.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], pa.int64()).cast(rows.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept rows of docs with failing lines removed from the text; same columns.

    chars_col, where docs has it, is set to the new number of code points.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    chars_at = names.index(chars_col) if chars_col in names else None
    return docs.mapInArrow(partial(_clean, text_at=names.index(text_col), chars_at=chars_at, max_lost=max_lost), docs.schema)
