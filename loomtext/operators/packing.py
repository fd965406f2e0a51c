"""Packing of a document's units into chunks, in time linear in its units.

One Arrow map: the running token counts of a document are prefix sums, so the
unit that opens the next chunk is found by a binary search, one for each chunk,
and the chunks' texts are joined from the batch's flat array of units.  No state
grows with the document but its own arrays.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from loomtext.plans.shared import small_batches

NO_LIMIT = 2**31 - 1


@dataclass(frozen=True)
class Rule:
    """A unit opens a chunk when the running tokens would pass the budget and the
    chunk holds at least `least` units, or when it holds max_units.  A chunk begins
    with the last units of the one before that fit `overlap` tokens.  With
    merge_below, two neighbouring chunks that are both smaller become one if it
    keeps to the budget; a merged chunk isn't merged again."""

    budget: int
    max_units: int = NO_LIMIT
    least: int = 1
    overlap: int = 0
    merge_below: float = 0


def openings(sizes: np.ndarray, rule: Rule, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first new unit, units repeated before it) of each chunk; with flags, a full chunk ends only before a flagged unit, or at max_units."""
    n = len(sizes)
    sums = np.append(0, np.cumsum(sizes, dtype=np.int64))
    if flags is not None:  # the first flagged unit at or after each one
        at = np.where(flags, np.arange(n), n)
        following = np.append(np.minimum.accumulate(at[::-1])[::-1], n)
    opens, backs = [], []
    unit = held = 0  # held: units of the chunk before
    while unit < n:
        # units of no tokens would all fit: at most overlap of them are looked at
        fits = unit - max(int(np.searchsorted(sums, sums[unit] - rule.overlap, "left")), unit - rule.overlap, 0) if rule.overlap > 0 else 0
        back = min(fits, held)
        opens.append(unit)
        backs.append(back)
        room = rule.budget + sums[unit - back]
        after = max(int(np.searchsorted(sums, room, "right")) - 1, unit + 1, unit + rule.least - back)
        if flags is not None:
            after = int(following[min(after, n)])
        after = min(after, max(unit + 1, unit + rule.max_units - back), n)
        held, unit = back + after - unit, after
    return np.array(opens, np.int64), np.array(backs, np.int64)


def _offsets(column: pa.ListArray) -> np.ndarray:
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))


Places = Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def _pack(batches: Iterator[pa.RecordBatch], joiner: str, places: Places) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (doc_id, units, sizes, more): places(sizes, more) gives the first unit and the end of each."""
    for batch in batches:
        units, sizes = pc.list_flatten(batch.column(1)), pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = _offsets(batch.column(1))
        more = pc.list_flatten(batch.column(3)).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else None
        more_at = _offsets(batch.column(3)) if batch.num_columns > 3 else None
        doc, number, first, last = [], [], [], []
        for i in range(batch.num_rows):
            a, b = offsets[i], offsets[i + 1]
            if a == b:
                continue
            begins, ends = places(sizes[a:b], None if more is None else more[more_at[i] : more_at[i + 1]])
            doc.append(np.full(len(begins), i))
            number.append(np.arange(1, len(begins) + 1))
            first.append(a + begins)
            last.append(a + ends)
        if not doc:
            continue
        doc, number, first, last = (np.concatenate(x) for x in (doc, number, first, last))
        counts = last - first
        ends = np.cumsum(counts)
        at = np.repeat(first - ends + counts, counts) + np.arange(ends[-1])
        sums = np.append(0, np.cumsum(sizes))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), units.take(pa.array(at))), joiner)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), texts, pa.array((sums[last] - sums[first]).astype(np.int32))], ["doc_id", "chunk_no", "text", "tokens"])


def _by_rule(sizes: np.ndarray, flags: np.ndarray | None, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    opens, backs = openings(sizes, rule, flags)
    return opens - backs, np.append(opens[1:], len(sizes))


def _merged(first: np.ndarray, last: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    sums = np.append(0, np.cumsum(sizes))
    tokens, begins, ends, k = sums[last] - sums[first], [], [], 0
    while k < len(first):
        both = k + 1 < len(first) and max(tokens[k], tokens[k + 1]) < rule.merge_below and tokens[k] + tokens[k + 1] <= rule.budget
        begins.append(first[k])
        ends.append(last[k + both])
        k += 1 + both
    return np.array(begins, np.int64), np.array(ends, np.int64)


def _in_sections(sizes: np.ndarray, cuts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Each section between cuts packed by itself; texts without cuts are one section."""
    edges, first, last = np.concatenate([[0], cuts, [len(sizes)]]).astype(np.int64), [], []
    for a, b in zip(edges[:-1], edges[1:]):
        begins, ends = _by_rule(sizes[a:b], None, rule)
        first.append(a + begins)
        last.append(a + ends)
    first, last = np.concatenate(first), np.concatenate(last)
    return _merged(first, last, sizes, rule) if rule.merge_below and not len(cuts) else (first, last)


def _at_cuts(sizes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(0, cuts).astype(np.int64), np.append(cuts, len(sizes)).astype(np.int64)


def _by_step(sizes: np.ndarray, _: None, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(sizes)
    begins = np.arange(0, max(n - (size - step), 1), step)
    return begins, np.minimum(begins + size, n)


def _chunks(docs: DataFrame, joiner: str, places: Places) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = S.StructType([docs.schema["doc_id"], S.StructField("chunk_no", S.IntegerType()), S.StructField("text", S.StringType()), S.StructField("tokens", S.IntegerType())])
    return docs.mapInArrow(partial(_pack, joiner=joiner, places=places), schema)


def packed(docs: DataFrame, joiner: str, rule: Rule) -> DataFrame:
    """docs has doc_id, units, sizes and perhaps flags (one a unit): one row per chunk (doc_id, chunk_no from 1, text, tokens)."""
    flags = ["flags"] if "flags" in docs.columns else []
    return _chunks(docs.select("doc_id", "units", "sizes", *flags), joiner, partial(_by_rule, rule=rule))


def packed_sections(docs: DataFrame, joiner: str, rule: Rule) -> DataFrame:
    """docs has doc_id, units, sizes, cuts: units packed by rule between the cuts; what no cut divides may be merged."""
    return _chunks(docs.select("doc_id", "units", "sizes", "cuts"), joiner, partial(_in_sections, rule=rule))


def cut_at(docs: DataFrame, joiner: str) -> DataFrame:
    """docs has doc_id, units, sizes, cuts (indexes of units before which a chunk begins, ascending, over 0): one row per chunk."""
    return _chunks(docs.select("doc_id", "units", "sizes", "cuts"), joiner, _at_cuts)


def windows(docs: DataFrame, joiner: str, size: int, step: int) -> DataFrame:
    """docs has doc_id, units, sizes: a chunk of size units at every step, until one reaches the end."""
    return _chunks(docs.select("doc_id", "units", "sizes"), joiner, partial(_by_step, size=size, step=step))


#: Marks that count as half a token each in the word counts of texts, and characters of a token where only they are left to cut at.
MARKS, CHARACTERS = b""".,!?;:()[]{}"'""", 4


def recursive_pieces(docs: DataFrame, size: int, separators: tuple[str, ...]) -> DataFrame:
    """(doc_id, piece_no, text, tokens) of docs (doc_id, text): a text over the size is cut after a separator,
    parts in a row are one piece while they fit, and a part that doesn't is cut after the next separator,
    at last between characters."""
    small_batches(docs.sparkSession)
    fields = [docs.schema["doc_id"], S.StructField("piece_no", S.IntegerType()), S.StructField("text", S.StringType()), S.StructField("tokens", S.LongType())]
    return docs.select("doc_id", "text").mapInArrow(partial(_recursive, size=size, separators=[s.encode() for s in separators]), S.StructType(fields))


def _recursive(batches: Iterator[pa.RecordBatch], size: int, separators: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(texts) and bounds[-1] else np.zeros(0, np.uint8)
        pieces = _Pieces(raw, bounds - bounds[0] if len(bounds) else bounds, size, separators)
        owner, no, ends = [], [], [0]
        for k, (a, b) in enumerate(zip(pieces.bounds[:-1], pieces.bounds[1:])):
            cut = pieces.cut(a, b, 0) if b > a else []
            owner += [k] * len(cut)
            no += range(1, len(cut) + 1)
            ends += cut
        at = np.array(ends, np.int64)
        text = pa.LargeStringArray.from_buffers(len(owner), pa.py_buffer(at), pa.py_buffer(raw)).cast(pa.string())
        counts = [pieces.tokens(a, b) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(no, pa.int32()), text, pa.array(counts, pa.int64())], ["doc_id", "piece_no", "text", "tokens"])


class _Pieces:
    """The bytes of some texts one after the other, with running counts of words and marks."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, size: int, separators: list[bytes]):
        self.bounds, self.size, self.separators = bounds.tolist(), size, separators
        letter = ~np.isin(raw, np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
        opens = letter & np.append(True, ~letter[:-1])[: len(raw)]
        opens[bounds[:-1][bounds[:-1] < len(raw)]] |= letter[bounds[:-1][bounds[:-1] < len(raw)]]
        count = lambda flags: np.append(0, np.cumsum(flags)).tolist()
        self.words, self.marks = count(opens), count(np.isin(raw, np.frombuffer(MARKS, np.uint8)))
        self.inside = (letter & ~opens).tolist()
        self.after = [self._ends(raw, s) for s in separators]
        self.characters = np.flatnonzero((raw & 0xC0) != 0x80).tolist()

    @staticmethod
    def _ends(raw: np.ndarray, separator: bytes) -> list[int]:
        n, found = len(separator), np.ones(max(0, len(raw) - len(separator) + 1), bool)
        for k, byte in enumerate(separator):
            found &= raw[k : k + len(found)] == byte
        return (np.flatnonzero(found) + n).tolist()

    def tokens(self, a: int, b: int) -> int:
        return self.words[b] - self.words[a] + (b > a and self.inside[a]) + (self.marks[b] - self.marks[a]) // 2

    def cut(self, a: int, b: int, level: int) -> list[int]:
        """The ends of the pieces of the bytes from a to b."""
        if self.tokens(a, b) <= self.size:
            return [b]
        last = level == len(self.separators)
        after = self.characters if last else self.after[level]
        first, end = bisect.bisect_left(after, a + (1 if last else len(self.separators[level]))), bisect.bisect_left(after, b)
        if first == end and not last:
            return self.cut(a, b, level + 1)
        out = []
        while a < b:
            most = min(end, first + CHARACTERS * self.size) if last else end
            # the parts that fit together; b is the end of the last one
            fit = bisect.bisect_right(after, self.size, first, most, key=lambda x: self.tokens(a, x))
            if fit == end and self.tokens(a, b) <= self.size and (not last or end - first < CHARACTERS * self.size):
                return [*out, b]
            if fit > first or last:
                to = after[max(fit, first + 1) - 1]
                out.append(to)
            else:
                to = after[first] if first < end else b
                out += self.cut(a, to, level + 1)
            a = to
            first = bisect.bisect_right(after, a, first, end)
        return out
