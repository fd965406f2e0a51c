"""Words, lines and rolling hashes of a batch of texts, with numpy only.

Spark hands each task Arrow batches of texts; the helpers here turn a batch
into flat arrays (one entry per word or line, plus offsets per document), so
an operator's ``mapInArrow`` body is a few array expressions.  Hashes are 64
bits wide: a fixed random value per byte, times a power of the place, summed
modulo 2**64 and mixed.  Two different strings get the same value with a
chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Documents are worked on in slices of about this many bytes, so that the
#: temporary arrays stay a few tens of MB whatever the batch holds.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal spans, equal hashes."""
    up, down = powers(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Docs:
    """A slice of documents as one byte array and document offsets into it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def __len__(self) -> int:
        return self.n


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Docs]:
    """Cuts a column of texts into slices of whole documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Docs(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice.

    starts, ends: byte places in docs.data; per_doc: document i has the words
    per_doc[i]:per_doc[i+1]; hashes: of each word, of its lower-cased form
    (A-Z only) if asked for.  Other separators than white space can be given as
    a table of bytes.  With characters, each character of a script that is
    written without spaces is a word of its own, and its marks separate.
    """

    def __init__(self, docs: Docs, lower: bool, hashed: bool = True, separators: np.ndarray = _SPACE, characters: bool = False):
        data, self.docs = docs.data, docs
        solid = ~separators[data]
        single, marks = unspaced(data) if characters else (None, None)
        if characters:
            for k in range(3):
                solid[marks + k] = False
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        if characters:
            before[single] = False
            after_them = single + 3
            before[after_them[after_them < len(data)]] = False
        cuts = docs.offsets[:-1]
        before[cuts[cuts < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:] & before[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.per_doc = np.searchsorted(self.starts, docs.offsets)
        self.doc = np.repeat(np.arange(docs.n), np.diff(self.per_doc))
        if hashed:
            values = _BYTE[_LOWER[data] if lower else data]
            self.hashes = spans_hash(values, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.per_doc)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first words, hashes) of all n-word windows within one document."""
        last = self.per_doc[1:][self.doc] if len(self) else np.zeros(0, np.int64)
        at = np.flatnonzero(np.arange(len(self)) + n <= last)
        return at, spans_hash(self.hashes, at, at + n)


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of (Han, Kana and Thai characters, ideographic and full-width marks); all have three bytes."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    lead, second = data[at], data[at + 1]
    han = (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xE3) & (second >= 0x81)
    thai = (lead == 0xE0) & ((second == 0xB8) | (second == 0xB9))
    return at[han | thai], at[(lead == 0xE3) & (second == 0x80) | (lead == 0xEF) & (second == 0xBC)]


def words(texts: pa.Array, lower: bool, hashed: bool = True) -> Iterator[Words]:
    for docs in slices(texts):
        yield Words(docs, lower, hashed)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def long_array(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
