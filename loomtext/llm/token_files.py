"""Token files: independent zstandard frames, a trailing seek table, checksums.

Layout of a file (all integers little-endian):

* data frames: each a complete zstandard frame whose content is a count n
  (u32), n document ids (i64), n token counts (u32), then the token ids of
  the n documents, as u16 or, if the tokenizer has ids over 65,535, u32;
* an index frame: the id width in bytes (u32), then for each data frame its
  smallest and largest document id (i64) and the number of tokens before it
  in the file (i64);
* the seek table of the public zstandard seekable format: a skippable frame
  with compressed size, content size and checksum (low 32 bits of XXH64 of the
  content) of every frame, then a 9-byte footer.

A reader takes the footer, the table and the index frame, then only the
frames that hold the documents asked for.  Any zstandard tool can unpack the
whole file.

Edge cases: null or empty text is the end id alone; null ids sort first and
are read back as null; rows that repeat an id are separate documents, ordered
by text; an empty table writes no file and gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .stage import Scratch, new_folder, small_batches

# Of the public zstandard seekable format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_TOKENS = 1 << 16
LEVEL = 3
CACHE_WORDS = 2_000_000
_NO_ID = np.iinfo(np.int64).min
MANIFEST = "part long, first_row long, file string, n_docs long, n_tokens long, n_bytes long"


# --- the file format ------------------------------------------------------


class Writer:
    """Appends documents to a binary stream; a frame is closed at FRAME_TOKENS tokens."""

    def __init__(self, out, width: int, level: int = LEVEL):
        self.out, self.kind, self.width = out, np.dtype(f"<u{width}"), width
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames, self.index, self.n_bytes = [], [], 0
        self.n_docs = self.n_tokens = 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.tokens, self.held = [], [], 0

    def add(self, doc_id: int, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.held += len(tokens)
        if self.held >= FRAME_TOKENS:
            self.flush()

    def flush(self) -> None:
        if self.ids:
            ids = np.array(self.ids, "<i8")
            counts = np.array([len(t) for t in self.tokens], "<u4")
            self.index.append((int(ids.min()), int(ids.max()), self.n_tokens))
            tokens = np.concatenate(self.tokens)
            if int(tokens.max()) > np.iinfo(self.kind).max:
                raise ValueError(f"token id {tokens.max()} needs more than {self.width} bytes")
            self._frame(struct.pack("<I", len(ids)) + ids.tobytes() + counts.tobytes() + tokens.astype(self.kind).tobytes())
            self.n_docs += len(ids)
            self.n_tokens += self.held
        self._clear()

    def _frame(self, content: bytes) -> None:
        packed = self.pack(content)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._write(packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        self.flush()
        self._frame(struct.pack("<I", self.width) + np.array(self.index, "<i8").reshape(-1, 3).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKED, SEEKABLE)
        self._write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Opens a token file (a seekable binary stream of the given size)."""

    def __init__(self, stream, size: int):
        self.stream, self.unpack = stream, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError("no seek table")
        table = np.frombuffer(self._bytes(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.sums = table[:, 0].astype(np.int64), table[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        index = self._content(n - 1)
        self.kind = np.dtype(f"<u{struct.unpack('<I', index[:4])[0]}")
        self.index = np.frombuffer(index[4:], "<i8").reshape(-1, 3)

    def _bytes(self, start: int, n: int) -> bytes:
        self.stream.seek(int(start))
        return self.stream.read(int(n))

    def _content(self, frame: int) -> bytes:
        content = self.unpack(self._bytes(self.starts[frame], self.sizes[frame]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"checksum of frame {frame}")
        return content

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(document ids, token counts, tokens, tokens before the frame) of data frame k."""
        content = self._content(k)
        (n,) = struct.unpack("<I", content[:4])
        ids = np.frombuffer(content, "<i8", n, 4)
        counts = np.frombuffer(content, "<u4", n, 4 + 8 * n)
        return ids, counts.astype(np.int64), np.frombuffer(content, self.kind, -1, 4 + 12 * n), int(self.index[k, 2])

    def __len__(self) -> int:
        return len(self.index)

    def documents(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The tokens of the wanted ids; only frames whose id range holds one are unpacked."""
        wanted = np.unique(np.array(wanted, np.int64))
        hit = np.searchsorted(wanted, self.index[:, 0]) < np.searchsorted(wanted, self.index[:, 1], "right")
        for k in np.flatnonzero(hit):
            ids, counts, tokens, _ = self.frame(int(k))
            ends = np.cumsum(counts)
            for i in np.flatnonzero(np.isin(ids, wanted)):
                yield int(ids[i]), tokens[ends[i] - counts[i] : ends[i]]


# --- tokens of texts ------------------------------------------------------


# Byte classes of the pieces: letters, digits, other ASCII; words with a byte of class 0 stay whole.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[ord("'"), ord("<")]] = 0  # contractions and special tokens


class Pieces:
    """The words of a slice, cut where the tokenizer cuts them whatever stands beside.

    A word of ASCII letters, digits, other marks and Latin-1 letters is cut
    where the class changes and at every digit, and lower-cased; a word with
    any other byte, an apostrophe or "<" is one piece as it stands.
    """

    def __init__(self, docs: K.Docs):
        data = docs.data
        words = K.Words(docs, lower=False, hashed=False)
        kind, low = _CLASS[data], K._LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        second = data[lead + 1]
        latin = (second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)  # all but the signs for times and divided by
        kind[lead[latin]] = kind[lead[latin] + 1] = _LETTER
        upper = lead[latin & (second < 0x9F)] + 1
        low[upper] += 0x20
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        plain = odd[words.ends] == odd[words.starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.starts[plain]] = 1
        inside[words.ends[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        cut = np.zeros(len(data), bool)
        cut[1:] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        cut[words.starts] = True
        self.starts = np.flatnonzero(cut)
        self.word = np.searchsorted(words.starts, self.starts, "right") - 1
        self.ends = np.minimum(np.append(self.starts[1:], len(data)), words.ends[self.word]) if len(self.starts) else self.starts
        self.text = np.where(inside, low, data)
        self.hashes = K.spans_hash(K._BYTE[self.text], self.starts, self.ends)
        self.per_doc = np.searchsorted(self.starts, docs.offsets)


class WordTokens:
    """Encodes texts piece by piece, each distinct piece once while the cache holds it.

    Right for tokenizers that lower-case, drop white space and cut a text
    between letters, digits and other marks and at every digit before merging
    (word_bpe_49k): the ids of a text are then the ids of its pieces in a row.
    The cache is sorted by hash and holds at most CACHE_WORDS pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Adds sorted keys and their texts' ids."""
        found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in found], np.int64)
        n = int(counts.sum())
        while self.n_ids + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + n] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, n)
        starts = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += n
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.counts = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the cache, -1 where it hasn't one."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def encode(self, docs: K.Docs) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all documents in a row, token counts of the documents)."""
        pieces = Pieces(docs)
        codes, keys = pd.factorize(pieces.hashes)
        first = np.zeros(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        order = np.argsort(keys)
        keys, first = keys[order], first[order]
        at = self._places(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.keys) + len(new) > CACHE_WORDS:  # then the cache starts again with this slice's pieces
                self._clear()
                new = np.arange(len(keys))
            raw = pieces.text.tobytes()
            self._learn(keys[new], [raw[pieces.starts[k] : pieces.ends[k]].decode("utf-8") for k in first[new]])
            at = self._places(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = at
        at = place[codes]
        counts, starts = self.counts[at], self.starts[at]
        ends = np.cumsum(counts)
        flat = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        before = np.concatenate([[0], ends])
        return self.ids[flat], before[pieces.per_doc[1:]] - before[pieces.per_doc[:-1]]


_models: dict[str, WordTokens] = {}


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """Token files of rows (id, text, part, row): a new one for each part, and where row doesn't go on by one."""
    from pyarrow import fs

    if tokenizer not in _models:
        _models[tokenizer] = WordTokens(tokenizer)
    model = _models[tokenizer]
    store, root = fs.FileSystem.from_uri(folder)
    end = np.array([end_id], np.uint32)
    writer, done, at = None, [], (None, None)

    def close() -> None:
        writer.close()
        stream.close()
        done.append({"part": first[0], "first_row": first[1], "file": f"{folder}/{name}", "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_bytes": writer.n_bytes})

    for batch in batches:
        ids = batch.column(0).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
        parts, rows = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for docs in K.slices(batch.column(1)):
            tokens, counts = model.encode(docs)
            ends = np.cumsum(counts)
            for i in range(docs.n):
                k = docs.first + i
                if at != (parts[k], rows[k]):
                    if writer is not None:
                        close()
                    store.create_dir(root, recursive=True)
                    # a lost or repeated attempt leaves a file that no manifest names
                    first, name = (parts[k], rows[k]), f"part-{parts[k]:09d}-{rows[k]:012d}-{uuid.uuid4().hex}.tok.zst"
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer = Writer(stream, width)
                writer.add(int(ids[k]), np.append(tokens[ends[i] - counts[i] : ends[i]], end))
                at = (parts[k], rows[k] + 1)
    if writer is not None:
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int64()), ("first_row", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["file"])
            with store.open_input_file(path) as stream:
                reader = Reader(stream, row["n_bytes"])
                for k in range(len(reader)):
                    ids, counts, tokens, before = reader.frame(k)
                    ends = np.cumsum(counts)
                    wide = tokens.astype("<u4").tobytes()
                    sums = [zlib.crc32(wide[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(ids, pa.int64(), mask=ids == _NO_ID),
                        "start": pa.array(row["tokens_before"] + before + ends - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    })


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that every id of the tokenizer, and the end id, fits."""
    from tokenizers import Tokenizer

    return 2 if max(*Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), end_id) < 1 << 16 else 4


def _written(rows: DataFrame, folder: str, tokenizer: str, end_id: int, width: int | None) -> DataFrame:
    small_batches(rows.sparkSession)
    width = id_width(tokenizer, end_id) if width is None else width
    return Scratch(rows.sparkSession, "manifest").keep(rows.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, width=width), MANIFEST))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, order_by: list[str], id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, width: int | None = None) -> DataFrame:
    """Writes docs in the order of order_by, one file a range partition; gives the manifest.

    width: bytes of an id, by default as many as the tokenizer's ids need; an id
    that doesn't fit is an error.

    The manifest (one row a file) is written before it is returned, so files
    are written once; a file counts only if its task succeeded.
    """
    ordered = docs.repartitionByRange(*order_by).sortWithinPartitions(*order_by, text_col)
    part = F.spark_partition_id().cast("long")
    row = F.monotonically_increasing_id() - F.shiftleft(part, 33)
    return _written(ordered.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), part.alias("part"), row.alias("row")), folder, tokenizer, end_id, width)


def write_tokens_as_stored(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, width: int | None = None) -> DataFrame:
    """Writes docs, a scan of Parquet files that Spark wrote, in the order of the files' numbers and rows; no shuffle."""
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    part = number(r"part-(\d+)") * 1000 + number(r"-c(\d+)")
    return _written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), part.alias("part"), F.col("_metadata.row_index").alias("row")), folder, tokenizer, end_id, width)


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files of a manifest: id, start (tokens of all documents before), n_tokens, ids_crc32."""
    order = Window.orderBy("part", "first_row").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("part", "first_row", "file", "n_bytes", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("tokens_before"))
    # a number of partitions that is given isn't coalesced, however small the manifest is
    dealt = files.repartitionByRange(max(1, manifest.count()), "part", "first_row")
    out = dealt.select("file", "n_bytes", "tokens_before").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", order_by: list[str] | None = None, as_stored: bool = False) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    if as_stored:
        return read_tokens(write_tokens_as_stored(docs, folder, tokenizer, id_col, text_col), id_col)
    return read_tokens(write_tokens(docs, folder, tokenizer, order_by or [id_col], id_col, text_col), id_col)
