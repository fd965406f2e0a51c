"""Fixtures and brute-force versions that the operator tests share."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=0):
    """Copies, near copies, shared passages and lines, odd white space, nulls, and one very long text."""
    rng = random.Random(seed)
    base = [words_text(rng, rng.randint(20, 90)) for _ in range(14)]
    texts = list(base)
    for b in base[:8]:
        for edits in (1, 2, 4, 8):
            w = b.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(w))
    passage = words_text(rng, 45)
    line = "This very line stands in many of the documents, again and again."
    texts += [f"{words_text(rng, 10)} {passage} {words_text(rng, 9)}" for _ in range(5)]
    texts += [f"{words_text(rng, 12)}.\n  {line.upper() if k % 2 else line}\t\n{words_text(rng, 6)}" for k in range(7)]
    texts += [base[0], base[0], base[1].upper(), "", None, "   \n\t ", "one two", "One TWO", "a\x0bb\x0cc d", "é ÉÀ ü 日本 🙂 ß", "\n\n", "same " * 60]
    texts.append(words_text(rng, 20000, 3000))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * k, texts[i], "en", f"s{i % 3}" if i % 7 else None, None if texts[i] is None else len(texts[i])) for k, i in enumerate(order)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def crowded(df):
    """The same rows with columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    names = ["id", "n", "bucket", "component", "kept", "text_a", "a", "b", "spans", "gram", "words", "score", "slot", "place", "part", "file", "row", "label", "rank", "key", "tokens", "path", "start"]
    return df.select("*", *[F.lit(7).alias(x) for x in names])


def plain(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)
