import random
import re

import numpy as np

from loomtext.llm import line_dedup as L
from loomtext.llm import substring_dedup as S

from .helpers import WORD, crowded, documents, frame, lower, plain, sha

STRIP = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def brute_lines(rows):
    holders = {}
    for k, (i, t, *_) in enumerate(rows):
        for line in (t or "").split("\n"):
            key = lower(STRIP.sub("", line))
            if len(key) >= 40:
                holders.setdefault(key, {})[k] = -1 if i is None else i
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(h := holders.get(lower(STRIP.sub("", x)), {})) >= 5 and max(h.values()) != (-1 if i is None else i))]
        out.append((i, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=str)


def brute_windows(rows):
    """Each row is a document; null ids are the smallest, equal ids aren't smaller than one another."""
    order = lambda i: -(10**9) if i is None else i
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    least = {}
    for (i, *_), w in zip(rows, texts):
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            least[key] = min(order(i), least.get(key, order(i)))
    out = []
    for (i, *_), w in zip(rows, texts):
        gone, seen = set(), set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen or least[key] < order(i):
                gone.update(range(p, p + 20))
            seen.add(key)
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        sizes, bits = L.build_mph(keys)
        ranks = np.cumsum(bits) - 1
        assert sorted(L.index_mph(keys, sizes, bits, ranks).tolist()) == list(range(len(keys)))
        other = keys + np.uint64(1)
        prints = np.zeros(len(keys), np.uint64)
        prints[L.index_mph(keys, sizes, bits, ranks)] = keys
        at = L.index_mph(other, sizes, bits, ranks)
        assert not ((at >= 0) & (prints[np.maximum(at, 0)] == other)).any() if len(keys) else (at < 0).all()


def test_lines_equal_brute_force(spark):
    rows = documents()
    assert plain(L.dedup_lines(crowded(frame(spark, rows)))) == brute_lines(rows)


def test_lines_in_several_rounds_and_shards(spark):
    rows = [(i, "\n".join(f"line {k} that is long enough to be looked at, surely" for k in range(i % 11)), "en", "s", 0) for i in range(60)]
    one = plain(L.dedup_lines(frame(spark, rows)))
    assert one == brute_lines(rows)
    assert plain(L.dedup_lines(frame(spark, rows), shard_keys=2, round_bytes=300)) == one


def test_windows_equal_brute_force(spark):
    rows = documents()
    assert plain(S.dedup_substrings(crowded(frame(spark, rows)))) == brute_windows(rows)


def test_windows_of_repetitive_texts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))), "en", "s", 0) for i in range(30)]
    rows += [(100 + i, "x " * n, "en", "s", 0) for i, n in enumerate((19, 20, 21, 60, 0))]
    assert plain(S.dedup_substrings(frame(spark, rows))) == brute_windows(rows)
    monkeypatch.setattr(S, "RUN_BLOCKS", 7)
    assert plain(S.dedup_substrings(frame(spark, rows))) == brute_windows(rows)


def odd_rows():
    """Repeated ids with equal and with other texts, and null ids."""
    rows = [r for r in documents(3) if r[1] is None or len(r[1]) < 2000]
    line = "This very line stands in many of the documents, again and again."
    rows += [(i, f"{t}\n{line}", "en", "s", 0) for i, t in [(rows[5][0], "other"), (None, "one"), (None, "two"), (None, "two"), (9000, "x"), (9000, "y")]]
    return rows + rows[3:9] + [(None, rows[20][1], "en", "s", 0), (rows[21][0], rows[22][1], "en", "s", 0)]


def test_sql_twins_on_odd_rows(spark):
    """The SQL and the operators agree on ids that repeat or are null."""
    import duckdb
    import pandas as pd

    from loomtext.llm import near_dedup as N
    from loomtext.llm import queries as Q

    rows = odd_rows()
    documents_ = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM documents_")
    for name, found in (("op1_near_dedup", N.near_duplicates), ("op3_line_dedup", L.dedup_lines), ("op4_substring_dedup", S.dedup_substrings)):
        want = con.execute(Q.ORACLE_SQL[name]).fetchall()
        got = [tuple(r) for r in found(frame(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
    assert plain(L.dedup_lines(frame(spark, rows))) == brute_lines(rows)
    assert plain(S.dedup_substrings(frame(spark, rows))) == brute_windows(rows)


def test_windows_of_null_and_repeated_ids(spark):
    rng = random.Random(7)
    passage, other = ([f"{c}{rng.randrange(900)}" for _ in range(25)] for c in "pq")
    own = [" ".join(f"u{rng.randrange(9999)}" for _ in range(30)) for _ in range(6)]
    texts = [" ".join(passage + other), own[0], " ".join(["s"] + passage), own[1] + " " + " ".join(passage), " ".join(other + other)]
    for ids in ([None] * 5, [7] * 5, [7, None, 7, None, 3], [None, 1, 1, 2, None]):
        rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts)]
        rows += [rows[0], rows[0], (8, " ".join(passage), "en", "s", 0)]
        assert plain(S.dedup_substrings(frame(spark, rows))) == brute_windows(rows), ids


def test_windows_when_every_scan_has_another_order(spark, monkeypatch):
    """Rows behind a random sort: what a run settles must not depend on a second scan."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    passages = [" ".join(f"p{k}x{rng.randrange(999)}" for _ in range(24)) for k in range(6)]
    rows = [(k, " ".join([f"a{rng.randrange(9999)}" for _ in range(6)] + [passages[rng.randrange(6)]] + [f"b{rng.randrange(9999)}" for _ in range(6)]), "en", "s", 0) for k in range(60)]
    expected = brute_windows(rows)
    monkeypatch.setattr(S, "RUN_BLOCKS", 20)
    for _ in range(3):
        assert plain(S.dedup_substrings(frame(spark, rows).repartition(1).withColumn("r", F.rand()).orderBy("r"))) == expected


def test_windows_of_a_thousand_null_ids(spark):
    """Rows without an id keep each other's words, and lose their own repeats; rows with ids lose theirs to them."""
    rng = random.Random(14)
    common = " ".join(f"c{rng.randrange(999)}" for _ in range(22))
    rows = [(None, f"n{k} {common if k % 3 == 0 else ''} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(21)), "en", "s", 0) for k in range(1500)]
    rows += [(None, f"{common} {common}", "en", "s", 0), (5, f"x {common}", "en", "s", 0)]
    assert plain(S.dedup_substrings(frame(spark, rows))) == brute_windows(rows)


def test_windows_around_a_common_line(spark, monkeypatch):
    """A line that most texts hold, each in other words: many blocks on one anchor, over several runs."""
    rng = random.Random(11)
    line = " ".join(f"c{rng.randrange(999)}" for _ in range(26))
    rows = [(k, f"{' '.join(f'a{rng.randrange(9999)}' for _ in range(rng.randint(0, 40)))} {line} {' '.join(f'b{rng.randrange(9999)}' for _ in range(rng.randint(0, 40)))}", "en", "s", 0) for k in range(80)]
    expected = brute_windows(rows)
    assert plain(S.dedup_substrings(frame(spark, rows))) == expected
    monkeypatch.setattr(S, "RUN_BLOCKS", 25)
    assert plain(S.dedup_substrings(frame(spark, rows))) == expected
    for n in (1, 5):
        assert plain(S.dedup_substrings(frame(spark, rows).repartition(n))) == expected


def test_factors_copy_from_the_reference(spark):
    rows = [r for r in documents() if r[1]]
    words = {i: WORD.findall(t) for i, t, *_ in rows}
    found = S.factors(frame(spark, rows)).collect()
    for f in found:
        assert words[f["doc_id"]][f["start"] : f["start"] + f["words"]] == words[f["ref_id"]][f["ref_start"] : f["ref_start"] + f["words"]]
        assert (f["ref_id"], f["ref_start"]) < (f["doc_id"], f["start"]) and f["words"] >= 20
    assert len(found) > 20


def test_kept_text(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = {r["doc_id"]: r["kept_text"] for r in S.dedup_substrings(frame(spark, [(1, text, "en", "s", 0), (2, f"new  {text} end", "en", "s", 0)]), with_text=True).collect()}
    assert got == {1: text, 2: "new end"}


def test_empty_tables_and_nulls(spark):
    assert L.dedup_lines(frame(spark, [])).count() == 0 and S.dedup_substrings(frame(spark, [])).count() == 0
    rows = [(None, "a " * 30, "en", "s", 0), (1, "a " * 30, None, None, None)]
    got = {r["doc_id"]: r["n_removed"] for r in S.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {None: 29, 1: 30} or got == {None: 30 - 1, 1: 30}
    lines = [(k, "a line of more than forty code points, all told it is", "en", "s", 0) for k in (None, 1, 2, 3, 4, 4)]
    got = sorted(((r["doc_id"], r["n_dropped"]) for r in L.dedup_lines(frame(spark, lines)).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)], key=str)
