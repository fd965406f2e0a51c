import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import merkle as M
from loomtext.llm import queries as Q
from loomtext.llm import ranked_search as R
from loomtext.llm import winnowing as W

from .helpers import crowded, documents, frame, lower, plain, sha, words_text


def odd_documents():
    """The shared fixture with null and repeated ids, equal rows and a null source."""
    rows = documents()
    rows += [(None, "without an id", "en", "s1", 13), (None, "without an id, too\nreally", "en", None, 24), (6, "id six again", None, "s1", 1), (6, "id six again", None, "s1", 1), (9, None, "en", "s0", None), (9, "", "en", "s0", 0)]
    return rows


# Merkle manifest


def H(parts):
    return sha("".join(parts))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at, digest):
    """(siblings, folded top) of a leaf."""
    beside = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        beside += run[: at % 3] + run[at % 3 + 1 :]
        run[at % 3] = digest
        at, digest = at // 3, H(run)
    return beside, digest


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def manifest(rows):
    def changed(i, text):
        return text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = [sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, changed(r[0], r[1])), r[0]) for r in rows if r[3] == s), key=str) for s in sources]
    held = [sorted(h, key=lambda x: x[:3]) for h in held]
    trees = [tree([x[2] for x in h]) for h in held]
    upper = tree([t[-1][0] for t in trees])
    out = []
    for s, (h, t) in enumerate(zip(held, trees)):
        for k, (_, _, own, new, i) in enumerate(h):
            beside, _ = way(t, k, own)
            more, _ = way(upper, s, t[-1][0])
            folded = way(upper, s, way(t, k, new)[1])[1]
            out.append((i, own, t[-1][0], upper[-1][0], H(beside + more), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def altered():
    return F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def test_manifest_equals_a_plain_one(spark):
    rows = odd_documents()
    want = manifest(rows)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    for page in (1, 4, 7, 4096):  # trees over many pages, in some, in one
        assert plain(M.merkle_manifest(crowded(frame(spark, rows)).repartition(5), altered(), page=page)) == want


def test_manifest_of_few_rows_and_many_sources(spark):
    assert M.merkle_manifest(frame(spark, []), altered()).count() == 0
    one = [(5, "a\nb", "en", None, 3)]
    assert plain(M.merkle_manifest(frame(spark, one), altered())) == manifest(one)
    many = [(k, f"text {k}\n", "en", f"s{k % 37}é" if k % 37 else f"s{k}", k) for k in range(300)]
    assert plain(M.merkle_manifest(frame(spark, many), altered(), page=5)) == manifest(many)


def test_manifest_climbs_in_rounds(spark):
    rows = [(k, "x\n" * (k % 3), "en", "one" if k % 10 else "two", k) for k in range(2400)]
    step, M.STEP = M.STEP, 2
    try:
        got = M.merkle_manifest(frame(spark, rows), altered(), page=3)
        assert plain(got) == manifest(rows)
    finally:
        M.STEP = step


def test_manifest_finds_a_changed_row(spark):
    rows = [(k, f"text {k}", "en", "s", 1) for k in range(50)]
    got = M.merkle_manifest(frame(spark, rows), F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {17}


def test_missing_nodes_are_the_fewest(spark):
    """Without any one of them a proof of some leaf can't be folded; none follows from the leaves."""
    rng = random.Random(3)
    for total in (1, 2, 3, 10, 28, 100):
        at = np.array(sorted(rng.sample(range(total), max(1, total // 5))))
        asked = {(level, k) for level, nodes in M.missing(at, total) for k in nodes.tolist()}
        needed, known = set(), {(0, k) for k in at.tolist()}
        for level, size in enumerate(M.sizes(total)[:-1]):
            for k in [k for l, k in known if l == level]:
                needed |= {(level, c) for c in range(k // 3 * 3, min(k // 3 * 3 + 3, size))}
                known.add((level + 1, k // 3))
        assert asked == needed - known


# Ranked search


def ranking(rows, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, word.findall(lower(t or ""))) for i, t, *_ in rows]
    N, L = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in docs:
            m = 10 + 90 * len(w) * N // max(L, 1)
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(word.findall(lower(text or ""))) if t in w)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def asked(rows):
    return [(0, rows[0][1]), (1, "w1 w2 W3, w3"), (2, None), (3, "nothing of it"), (4, "é ÉÀ ü 日本 same"), (None, "this very line"), (1, "again and again"), (7, " ".join(f"w{k}" for k in range(300)))]


def test_ranking_equals_a_plain_one(spark):
    rows = odd_documents()
    items = asked(rows)
    want = ranking(rows, items)
    assert len(want) > 30
    table = spark.createDataFrame(items, "item_id long, text string")
    for more in ({}, {"max_terms": 3}, {"bucket_terms": 200, "block_terms": 50}):  # all terms kept; many buckets and blocks
        assert plain(R.search(crowded(frame(spark, rows)).repartition(3), crowded(table), **more), "item_id") == want
    assert plain(R.search(frame(spark, rows), table, k=3)) == ranking(rows, items, 3)


def test_large_classes_and_ties(spark):
    """A third of the rows are copies, more differ in words that no item has: the smallest ids are found."""
    rng = random.Random(8)
    rows = [(k, "the red fox" if k % 3 == 0 else f"the blue hare x{rng.randrange(99)}" if k % 3 == 1 else words_text(rng, 9), "en", "s", 0) for k in rng.sample(range(5000), 1500)]
    items = [(1, "red fox"), (2, "blue hare the"), (3, "the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert plain(R.search(frame(spark, rows), table)) == ranking(rows, items)


def test_search_of_empty_tables(spark):
    rows = odd_documents()
    table = spark.createDataFrame(asked(rows), "item_id long, text string")
    assert R.search(frame(spark, []), table).count() == 0
    assert R.search(frame(spark, rows), table.limit(0)).count() == 0
    assert R.search(frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)]), table).count() == 0


def test_sums_beyond_doubles_are_exact(spark):
    rows = odd_documents()
    exact, R.EXACT = R.EXACT, 1
    try:
        table = spark.createDataFrame(asked(rows), "item_id long, text string")
        assert plain(R.search(frame(spark, rows), table)) == ranking(rows, asked(rows))
    finally:
        R.EXACT = exact


# Winnowing


def normal(text):
    """(characters, their places) without white space, A-Z lower-cased."""
    kept = [(k, c) for k, c in enumerate(text) if c not in " \t\n\x0b\x0c\r"]
    return [lower(c) for _, c in kept], [k for k, _ in kept]


def chosen(text, gram, window):
    """(gram, place) of what a plain loop over the windows chooses, by the hashes of the library."""
    chars, places = normal(text)
    gram = min(gram, len(chars))
    grams = ["".join(chars[k : k + gram]) for k in range(len(chars) - gram + 1)] if chars else []
    value = {g: int(W.fingerprint(g, gram, 1)[0][0]) for g in set(grams)}
    picked = set()
    for k in range(max(1, len(grams) - window + 1) if grams else 0):
        inside = range(k, min(k + window, len(grams)))
        picked.add(min(inside, key=lambda j: (value[grams[j]], -j)))
    return [(value[grams[j]], places[j]) for j in sorted(picked)]


def test_fingerprints_equal_a_plain_loop():
    rng = random.Random(2)
    texts = [t or "" for _, t, *_ in documents() if len(t or "") < 800]
    texts += ["".join(rng.choice("ab éA\n日🙂") for _ in range(rng.randrange(60))) for _ in range(150)]
    for gram, window in ((W.GRAM, W.WINDOW), (3, 4), (1, 1), (5, 2), (2, 7)):
        for text in texts:
            hashes, places = W.fingerprint(text, gram, window)
            assert list(zip(hashes.tolist(), places.tolist())) == chosen(text, gram, window)


def test_shared_pieces_are_found_where_they_are():
    """A piece of gram + window - 1 characters that two texts share is found in both, at one place of it."""
    rng = random.Random(5)
    for _ in range(60):
        piece = "".join(rng.choice("abcdefg日é") for _ in range(W.GRAM + W.WINDOW - 1))
        a, b = ("".join(rng.choice("hijk lm") for _ in range(rng.randrange(80))) for _ in range(2))
        one, two = a + piece + b, b + "".join(c.upper() if c.isascii() else c for c in piece) + "xyz" + a
        inside = [(p - len(a), q - len(b)) for p, q in W.shared_places(W.fingerprint(one), W.fingerprint(two))]
        assert any(p == q and 0 <= p < len(piece) for p, q in inside)


def compared(rows):
    def key(r):
        return (r[0] is not None, r[0] or 0)

    out = []
    ordered = sorted(rows, key=key, reverse=True)
    for k, r in enumerate(ordered):
        own, following = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(own) // 3
        new = own[: len(own) - cut] + following[:cut]
        prints = [W.fingerprint(t) for t in (own, new, following)]
        near = [len(x & y) / len(x | y) if x | y else 1.0 for x, y in ((set(prints[0][0].tolist()), set(p[0].tolist())) for p in prints[1:])]
        out.append((r[0], len(own), hashlib.sha256(new.encode()).hexdigest(), W.printed(*prints[0]), W.printed(*prints[1]), *near))
    return sorted(out, key=str)


def test_comparison_equals_a_plain_one(spark):
    rows = documents()
    want = compared(rows)
    for parts in (1, 3, 40):
        assert plain(W.compare_edits(crowded(frame(spark, rows)).repartition(4), parts=parts)) == want
    assert all(0 <= x <= 1 for r in want for x in r[-2:])
    by_text = {}
    for r in W.compare_edits(frame(spark, rows)).join(frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").collect():
        assert by_text.setdefault(r["t"], r["fingerprint"]) == r["fingerprint"]


def test_comparison_of_odd_rows(spark):
    assert W.compare_edits(frame(spark, [])).count() == 0
    one = [(4, "a text that stands alone in its table, of some length", "en", "s", 0)]
    assert plain(W.compare_edits(frame(spark, one))) == compared(one)
    same = [(None, "one text, many times", "en", "s", 0)] * 7 + [(2, "another one", "en", "s", 0), (2, "another one", "en", "s", 0), (3, None, "en", "s", 0)]
    for parts in (1, 5):
        assert plain(W.compare_edits(frame(spark, same), parts=parts)) == compared(same)
    # repeated ids with differing texts: each row is there once, its next one is another row
    rows = odd_documents()
    got = W.compare_edits(frame(spark, rows), parts=6).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"] is not None) == sorted((i, len(t or "")) for i, t, *_ in rows if i is not None)
    assert len(got) == len(rows)


def test_fingerprints_table(spark):
    rows = odd_documents()
    got = sorted((str(r["doc_id"]), len(r["hashes"]), tuple(r["places"])) for r in W.fingerprints(crowded(frame(spark, rows))).collect())
    assert got == sorted((str(i), len(W.fingerprint(t or "")[0]), tuple(W.fingerprint(t or "")[1].tolist())) for i, t, *_ in rows)


def test_sql_twins_on_odd_rows(spark, tmp_path):
    rows = odd_documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked(rows), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("op11_merkle_manifest", "op12_ranked_search"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
        assert plain(got) == sorted(want, key=str)
