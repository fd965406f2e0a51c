import random
import re

from pyspark.sql import functions as F

from loomtext.llm import license_scan as L
from loomtext.llm import secret_scan as S

from .helpers import crowded, documents, frame, lower, plain, words_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(lower(text or ""))
    at = [(k, label) for phrase, label in L.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_labels_and_templates(spark):
    mit = L.TEMPLATES[1][1]
    changed = mit.split(" ")
    changed[7:7] = ["new", "word"]
    rows = documents() + [
        (1000, "Under the MIT\nLicense. The mit-license; General Public LICENSE, apache license", "en", "s", 0),
        (1001, f"Some words. {mit.upper()}! More.", "en", "s", 0),
        (1002, " ".join(changed), "en", "s", 0),
        (1003, mit[: len(mit) // 3], "en", "s", 0),
        (1004, "All rights reserved. " * 300, "en", "s", 0),
        (1005, "license mit général public licensé", "en", "s", 0),
        (None, "the apache license", "en", "s", 0),
    ]
    got = {r["doc_id"]: r for r in L.scan_licenses(crowded(frame(spark, rows))).collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: base(t) for i, t, *_ in rows}
    assert got[1001]["labels"] == "mit" and got[1001]["base_labels"] == "" and got[1001]["score"] == 1.0
    assert got[1002]["labels"] == "mit" and got[1003]["labels"] == "" and got[1003]["score"] == 0.0
    assert got[1004]["labels"] == "all-rights-reserved"
    assert got[None]["labels"] == "apache" and got[None]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got.values())
    assert L.scan_licenses(frame(spark, [])).count() == 0


def test_order_of_the_words_counts(spark):
    """Pieces of a template in another order, or one piece again and again, are no license; edits are."""
    bsd = next(t for label, t in L.TEMPLATES if label == "bsd-3-clause").split(" ")
    halves = bsd[len(bsd) // 2 :] + bsd[: len(bsd) // 2]
    edited = [w for k, w in enumerate(bsd) if k % 11 != 5]
    rows = [(1, " ".join(bsd), "en", "s", 0), (2, " ".join(halves), "en", "s", 0), (3, " ".join(bsd[:9] * 4), "en", "s", 0), (4, " ".join(edited), "en", "s", 0), (5, "x " * 30000 + " ".join(bsd), "en", "s", 0)]
    got = {r["doc_id"]: r["labels"] for r in L.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: "bsd-3-clause", 2: "", 3: "", 4: "bsd-3-clause", 5: "bsd-3-clause"}


def plain_labels(text):
    """Labels and best cover by a plain loop over templates, places and diagonals."""
    w = WORD.findall(lower(text or ""))
    labels, best = {label for phrase, label in L.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()}, 0.0
    for label, template in L.TEMPLATES:
        t = template.split(" ")
        votes = [(i, j) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3]]
        spans, last = [], None
        for i, j in sorted(votes, key=lambda v: v[0] - v[1]):
            if last is None or i - j - last > L.NEAR:
                spans.append([])
            spans[-1].append((i, j))
            last = i - j
        for span in spans:
            covered, end = 0, -3
            for _, j in sorted(span):
                if j > end:
                    covered, end = covered + min(j - end, 3), j
            places = [i for i, _ in span]
            if covered / len(t) >= L.LEAST_COVER and max(places) + 2 - min(places) + 1 <= L.LONGEST * len(t):
                labels.add(label)
                best = max(best, covered / len(t))
    return ",".join(sorted(labels)), best


def test_labels_of_null_and_repeated_ids(spark):
    """A row is labelled by its own text, whatever its id."""
    import duckdb
    import pandas as pd

    from loomtext.llm import queries as Q

    free = next(t for label, t in L.TEMPLATES if label == "unlicense")
    half = len(free.split(" ")) // 2
    first, second = " ".join(free.split(" ")[:half]), " ".join(free.split(" ")[half:])
    isc = next(t for label, t in L.TEMPLATES if label == "isc")
    texts = [free, f"so {free} ends", first, second, "clean words only", isc, isc, f"{isc}. {free}", "", None, " ".join([free] * 5)]
    rows = [(i, t, "en", "s", 0) for i in (None, 7) for t in texts] + [(8, first, "en", "s", 0), (8, second, "en", "s", 0), (9, isc, "en", "s", 0), (9, "clean", "en", "s", 0)]
    got = L.scan_licenses(crowded(frame(spark, rows)).repartition(4))
    assert plain(got.select("doc_id", "labels", "score")) == sorted(((i, *plain_labels(t)) for i, t, *_ in rows), key=str)
    documents_ = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM documents_")
    assert plain(got) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLE_SQL['op9_license_scan']})").fetchall(), key=str)


def secret_rows(n):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows, real = [], {}
    for k in range(n):
        kind = k % 4
        text = words_text(rng, 30)
        real[k] = kind == 0
        text += f' api token = "{key()}" end' if kind == 0 else f" card {rng.randrange(10**15, 10**16)} ok" if kind == 1 else f" mail someone-long-name-{k}000@host.example.com now" if kind == 2 else ""
        rows.append((k, text, "en", f"src{k % 5}", 0))
    return rows, real


def test_held_out_accuracy(spark):
    rows, real = secret_rows(400)
    found = S.vectors(S.candidates(frame(spark, rows)))
    found = found.withColumn("label", F.when(F.col("id") < 280, F.col("label")))  # the rest is held out
    forest = S.train_forest(found)
    scored = {r["id"]: r["prediction"] == 1 for r in forest.transform(found).filter("id >= 280").collect()}
    right = sum(scored.get(k, False) == real[k] for k in range(280, 400))
    assert right / 120 >= 0.95


def test_rare_secrets_train_the_forest(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'{words_text(rng, 9)} api token = "{key()}" end' if k % 100 == 0 else f"{words_text(rng, 9)} card {rng.randrange(10**15, 10**16)} ok", "en", "s", 0) for k in range(1600)]
    found = S.vectors(S.candidates(frame(spark, rows)))
    found = found.withColumn("label", F.when(F.col("id") < 1200, F.col("label")))  # the rest is held out: 4 secrets
    drawn = {r["label"]: r["count"] for r in S.draw_training(found.filter("label is not null"), 60).groupBy("label").count().collect()}
    assert drawn[1] == 12 and 20 <= drawn[0] <= 80
    scored = S.train_forest(found, 60).transform(found).filter("id >= 1200").collect()
    assert {r["id"] for r in scored if r["prediction"] == 1} == {1200, 1300, 1400, 1500}


def test_candidates_equal_a_plain_scan(spark):
    rng = random.Random(9)
    rows = documents() + [(2000 + k, "".join(rng.choice("abXY09+/_=-.,\n é") for _ in range(rng.randint(0, 400))), "en", "s", 0) for k in range(80)]

    def good(x):
        return len(x) >= S.MIN_LENGTH and (re.search("[0-9]", x) or len(re.findall("(?=[a-z][A-Z]|[A-Z][a-z])", x)) >= 2)

    expected = [(i, m.start(), len(m[0])) for i, t, *_ in rows for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t or "") if good(m[0])]
    got = [(r["id"], r["start"], r["length"]) for r in S.candidates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 40


def test_scores_do_not_depend_on_partitions(spark):
    rows, _ = secret_rows(60)
    rows += [(1000 + k, "aaaa" if k % 2 else "bbbb", "en", "s", 0) for k in range(40)]
    got = []
    for n in (1, 2, 7):
        found = S.candidates(frame(spark, rows).coalesce(1) if n == 1 else frame(spark, rows).repartition(n)).collect()
        got.append(sorted((r["id"], r["start"], r["transition"], r["covered"], r["label"]) for r in found))
    assert got[0] == got[1] == got[2]


def test_secrets_without_a_credential_word(spark):
    rows, real = secret_rows(200)
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows += [(1000 + k, f"{words_text(rng, 20)} seen {key()} there", "en", "src1", 0) for k in range(20)]
    got = {r["doc_id"]: (r["label"], r["is_secret"]) for r in S.scan_secrets(frame(spark, rows)).collect()}
    assert sum(got[1000 + k][1] for k in range(20)) >= 19 and all(got[1000 + k][0] is None for k in range(20))


def test_candidates_and_verdicts(spark):
    rows, real = secret_rows(80)
    got = S.scan_secrets(crowded(frame(spark, rows))).collect()
    assert {r["doc_id"] for r in got if r["is_secret"]} == {k for k, x in real.items() if x}
    by_id = {k: t for k, t, *_ in rows}
    for r in got:
        import hashlib

        assert hashlib.sha256(by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]].encode()).hexdigest() == r["sha256"]


def test_odd_rows(spark):
    assert S.scan_secrets(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, 'é token = "0123456789abcdef0123"', "en", None, 0), (4, "0123456789abcdef" * 5000, "en", "s", 0), (4, "0123456789abcdef" * 5000, "en", "s", 0)]
    got = sorted(((r["doc_id"], r["start"], r["length"], r["label"]) for r in S.scan_secrets(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 11, 20, 1), (4, 0, 80000, None), (4, 0, 80000, None)], key=str)


def test_given_labels_are_used(spark):
    rows, real = secret_rows(40)
    docs = frame(spark, rows)
    starts = {r["doc_id"]: r["start"] for r in S.scan_secrets(docs).collect()}
    flipped = spark.createDataFrame([(k, s, 1) for k, s in starts.items()], "doc_id long, start long, label int")
    got = S.scan_secrets(docs, labels=flipped).collect()
    assert all(r["label"] == 1 and r["score"] == 1.0 for r in got)
