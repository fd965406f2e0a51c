import random
import re
from collections import Counter

import numpy as np

from loomtext.llm import decontaminate as D
from loomtext.llm import quality_rules as Q

from .helpers import WORD, crowded, documents, frame, lower, words_text


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)


def test_alignment_scores():
    rng = random.Random(1)
    pairs = [([rng.randrange(3, 9) for _ in range(rng.randint(1, 12))], [rng.randrange(3, 9) for _ in range(rng.randint(1, 30))]) for _ in range(80)]
    got = D.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_are_found_and_clean_texts_left_alone(spark, monkeypatch):
    rng = random.Random(2)
    tests = [(k, words_text(rng, rng.randint(15, 40), 5000)) for k in range(12)]
    docs, expected = [], set()
    for k in range(80):
        text = words_text(rng, rng.randint(5, 80), 5000)
        if k % 3 == 0:
            i, passage = tests[k % 12]
            w = passage.split(" ")
            if k % 2:  # an edited copy: every eighth word changed, one left out, other case and marks
                w = [f"z{rng.randrange(9)}" if j % 8 == 5 else x.upper() + "," for j, x in enumerate(w) if j != 9]
            text = f"{text}\n{' '.join(w)} {words_text(rng, 4, 5000)}"
            expected.add((k, i))
        docs.append((k, text, "en", "s", 0))
    wanted = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(crowded(frame(spark, docs)), items(spark, tests)).collect()}
    assert wanted == expected
    monkeypatch.setattr(D, "BLOCK_GRAMS", 60)  # several blocks of items
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame(spark, docs), items(spark, tests)).collect()} == expected


def align_all(docs, tests, threshold=D.THRESHOLD):
    """Every item aligned with every whole document, without seeds: {(doc, item): score}."""
    split = lambda s: re.findall("[0-9a-z]+", lower(s))
    codes, out = {}, {}
    code = lambda w: codes.setdefault(w, len(codes) + 10)
    right = {i: np.array([code(w) for w in split(t)], np.uint64) for i, t in docs}
    left = {i: np.array([code(w) for w in split(t)], np.uint64) for i, t in tests}
    for i, words in left.items():
        scores = D.align([words] * len(right), list(right.values())) / (2 * len(words))
        out |= {(d, i): s for d, s in zip(right, scores) if s >= threshold}
    return out


def test_recall_against_aligning_everything(spark):
    """Copies with a growing share of words changed, put in or left out; seeds find at least 0.95 of what alignment scores."""
    rng = random.Random(21)
    tests = [(k, words_text(rng, rng.randint(15, 60), 3000)) for k in range(25)]
    docs = []
    for k in range(150):
        w = tests[k % 25][1].split(" ")
        for _ in range(int(len(w) * rng.uniform(0, 0.35))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [f"x{rng.randrange(99)}"], [w[at], f"y{rng.randrange(99)}"]])
            w = w or ["z"]
        docs.append((k, f"{words_text(rng, 30, 3000)} {' '.join(w)} {words_text(rng, 30, 3000)}"))
    want = align_all(docs, tests)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_leaks(frame(spark, [(i, t, "en", "s", 0) for i, t in docs]), items(spark, tests)).collect()}
    assert set(got) <= set(want) and len(want) > 100
    assert len(got) >= 0.95 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.95 * len(got)


def test_scripts_without_spaces_and_long_texts(spark):
    item = "春天来了，花园里的花都开了，孩子们在草地上玩耍。"
    thai = "สวัสดีครับวันนี้อากาศดีมาก"
    some = items(spark, [(1, item), (2, thai), (3, "alpha beta gamma delta epsilon zeta")])
    long = " ".join(f"w{k}" for k in range(60000))
    docs = [(1, f"他说：{item.replace('花园', '公园')}再见", "zh", "s", 0), (2, f"x {thai} y", "th", "s", 0), (3, "今天的会议讨论了预算问题", "zh", "s", 0), (4, f"{long} alpha beta gamma delta epsilon zeta {long}", "en", "s", 0)]
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame(spark, docs), some).collect()} == {(1, 1), (2, 2), (4, 3)}


def test_leaks_of_odd_rows(spark):
    some = items(spark, [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "too short"), (None, "alpha beta gamma delta"), (4, "")])
    docs = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "Alpha, beta gamma delta epsilon zeta eta theta!", "en", "s", 0), (7, "alpha beta gamma delta epsilon zeta eta theta " * 50, "en", "s", 0), (7, "nothing here", "en", "s", 0)]
    got = [(r["doc_id"], r["item_id"], r["score"]) for r in D.find_leaks(frame(spark, docs), some).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 1.0), (7, 1, 1.0), (None, None, 1.0), (7, None, 1.0)], key=str)
    assert D.find_leaks(frame(spark, []), some).count() == 0
    assert D.find_leaks(frame(spark, docs), items(spark, [])).count() == 0


def base_figures(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            cover |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def plain_clean(text):
    """The text without its failing lines, or None if the document goes; line by line, without arrays."""
    t = text or ""
    if base_figures(t)[-1]:
        return None
    kept, lost, total = [], 0, 0
    for line in t.split("\n"):
        w = WORD.findall(line)
        chars, bars, symbols = sum(map(len, w)), line.count("|"), len(re.findall("[#*$%&<>]", line))
        failed = bool(w) and (
            (bars >= 3 and bars >= 0.25 * len(w))
            or symbols >= max(1, 0.5 * len(w))
            or (len(w) > 2 and len(re.findall("[A-Z]", line)) > len(re.findall("[a-z]", line)))
            or (len(w) >= 10 and 3 * len(set(w)) < len(w))
            or (len(w) >= 8 and not re.search("[.!?。！？…।؟۔]", line))
            or (len(w) <= 30 and any(x in lower(line) for x in Q.BOILERPLATE))
        )
        total += chars
        lost += chars * failed
        if not failed:
            kept.append(line)
    return "\n".join(kept) if lost <= 0.5 * total else None


def test_cleaned_texts_equal_the_plain_version(spark):
    rng = random.Random(5)
    bits = ["Home | News | Shop | About", "All rights reserved", "Some prose stands here.", "one two three four five six seven eight nine", "SHOUTING ALL DAY", "w### x$$$", "same " * 12 + ".", "", "  ", "日本 語 。 a b c d e f g h i"]
    rows = [(k, "\n".join(rng.choice(bits) if rng.random() < 0.3 else " ".join(f"Word{rng.randrange(999)}" for _ in range(rng.randint(1, 20))) + rng.choice(".!, ") for _ in range(rng.randint(1, 12))), "en", "s", 0) for k in range(300)]
    rows += [(1000 + k, t, *rest) for k, (_, t, *rest) in enumerate(documents())]
    got = {r["doc_id"]: r["text"] for r in Q.clean(frame(spark, rows)).collect()}
    assert got == {i: c for i, t, *_ in rows if (c := plain_clean(t)) is not None}
    assert 50 < len(got) < 300


def test_base_figures(spark):
    rows = documents() + [(1000, "a | b\na | b\nx\n\n\n", "en", "s", 0), (1001, "#*$%&|<> " * 60, "en", "s", 0)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in Q.assess(crowded(frame(spark, rows))).collect()}
    assert got == {i: base_figures(t) for i, t, *_ in rows}
    assert all(not r["kept"] for r in Q.assess(frame(spark, rows)).collect() if r["base_failed"])


def test_lines_first(spark):
    prose = " ".join(f"Word{k} stands here." for k in range(40))
    noise = "Home | About | News | Shop | Help"
    rows = [
        (1, f"{noise}\n{prose}", "en", "s", 0),
        (2, "\n".join([noise] * 40) + "\nA short line.", "en", "s", 0),
        (3, "BUY NOW!! " * 60, "en", "s", 0),
        (4, " ".join(f"w{k}### x{k}***" for k in range(60)), "en", "s", 0),
        (5, prose, "en", "s", 0),
        (6, None, "en", "s", 0),
    ]
    got = {r["doc_id"]: r["text"] for r in Q.clean(frame(spark, rows)).collect()}
    assert got == {1: prose, 5: prose}
    kept = {r["doc_id"]: r["kept"] for r in Q.assess(frame(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert {r["doc_id"]: r["n_chars"] for r in Q.clean(frame(spark, rows)).collect()} == {1: len(prose), 5: len(prose)}
    assert Q.assess(frame(spark, [])).count() == 0 and Q.clean(frame(spark, [])).count() == 0
    assert Q.clean(crowded(frame(spark, rows))).columns == crowded(frame(spark, rows)).columns


def test_verdicts_do_not_depend_on_the_neighbours(spark):
    prose = " ".join(f"Word{k} stands here." for k in range(40))
    rows = [(k, f"{prose}\nNobody knows all rights" if k % 2 else f" reserved for later.\n{prose}", "en", "s", 0) for k in range(60)]
    rows += [(100 + k, t, *rest) for k, (_, t, *rest) in enumerate(documents())]
    got = []
    for n in (1, 2, 7):
        docs = frame(spark, rows).coalesce(1) if n == 1 else frame(spark, rows).repartition(n)
        got.append((sorted(map(tuple, Q.assess(docs).collect()), key=str), sorted(map(tuple, Q.clean(docs).collect()), key=str)))
    assert got[0] == got[1] == got[2]
    assert all(r[9] == 0 for r in got[0][0] if r[0] < 60)


def test_marks_of_other_scripts_and_talk_about_boilerplate(spark):
    zh = " ".join(["这 是 一 个 很 长 的 句 子 。"] * 3)
    long = "The privacy policy is under debate. " + " ".join(f"Word{k} stands near house{k}." for k in range(12))
    text = "\n".join([f"{zh} {k}" for k in range(6)] + [long, "Read our privacy policy here"])
    got = {r["doc_id"]: r["n_failed_lines"] for r in Q.assess(frame(spark, [(1, text, "zh", "s", 0)])).collect()}
    assert got == {1: 1}
