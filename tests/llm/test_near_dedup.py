import random

import pytest

from loomtext.llm import near_dedup as N

from .helpers import WORD, crowded, documents, frame, lower, plain, words_text


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=str)


def test_equals_brute_force(spark):
    rows = documents()
    assert plain(N.near_duplicates(crowded(frame(spark, rows)))) == brute(rows)


@pytest.mark.parametrize("small, block", [(64, 256), (2, 5)])
def test_family_of_edited_copies(spark, monkeypatch, small, block):
    """Copies drift from their base, so many pairs of a bucket are no links; blocks must find all that are."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(8)
    base = words_text(rng, 120).split(" ")
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(999)}"
        rows.append((k, " ".join(w), "en", "s", 0))
    assert plain(N.near_duplicates(frame(spark, rows))) == brute(rows)


def test_empty_null_and_repeated(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0
    rows = [(5, "a b c d e f", "en", "s", 0), (5, "a b c d e f", "en", "s", 0), (2, "A B c d e f", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (9, None, "en", "s", 0), (10, "", "en", "s", 0)]
    got = plain(N.near_duplicates(frame(spark, rows)))
    assert got == sorted([(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 2, None, True), (9, 0, 9, True), (10, 0, 10, True)], key=str)


def test_one_id_with_two_texts_is_one_node(spark):
    rows = [(1, "a b c d e f g", "en", "s", 0), (4, "a b c d e f g", "en", "s", 0), (4, "p q r s t u v", "en", "s", 0), (6, "p q r s t u v", "en", "s", 0)]
    assert {r["component_id"] for r in N.near_duplicates(frame(spark, rows)).collect()} == {1}
