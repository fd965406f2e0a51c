import io
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import mixing as X
from loomtext.llm import token_files as B
from loomtext.llm import url_filter as U
from loomtext.llm.queries import word_tokenizer

from .helpers import crowded, documents, frame


# --- mixing ---------------------------------------------------------------


def ideal_times(blocks, weights):
    """{source: [time at which the ideal mix has done j blocks]}, by following the mix from one end of a source to the next."""
    left, done, now = {s: Fraction(n) for s, n in blocks.items()}, dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    times = {s: [Fraction(0)] for s in blocks}
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        rate = {s: Fraction(weights[s]) / total for s in left}
        step = min(left[s] / rate[s] for s in left)
        for s in list(left):
            while len(times[s]) <= done[s] + rate[s] * step:
                times[s].append(now + (len(times[s]) - done[s]) / rate[s])
            done[s] += rate[s] * step
            left[s] -= rate[s] * step
            if not left[s]:
                del left[s]
        now += step
    return times


def plain_schedule(blocks, weights):
    """Earliest deadline first, looking at all sources for every slot."""
    times, nxt, out = ideal_times(blocks, weights), dict.fromkeys(blocks, 0), []
    for slot in range(sum(blocks.values())):
        ready = [(math.ceil(times[s][j + 1]), s) for s, j in nxt.items() if j < blocks[s] and math.floor(times[s][j]) <= slot]
        _, s = min(ready)
        out.append((s, nxt[s], slot))
        nxt[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {f"s{k}": (k + 1) ** 2 for k in range(12)}, {"a": 1000, "b": 0.001}])
def test_schedule_equals_the_plain_loop(weights):
    rng = random.Random(3)
    blocks = {s: rng.randint(1, 40) for s in weights}
    assert list(X.schedule(blocks, weights)) == plain_schedule(blocks, weights)
    assert list(X.schedule({}, {})) == []


def test_mixed_table_equals_the_plain_loop(spark):
    """Every block of the table stands in the slot of the plain loop, with the default weights and given ones."""
    rng = random.Random(8)
    sizes = {"hot": 900, "": 33, **{f"s{k}": rng.randint(1, 120) for k in range(9)}}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, "t", "en", s or None, 0))
            k += 1
    rng.shuffle(rows)
    blocks = {s: -(-n // 10) for s, n in sizes.items()}
    for given in (None, {s: 1.0 + len(s) for s in sizes}):
        got = X.mix_sources(frame(spark, rows), given, block_rows=10).collect()
        wanted = {(s, j): slot for s, j, slot in plain_schedule(blocks, given or {s: n**0.5 for s, n in sizes.items()})}
        held = {}
        for r in got:
            held.setdefault((r["source"] or "", r["block"]), []).append(r["place"])
            assert r["slot"] == wanted[r["source"] or "", r["block"]]
        assert set(held) == set(wanted)
        assert all(sorted(p) == list(range(len(p))) for p in held.values()) and sum(map(len, held.values())) == len(rows)


def test_mix_keeps_all_rows_and_targets(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_ROWS", 50)
    rows = [(k, "t", "en", "big" if k % 10 else "small", 0) for k in range(2000)] + [(9000 + k, None, None, None, None) for k in range(5)] + [(1, "t", "en", "big", 0)]
    got = sorted(X.mix_sources(crowded(frame(spark, rows)), {"big": 0.5, "small": 0.5}, block_rows=10).collect(), key=lambda r: (r["slot"], r["place"]))
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    head = [r["source"] for r in got[:390]]
    for k in range(1, 390):
        assert abs(head[:k].count("small") - k / 2) <= 10
    assert all(r["source"] is None for r in got[-5:])
    assert X.mix_sources(frame(spark, [])).count() == 0


def ideal(blocks, weights, slots):
    """Blocks of each source that the ideal mix has done after each slot, with fractions."""
    left, done, out = {s: Fraction(n) for s, n in blocks.items()}, dict.fromkeys(blocks, Fraction(0)), []
    for _ in range(slots):
        room = Fraction(1)
        while room and any(left.values()):
            total = sum(Fraction(weights[s]) for s in left if left[s])
            step = min([room, *(left[s] * total / Fraction(weights[s]) for s in left if left[s])])
            for s in left:
                if left[s]:
                    part = step * Fraction(weights[s]) / total
                    left[s], done[s] = left[s] - part, done[s] + part
            room -= step
        out.append(dict(done))
    return out


@pytest.mark.parametrize(
    "blocks, weights",
    [
        ({"hot": 300, **{f"s{k}": 16 for k in range(19)}}, {"hot": 0.5, **{f"s{k}": 0.5 / 19 for k in range(19)}}),
        ({"a": 5, "b": 60, "c": 1, "d": 33}, {"a": 0.7, "b": 0.1, "c": 0.15, "d": 0.05}),
        ({f"s{k}": k * k + 1 for k in range(9)}, {f"s{k}": (k * k + 1) ** 0.5 for k in range(9)}),
    ],
)
def test_less_than_one_block_from_the_given_weights(blocks, weights):
    n = sum(blocks.values())
    given = dict.fromkeys(blocks, 0)
    for t, ((s, j, slot), wanted) in enumerate(zip(X.schedule(blocks, weights), ideal(blocks, weights, n), strict=True)):
        assert slot == t and j == given[s]
        given[s] += 1
        assert all(abs(given[x] - wanted[x]) < 1 for x in blocks)
    assert given == blocks


def test_a_hot_source_among_a_thousand_keeps_its_target():
    blocks, weights = {"hot": 3000, **{f"s{k}": 4 for k in range(999)}}, {"hot": 0.5, **{f"s{k}": 0.5 / 999 for k in range(999)}}
    hot = 0
    for t, (s, _, _) in enumerate(itertools.islice(X.schedule(blocks, weights), 5000)):
        hot += s == "hot"
        assert abs(hot - (t + 1) / 2) < 1 + 1e-6


def test_more_sources_than_the_driver_took(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    assert sorted(r["slot"] for r in X.mix_sources(docs).collect()) == list(range(6000))


# --- urls -----------------------------------------------------------------


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    cut = min(ends) if ends else len(rest)
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def fixed_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/2?x=1", "http://a.example.com/fr/#q", "https://x.net/es/9", "https://x.net/fr?u=/es/", "http://net/es/", "http://notcom/", "a://b.net/es/://c.com/", "http://x.com?y#z", "http://é.com/ü", "http://x.com/\nline", "http://" + "a." * 500 + "com/" + "p/" * 2000]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] * 2
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split_url(URLS[r["page_id"]])
        rule, verdict = fixed_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        assert host or r["verdict"] == "allow"
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_association_rules_judge_other_urls(spark):
    known = [(f"http://shop.spam{k}.org/buy/{k}", "block") for k in range(30)] + [(f"http://news.site{k}.org/read/{k}", "allow") for k in range(30)]
    pages = [(1, "http://shop.other.org/buy/7"), (2, "http://news.other.org/read/9"), (3, "http://plain.org/x")]
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labelled=spark.createDataFrame(known, "url string, label string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_rules_of_three_tokens_decide(spark):
    # "buy" pages of shops are blocked only with the query key "ref"; any two of the three tokens are mixed
    known = []
    for host, path, query in itertools.product(("shop", "news"), ("buy", "read"), ("ref", "page")):
        label = "block" if (host, path, query) == ("shop", "buy", "ref") else "allow"
        known += [(f"http://{host}.x{chr(97 + k)}.org/{path}?{query}=1", label) for k in range(12)]
    frame_ = spark.createDataFrame(known, "url string, label string")
    tokens = [({f"h:{u[7:11]}", f"h:{u[12:14]}", "h:org", f"d:{u[12:14]}.org", f"p:{u.split('/')[3].split('?')[0]}", f"q:{u.split('?')[1][:-2]}"}, label) for u, label in known]
    sets = {frozenset(c) for t, _ in tokens for n in range(1, 7) for c in itertools.combinations(sorted(t), n)}

    def confidence(rule, label):
        fits = [x for t, x in tokens if rule <= t]
        n = fits.count(label)
        return n / len(fits) if n >= U.MIN_SUPPORT * len(tokens) and n / len(fits) >= U.MIN_CONFIDENCE else 0.0

    pages = [f"http://{h}.other.org/{p}?{q}=7" for h in ("shop", "news", "blog") for p in ("buy", "read", "x") for q in ("ref", "page")]

    def verdict(url):
        t = {f"h:{url[7:11]}", "h:other", "h:org", "d:other.org", f"p:{url.split('/')[3].split('?')[0]}", f"q:{url.split('?')[1][:-2]}"}
        best = {x: max((confidence(s, x) for s in sets if s <= t), default=0.0) for x in ("block", "allow")}
        return "block" if best["block"] > best["allow"] else "allow"

    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), labelled=frame_).collect()}
    assert got == {k: verdict(u) for k, u in enumerate(pages)}
    assert got[pages.index("http://shop.other.org/buy?ref=7")] == "block"
    rules = U.mine_rules(spark.createDataFrame([(sorted(t), x) for t, x in tokens], "tokens array<string>, label string")).collect()
    assert {frozenset(r["antecedent"]) for r in rules if r["label"] == "block"} == {frozenset(("h:shop", "p:buy", "q:ref"))}


# --- token files ----------------------------------------------------------


def test_file_round_trip_and_single_documents():
    rng = np.random.default_rng(3)
    docs = [(k * 2, rng.integers(0, 49000, rng.integers(1, 3000)).astype(np.uint32)) for k in range(300)]
    out = io.BytesIO()
    writer = B.Writer(out, 2)
    for i, t in docs:
        writer.add(i, t)
    writer.close()
    data = out.getvalue()
    reader = B.Reader(io.BytesIO(data), len(data))
    assert len(reader) > 3
    got = [(int(i), x.tolist()) for k in range(len(reader)) for ids, counts, tokens, _ in [reader.frame(k)] for i, x in zip(ids, np.split(tokens, np.cumsum(counts)[:-1]))]
    assert got == [(i, t.tolist()) for i, t in docs]

    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            part = super().read(n)
            Counting.read_bytes += len(part)
            return part

    one = B.Reader(Counting(data), len(data))
    found = dict(one.documents([docs[150][0], 7, 10**9]))
    assert list(found) == [docs[150][0]] and found[docs[150][0]].tolist() == docs[150][1].tolist()
    assert Counting.read_bytes < len(data) / 2

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(whole) > 2 * sum(len(t) for _, t in docs)


def test_damage_is_noticed():
    out = io.BytesIO()
    writer = B.Writer(out, 4)
    writer.add(1, np.arange(1000, dtype=np.uint32))
    writer.close()
    data = bytearray(out.getvalue())
    data[-11] ^= 1  # the index frame's checksum in the seek table
    with pytest.raises(Exception):
        B.Reader(io.BytesIO(bytes(data)), len(data)).frame(0)


def test_tokens_of_the_table(spark):
    model = Tokenizer.from_file(word_tokenizer())
    rows = documents() + [(5000, "a<|endoftext|>b it's DON'T Σας ﬁ e\u0301 \u00a0x\u2028y", "en", "s", 0)]
    rows.append((1000, "It's 2 pm <|startoftext|> 日本語 \x00 ok", "en", "s", 0))
    expected, start = [], 0
    for i, t, *_ in sorted(rows):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in B.token_table(crowded(frame(spark, rows)), word_tokenizer()).orderBy("doc_id").collect()]
    assert got == expected


def test_token_cache_may_start_again(spark, monkeypatch):
    import pyarrow as pa

    from loomtext.llm import kernel as K

    monkeypatch.setattr(B, "CACHE_WORDS", 50)
    model, words = Tokenizer.from_file(word_tokenizer()), B.WordTokens(word_tokenizer())
    rng = random.Random(1)
    for _ in range(5):
        texts = [" ".join(f"word{rng.randrange(200)}" for _ in range(30)) for _ in range(4)]
        for docs in K.slices(pa.array(texts)):
            ids, counts = words.encode(docs)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_have_the_ids_of_the_text():
    import pyarrow as pa

    from loomtext.llm import kernel as K

    model, words = Tokenizer.from_file(word_tokenizer()), B.WordTokens(word_tokenizer())
    rng = random.Random(5)
    letters = "ab AB\t\n'19<|>.,!éÉßÀ×÷ÿÞç–…’日本\u0301Σς_-/\x01\x7f\u017f\u212a\u0130\u0131'st"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|>b", "it'S we'LL 'd"]
    for docs in K.slices(pa.array(texts), 4000):
        ids, counts = words.encode(docs)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [model.encode(texts[docs.first + i], add_special_tokens=False).ids for i in range(docs.n)]


def test_files_are_read_back_by_a_task_each(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so little data makes one file
    try:
        manifest = B.write_tokens(docs, f"file://{tmp_path}", word_tokenizer(), ["doc_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    back = B.read_tokens(manifest)
    per_task = [n for n in back.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) == manifest.count() > 1 and sum(per_task) == 4000


def test_odd_rows_as_tokens(spark):
    assert B.token_table(frame(spark, []), word_tokenizer()).count() == 0
    rows = [(None, "a", "en", "s", 0), (3, None, "en", "s", 0), (3, "b", "en", "s", 0), (1, "", "en", "s", 0)]
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in B.token_table(frame(spark, rows), word_tokenizer()).orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 1), (3, 3, 1), (3, 4, 2)]


def test_ids_wider_than_two_bytes(spark, tmp_path):
    """The width follows the tokenizer and the end id; an id that doesn't fit is an error, never another id."""
    rows = [(1, "some words here", "en", "s", 0), (2, None, "en", "s", 0)]
    path = word_tokenizer()
    assert B.id_width(path, 1) == 2 and B.id_width(path, 70_000) == 4
    manifest = B.write_tokens(frame(spark, rows), f"file://{tmp_path}/wide", path, ["doc_id"], end_id=70_000)
    ids = Tokenizer.from_file(path).encode("some words here", add_special_tokens=False).ids
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in B.read_tokens(manifest).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((1, [*ids, 70_000]), (2, [70_000]))}
    with pytest.raises(Exception, match="needs more than 2 bytes"):
        B.write_tokens(frame(spark, rows), f"file://{tmp_path}/narrow", path, ["doc_id"], end_id=70_000, width=2)


def test_mixing_of_null_and_repeated_ids(spark, monkeypatch):
    """Each row has a place of its own, no bucket holds most rows, and the order keeps to the weights."""
    monkeypatch.setattr(X, "BUCKET_ROWS", 200)
    rows = [(None if k % 5 else 7 if k % 2 else k, f"t{k}", "en", "big" if k % 3 else None, 0) for k in range(6000)]
    got = X.mix_sources(frame(spark, rows), {"big": 0.5, "": 0.5}, block_rows=10)
    places = got.collect()
    assert len({(r["source"], r["block"], r["place"]) for r in places}) == 6000
    ordered = sorted(places, key=lambda r: (r["slot"], r["place"]))
    big = 0
    for n, r in enumerate(ordered[:3900]):  # both sources last as long
        big += r["source"] == "big"
        assert abs(big - 0.5 * (n + 1)) <= 10
    drawn = X.Scratch(spark, "x").keep(frame(spark, rows).select(F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("d")))
    assert max(r["count"] for r in drawn.groupBy(F.pmod("d", F.lit(20))).count().collect()) < 2 * 300


def judged(known, sets, support, confidence):
    """Verdicts by all frequent sets of tokens, without any rule left out."""
    counts = {}
    for tokens, label in known:
        for n in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), n):
                counts.setdefault(x, []).append(label)
    least = math.ceil(support * len(known) - 1e-9)
    out = []
    for tokens in sets:
        best = {"block": 0.0, "allow": 0.0}
        for n in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), n):
                for label in best:
                    m = counts.get(x, []).count(label)
                    if m >= least and m / len(counts[x]) >= confidence:
                        best[label] = max(best[label], m / len(counts[x]))
        out.append("block" if best["block"] > best["allow"] else "allow")
    return out


def segments(rng, k, share):
    return [f"s{i}" for i in range(k) if rng.random() < share]


@pytest.mark.parametrize("mixed", [False, True])
def test_near_equal_tokens_give_the_verdicts_of_all_sets(spark, mixed):
    rng = random.Random(15)
    letter = "abcdefghij"
    urls = []
    for k in range(260):
        if k % 2:  # ten segments that nearly always stand together
            label = "block" if not mixed or rng.random() < 0.85 else "allow"
            urls.append(("http://h.test/" + "/".join(letter[int(s[1:])] * 3 for s in segments(rng, 7, 0.95)), label))
        else:
            urls.append((f"http://o.test/{rng.choice('xyz')}/{rng.choice('uv')}", rng.choice(["allow", "allow", "block"])))
    labelled = spark.createDataFrame(urls, "url string, label string")
    asked = [(k, f"http://q.test/{'/'.join(rng.sample([c * 3 for c in letter[:7]] + list('xyzuv'), rng.randint(0, 4)))}") for k in range(60)]
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(spark.createDataFrame(asked, "page_id long, url string"), rules=(), labelled=labelled).collect()}

    def tokens(url):
        host, _, path = url.split("://")[1].partition("/")
        return {"h:" + x for x in host.split(".")} | {"d:" + host} | {"p:" + x for x in path.split("/") if x}

    want = judged([(tokens(u), x) for u, x in urls], [tokens(u) for _, u in asked], U.MIN_SUPPORT, U.MIN_CONFIDENCE)
    assert [got[k] for k in range(60)] == want and set(want) == {"allow", "block"}


def test_many_near_equal_tokens_of_one_label(spark):
    """25 segments, each missing from 1 % of the urls that hold them: 2**25 frequent sets, 25 rules."""
    import time

    rng = random.Random(16)
    urls = [("http://h.test/" + "/".join(f"{chr(97 + int(s[1:]))}seg" for s in segments(rng, 25, 0.99)), "block") for _ in range(400)]
    urls += [(f"http://o.test/{rng.choice('xyz')}", "allow") for _ in range(400)]
    began = time.time()
    asked = spark.createDataFrame([(1, "http://n.test/cseg/other"), (2, "http://n.test/x"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(asked, rules=(), labelled=spark.createDataFrame(urls, "url string, label string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"} and time.time() - began < 60
