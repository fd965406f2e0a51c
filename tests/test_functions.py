"""Column functions against literal values."""

import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions import markup as M
from loomtext.functions import text as T
from loomtext.functions import vectors as V


def one(spark, column, schema="text string", *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def text(spark, column, value):
    return one(spark, column(F.col("text")), "text string", value)



@pytest.mark.parametrize(
    "a, b, metric, expected",
    [
        ([1.0, 0.0], [1.0, 0.0], V.cosine, 1.0),
        ([1.0, 0.0], [0.0, 1.0], V.cosine, 0.0),
        ([1.0, 2.0, 3.0], [-1.0, -2.0, -3.0], V.cosine, -1.0),
        ([0.0, 0.0], [3.0, 4.0], V.l2, 5.0),
        ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], V.dot, 32.0),
        ([0.0, 0.0], [1.0, 1.0], V.cosine, 0.0),
        ([1.0], [1.0, 2.0], V.cosine, None),
    ],
)
def test_similarities(spark, a, b, metric, expected):
    got = one(spark, metric(F.col("a"), F.col("b")), "a array<float>, b array<float>", a, b)
    assert got == expected if expected is None else math.isclose(got, expected, abs_tol=1e-9)


def test_vector_stats(spark):
    s = one(spark, V.vector_stats(F.col("a")), "a array<float>", [1.0, 2.0, 3.0, 4.0, 5.0])
    assert (s["dims"], s["mean"], s["min"], s["max"]) == (5, 3.0, 1.0, 5.0)
    assert math.isclose(s["stddev"], math.sqrt(2))


def test_normalize_prune_quantize_valid(spark):
    a = F.col("a")
    assert one(spark, V.normalize(a), "a array<double>", [3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.normalize(a), "a array<double>", [0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.prune_weights(a, 0.5), "a array<double>", [0.4, -0.6]) == [0.0, -0.6]
    assert one(spark, V.quantize(a, 2), "a array<double>", [0.3, -0.3]) == [0.25, -0.25]
    assert not one(spark, V.valid(a, 2), "a array<double>", [float("nan"), 0.0])
    assert not one(spark, V.valid(a, 2), "a array<double>", [float("inf"), 0.0])
    assert one(spark, V.valid(a, 2), "a array<double>", [1.0, 0.0])


@pytest.mark.parametrize("value, least", [("", 0), ("hello", 1), ("hello world", 2), ("Hello, world!", 3)])
def test_token_counts(spark, value, least):
    for kind in ("word", "simple", "regex", "long_words", "pieces"):
        assert text(spark, lambda c: T.count_tokens(c, kind), value) >= (least if kind != "word" else min(least, 2))


def test_words_and_sentiment(spark):
    assert text(spark, lambda c: T.clean_words(c), "Hello, (world)! it's") == ["hello", "world", "its"]
    assert text(spark, lambda c: T.content_words(c), "The quick 'fox' and it.") == ["quick", "fox"]
    s = text(spark, lambda c: T.sentiment(c), "good good bad day")
    assert (round(s["polarity"], 6), s["emotion"], s["confidence"]) == (round(1 / 3, 6), "positive", 0.75)
    assert text(spark, lambda c: T.sentiment(c), "")["emotion"] == "neutral"
    assert text(spark, lambda c: T.themes(c), "Market data") == ["business", "technical"]


def test_quality_and_complexity(spark):
    assert text(spark, lambda c: T.quality(c), "short") == pytest.approx((0.2 + 0.5) / 2)
    assert text(spark, lambda c: T.complexity(c), "") == 0.0
    assert text(spark, lambda c: T.complexity(c), "one two three four.") == pytest.approx(0.2)
    assert text(spark, lambda c: T.flesch(c), "") == 0.0
    assert 0 <= text(spark, lambda c: T.flesch(c), "The cat sat on the mat.") <= 100
    assert text(spark, lambda c: T.syllables(c), "make") == 1


def test_topic_boundary_and_memory_rules(spark):
    both = lambda a, b: one(spark, T.is_topic_boundary(F.col("a"), F.col("b")), "a string, b string", a, b)
    assert both("We like cats.", "However, dogs bark.")
    assert both("Is it?", "It is.")
    assert not both("Cats like fresh milk daily.", "Cats like fresh milk daily.")
    assert text(spark, lambda c: T.extract_memory(c), "I prefer tea in the morning")["category"] == "preference"
    assert text(spark, lambda c: T.extract_memory(c), "zzz") is None


def test_json_extraction(spark):
    assert text(spark, lambda c: T.extract_json(c, "a int"), 'so {"a": 3} it is')["a"] == 3


def test_html(spark):
    page = '<html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><h2>Top</h2><p>One <b>two</b></p><p></p><ul><li>x</li></ul><a href="/u">go</a><img src="i.png"><table><tr><td>1</td><td>2</td></tr></table></body></html>'
    assert text(spark, lambda c: M.html_title(c), page) == "A & B"
    assert text(spark, lambda c: M.html_lang(c), page) == "en"
    assert [tuple(h) for h in text(spark, lambda c: M.html_headings(c), page)] == [(2, "Top")]
    assert text(spark, lambda c: M.html_paragraphs(c), page) == ["One two"]
    assert [tuple(x) for x in text(spark, lambda c: M.html_links(c), page)] == [("/u", "go")]
    assert text(spark, lambda c: M.html_images(c), page) == ["i.png"]
    assert text(spark, lambda c: M.html_tables(c), page) == [[["1", "2"]]]
    assert "p{}" not in text(spark, lambda c: M.html_to_text(c), page)


def test_markdown(spark):
    doc = "---\ntitle: X\n---\n# Head\n- item\n[t](http://u) ![i](p.png)\n```py\nx=1\n```\n| a | b |\n|---|---|\n"
    assert [tuple(h) for h in text(spark, lambda c: M.md_headings(c), doc)] == [(1, "Head")]
    assert text(spark, lambda c: M.md_list_items(c), doc) == ["item"]
    assert [tuple(x) for x in text(spark, lambda c: M.md_links(c), doc)] == [("t", "http://u")]
    assert text(spark, lambda c: M.md_images(c), doc) == ["p.png"]
    assert [tuple(x) for x in text(spark, lambda c: M.md_code(c), doc)] == [("py", "x=1\n")]
    assert text(spark, lambda c: M.front_matter(c), doc) == {"title": "X"}
    assert text(spark, lambda c: M.md_tables(c), doc) == [" a | b "]
    assert "```" not in text(spark, lambda c: M.md_to_text(c), doc)
