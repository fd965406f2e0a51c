"""Column functions over HTML and Markdown sources, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that are decoded, & last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&hellip;", "..."), ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "'"), ("&rsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&amp;", "&"))
# Tags that end a line.
BLOCK_TAGS = "p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|blockquote|pre"


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "(?s)<[^>]*>", "")), r"\s+", " "))


def html_to_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, rf"(?i)</?({BLOCK_TAGS})[^>]*>", "\n")
    c = decode_entities(F.regexp_replace(c, "(?s)<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def html_title(c: Column) -> Column:
    return strip_tags(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<html[^>]*\slang=\"([^\"]*)\"", 1)


def html_headings(c: Column) -> Column:
    return F.zip_with(_all(c, r"(?is)<h([1-6])[^>]*>.*?</h[1-6]>"), _all(c, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), lambda n, t: F.struct(n.cast("int").alias("level"), strip_tags(t).alias("text")))


def html_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(_all(c, r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), strip_tags), lambda p: p != "")


def html_list_items(c: Column) -> Column:
    return F.filter(F.transform(_all(c, r"(?is)<li[^>]*>(.*?)</li>"), strip_tags), lambda p: p != "")


def html_links(c: Column) -> Column:
    return F.zip_with(_all(c, r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>.*?</a>"), _all(c, r"(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>(.*?)</a>"), lambda h, t: F.struct(h.alias("href"), strip_tags(t).alias("text")))


def html_images(c: Column) -> Column:
    return _all(c, r"(?is)<img\s[^>]*src=\"([^\"]*)\"")


def html_tables(c: Column) -> Column:
    rows = lambda t: F.transform(_all(t, r"(?is)<tr[^>]*>(.*?)</tr>"), lambda r: F.transform(_all(r, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), strip_tags))
    return F.transform(_all(c, r"(?is)<table[^>]*>(.*?)</table>"), rows)


def html_code(c: Column) -> Column:
    return F.transform(_all(c, r"(?is)<(?:pre|code)[^>]*>(.*?)</(?:pre|code)>"), decode_entities)


def md_headings(c: Column) -> Column:
    return F.zip_with(_all(c, r"(?m)^(#{1,6})\s+.*$"), _all(c, r"(?m)^#{1,6}\s+(.*?)\s*#*\s*$"), lambda h, t: F.struct(F.length(h).alias("level"), t.alias("text")))


def md_list_items(c: Column) -> Column:
    return _all(c, r"(?m)^\s*(?:[-*+]|[0-9]+\.)\s+(.*)$")


def md_code(c: Column) -> Column:
    return F.zip_with(_all(c, r"(?s)```([a-zA-Z0-9]*)\n.*?```"), _all(c, r"(?s)```[a-zA-Z0-9]*\n(.*?)```"), lambda lang, body: F.struct(lang.alias("language"), body.alias("code")))


def md_links(c: Column) -> Column:
    return F.zip_with(_all(c, r"(?<!!)\[([^\]]+)\]\([^)\s]+\)"), _all(c, r"(?<!!)\[[^\]]+\]\(([^)\s]+)\)"), lambda t, u: F.struct(t.alias("text"), u.alias("url")))


def md_images(c: Column) -> Column:
    return _all(c, r"!\[[^\]]*\]\(([^)\s]+)\)")


def md_tables(c: Column) -> Column:
    return F.filter(_all(c, r"(?m)^\|(.*)\|\s*$"), lambda r: ~r.rlike(r"^[\s:|\-]+$"))


def front_matter(c: Column) -> Column:
    block = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---", 1)
    return F.map_from_entries(F.array_distinct(F.transform(F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))))


def md_to_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)^---\n.*?\n---\n?", "")
    c = F.regexp_replace(c, r"(?s)```.*?```", "")
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^\s*(#{1,6}|[-*+]|[0-9]+\.|>)\s+", "")
    return F.trim(F.regexp_replace(c, r"[*_`~]+", ""))
