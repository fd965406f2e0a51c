"""Operators on the structure of documents: blocks, sections, hierarchies, boundaries, contexts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions import vectors as V
from loomtext.plans.shared import Scratch

from . import chunk as K
from .packing import packed_sections, recursive_pieces

#: Fenced code, table rows, images and html blocks.
BLOCK_PATTERN = r"(?s)```.*?(?:```|$)|(?m:^\|[^\n]*\|[ \t]*$)(?:\n(?m:^\|[^\n]*\|[ \t]*$))*|!\[[^\]]*\]\([^)]*\)|<(?:div|table|section)\b.*?</(?:div|table|section)>"
#: A document's titles are handed to its nodes in a row up to so many.
MOST_TITLES = 64
# Separators of the recursive chunker, from coarse to fine.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def content_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, text): fenced code, tables, images, html blocks and the text between."""
    pattern = BLOCK_PATTERN
    marked = docs.select("doc_id", F.split(F.regexp_replace("text", rf"({pattern})", "\x1e$1\x1e"), "\x1e").alias("parts"))
    each = marked.select("doc_id", F.posexplode_outer("parts").alias("k", "text")).filter(F.trim("text") != "")
    kind = F.when(F.col("text").startswith("```"), "code").when(F.col("text").startswith("|"), "table").when(F.col("text").startswith("!["), "image").when(F.col("text").rlike("^<(table|div|section)"), "html").otherwise("text")
    return each.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).alias("block_no"), kind.alias("kind"), F.trim("text").alias("text"))


def begins_section(line: Column, language: Column) -> Column:
    """Whether a line of code begins a function, class or other block, by the language that its fence names."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    holds = lambda *found: functools.reduce(lambda x, y: x | y, [F.contains(t, F.lit(x)) for x in found])
    starts = lambda *found: functools.reduce(lambda x, y: x | y, [t.startswith(x) for x in found])
    # What begins a section in each language.
    return (
        F.when(language == "python", starts("def ", "class "))
        .when(language.isin("javascript", "js"), holds("function ") | holds("const ", "let ", "var ") & holds("=>"))
        .when(language == "go", starts("func ", "type "))
        .when(language == "java", holds("public ", "private ", "protected ") & holds("class ", "interface ", "void ", "int ", "String "))
        .otherwise(t.endswith("{") | holds("//") & holds("Function", "Method"))
    )


def chunk_multimodal(docs: DataFrame, size: int = 512) -> DataFrame:
    """Blocks packed by kind: text by sentences, code by functions, tables by lines.

    Code is cut where a function, class or block begins, and by lines within one
    that is too large.  Of text, two neighbouring chunks of under half the size
    become one if they fit.  Chunks of a table after its first begin with its header.
    """
    blocks = content_blocks(docs)
    lines = F.split("text", "\n")
    units = F.when(F.col("kind") == "text", K.split_sentences(F.col("text"))).otherwise(lines)
    language = F.lower(F.regexp_extract("text", r"^```[ \t]*([A-Za-z0-9_+#-]*)", 1))
    u = blocks.select(F.struct("doc_id", "block_no", "kind").alias("doc_id"), units.alias("units"), language.alias("language"))
    begins = F.transform("units", lambda x, i: F.when((i > 0) & begins_section(x, F.col("language")), i))
    cuts = F.when(F.col("doc_id.kind") == "code", F.array_compact(begins)).otherwise(F.array().cast("array<int>"))
    keyed = u.select("doc_id", "units", F.transform("units", lambda s: T.count_tokens(s, "word").cast("int")).alias("sizes"), cuts.alias("cuts"))
    is_text = F.col("doc_id.kind") == "text"
    cut = packed_sections(keyed.filter(is_text), "\n", K.Rule(size, merge_below=size / 2)).unionByName(packed_sections(keyed.filter(~is_text), "\n", K.Rule(size)))
    # a table's first line, and its second if that is the rule below the header
    head = blocks.filter("kind = 'table'").select("doc_id", "block_no", F.regexp_extract("text", r"^([^\n]*(?:\n[ \t]*\|[ \t:|-]+(?=\n|$))?)", 1).alias("head"))
    out = cut.select("doc_id.doc_id", "doc_id.block_no", "doc_id.kind", "chunk_no", "text", "tokens").join(head, ["doc_id", "block_no"], "left")
    repeats = F.col("head").isNotNull() & (F.col("chunk_no") > 1)
    tokens = F.col("tokens") + F.when(repeats, T.count_tokens(F.col("head"), "word").cast("int")).otherwise(0)
    return out.select("doc_id", "block_no", "kind", "chunk_no", F.when(repeats, F.concat("head", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"), tokens.cast("int").alias("tokens"))


def neighbour_types(blocks: DataFrame) -> DataFrame:
    order, whole = Window.partitionBy("doc_id").orderBy("block_no"), Window.partitionBy("doc_id")
    return blocks.select("doc_id", "block_no", F.count("*").over(whole).alias("total"), F.lag("kind").over(order).alias("preceded_by"), F.lead("kind").over(order).alias("followed_by"))


def chunk_recursive(docs: DataFrame, size: int = 512, combine: bool = False) -> DataFrame:
    """(doc_id, piece_no, text, tokens): pieces over the size are split at ever finer separators, which stay with the text before.

    combine: the whole method. Parts of a level are put together while they fit the size, and what no
    separator cuts is cut between characters, so no piece is over the size (packing).  Without it the
    parts stay as the separators leave them.  No shuffle either way.
    """
    if combine:
        return recursive_pieces(docs.filter("text <> ''"), size, SEPARATORS)
    # a document's pieces are an array, so a level reads the pieces of the one before
    sized = lambda s: F.struct(s.alias("text"), T.count_tokens(s, "word").alias("tokens"))

    def split(pieces: Column, separator: str) -> Column:
        after = "(?<=" + "".join(f"\\x{ord(ch):02x}" for ch in separator) + ")"
        parts = lambda s: F.transform(F.filter(F.split(s, after), lambda x: x != ""), sized)
        return F.flatten(F.transform(pieces, lambda p: F.when(p["tokens"] <= size, F.array(p)).otherwise(parts(p["text"]))))

    pieces = functools.reduce(split, SEPARATORS, F.array(sized(F.col("text"))))
    each = docs.filter("text <> ''").select("doc_id", F.posexplode(pieces).alias("k", "p"))
    return each.select("doc_id", (F.col("k") + 1).alias("piece_no"), "p.text", "p.tokens")


def hierarchy(chunks: DataFrame, fan: int = 5, levels: int = 3) -> DataFrame:
    """(doc_id, level, node_no, first, last, text): leaves, parents of fan nodes each, and a root.

    A leaf gives a row for each node above it, so the chunks are read once; a
    node with one child has no row on its level.
    """
    no = F.col("chunk_no").cast("long")
    above = lambda level: F.floor((no - 1) / fan**level) + 1
    node = lambda level, number, child, text, own: F.struct(F.lit(level).alias("level"), number.cast("long").alias("node_no"), child.cast("long").alias("child"), text.alias("text"), own.cast("long").alias("own"))
    none, opening = F.lit(None), F.substring_index("text", ". ", 1)
    # leaves stay rows of their own, if ids repeat too
    nodes = [node(0, no, no, opening, F.monotonically_increasing_id())]
    nodes += [node(level, above(level), above(level - 1), opening, none) for level in range(1, levels + 1)]
    nodes.append(node(levels + 1, F.lit(1), no, F.lit(""), none))
    each = chunks.select("doc_id", no.alias("no"), F.explode(F.array(*nodes)).alias("x")).select("doc_id", "no", "x.*")
    g = each.groupBy("doc_id", "level", "node_no", "own").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.min_by("text", "no").alias("text"), (F.min("child") < F.max("child")).alias("parts"))
    return g.filter(F.col("parts") | F.col("level").isin(0, levels + 1)).select("doc_id", "level", "node_no", "first", "last", "text")


#: A child's first sentence counts for a summary if it is longer than so many bytes.
LEAST_POINT = 10


def extractive_summary(points: Column, tokens: Column, ratio: float) -> Column:
    """The children's first sentences, cut to three quarters as many words as ratio of the tokens if they are more tokens than that."""
    joined = F.array_join(F.filter(points, lambda s: F.octet_length(s) > LEAST_POINT), " ")
    target = F.floor(tokens * ratio).cast("int")
    words, keep = T.words(joined), F.floor(target * 3 / 4).cast("int")
    cut = (T.count_tokens(joined, "word") > target) & (keep > 0) & (keep < F.size(words))
    return F.when(cut, F.concat(F.array_join(F.slice(words, 1, F.greatest(keep, F.lit(1))), " "), F.lit("..."))).otherwise(joined)


def section_tree(docs: DataFrame, size: int = 512, fan: int = 5, levels: int = 3, ratio: float = 0.3, least: int = 2) -> DataFrame:
    """(doc_id, level, node_no, first, last, children, tokens, titles, point, summary): chunks of sections as leaves of a tree.

    Each section (``chunk.section_texts``) is chunked by itself, so no leaf
    crosses its end; leaves count through the document.  A level groups so many
    nodes in a row into a parent, which covers the leaves first to last and the
    sections titled so; a group of fewer than least nodes goes up as it is (its
    node has no row on the level).  What is left over gets a root, on the level
    above the last.  point is the first sentence of a node's first leaf, summary
    the points of its children, to ratio of its tokens.
    """
    chunks = K.chunk_sentence(K.section_texts(docs).select(F.struct("doc_id", "section", "title").alias("doc_id"), "text"), size)
    order = Window.partitionBy("doc_id").orderBy("section", "chunk_no")
    leaves = chunks.select("doc_id.*", "chunk_no", "text", "tokens").withColumn("node_no", F.row_number().over(order).cast("long"))
    point = F.coalesce(F.get(K.split_sentences(F.col("text")), F.lit(0)), F.lit(""))
    no = F.col("node_no")
    now = leaves.select("doc_id", F.lit(0).alias("level"), no, no.alias("first"), no.alias("last"), F.lit(0).cast("long").alias("children"), F.col("tokens").cast("long").alias("tokens"), F.array("title").alias("titles"), point.alias("point"))
    now = now.withColumn("summary", F.lit(""))
    scratch = Scratch(docs.sparkSession, "section-tree")
    out = now = scratch.keep(now)
    for level in range(1, levels + 2):
        root = level == levels + 1
        parent = F.lit(1).cast("long") if root else (F.floor((F.col("node_no") - 1) / fan) + 1)
        g = now.groupBy("doc_id", parent.alias("parent")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("node_no", "first", "last", "tokens", "titles", "point"))).alias("c"))
        points, titles = F.transform("c", lambda x: x["point"]), F.array_distinct(F.flatten(F.transform("c", lambda x: x["titles"])))
        tokens = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])
        made = g.select("doc_id", F.lit(level).alias("level"), F.col("parent").alias("node_no"), F.array_min(F.transform("c", lambda x: x["first"])).alias("first"), F.array_max(F.transform("c", lambda x: x["last"])).alias("last"), F.col("n").alias("children"), tokens.alias("tokens"), titles.alias("titles"), points[0].alias("point"), points.alias("points"))
        made = made.withColumn("summary", F.when(F.col("children") >= least, extractive_summary(F.col("points"), F.col("tokens"), ratio)).otherwise("")).drop("points")
        now = scratch.keep(made)
        out = out.unionByName(now.filter(F.col("children") >= least))
    return out


def _position() -> dict[str, Column]:
    order, whole = Window.partitionBy("doc_id").orderBy("chunk_no"), Window.partitionBy("doc_id")
    at = (F.col("chunk_no") - 1) / F.count("*").over(whole)
    band = F.when(at < 0.1, "introduction").when(at < 0.3, "early").when(at < 0.7, "middle").when(at < 0.9, "late").otherwise("conclusion")
    return {"at": at, "band": band, "before": F.coalesce(F.right(F.lag("text").over(order), F.lit(100)), F.lit("")), "after": F.coalesce(F.left(F.lead("text").over(order), F.lit(100)), F.lit(""))}


def position_context(chunks: DataFrame) -> DataFrame:
    """Relative place, section band, and the ends of the neighbouring chunks (100 characters)."""
    return chunks.select("doc_id", "chunk_no", *[c.alias(name) for name, c in _position().items()])


def boundary_scores(segments: DataFrame) -> DataFrame:
    """(doc_id, pos, score): cosine of each segment vector with the next."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    both = segments.withColumn("next", F.lead("vector").over(order)).filter("next is not null")
    return both.select("doc_id", "pos", V.cosine(F.col("vector"), F.col("next")).alias("score"))


def boundary_threshold(scores: DataFrame, method: str = "percentile", p: float = 0.3) -> DataFrame:
    """(doc_id, threshold) by percentile (sorted[int(p * n)]), iqr, mean, median or mean - deviation."""
    g = scores.groupBy("doc_id").agg(F.array_sort(F.collect_list("score")).alias("s"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    at = lambda q: F.get("s", F.least(F.floor(F.size("s") * q), F.size("s") - 1).cast("int"))
    value = {"percentile": at(p), "median": at(0.5), "mean": F.col("mean"), "deviation": F.col("mean") - F.col("sd"), "iqr": at(0.25) - 1.5 * (at(0.75) - at(0.25))}[method]
    return g.select("doc_id", value.alias("threshold"))


def segment_coherence(segments: DataFrame, p: float = 0.3) -> DataFrame:
    """(doc_id, segments, sequential, average, boundaries, score) of each document's segment vectors.

    score = 0.6 * mean cosine of neighbours + 0.4 * mean cosine of all pairs,
    less if more than half of the segments end at a boundary.  The sum over
    all pairs comes from the sum of the unit vectors: (|sum|**2 - n) / 2, so no
    pair is built.
    """
    near = boundary_scores(segments).groupBy("doc_id").agg(F.avg("score").alias("sequential"))
    cuts = detect_boundaries(segments, "percentile", p).groupBy("doc_id").agg(F.count("*").alias("boundaries"))
    unit = segments.select("doc_id", V.normalize(F.col("vector")).alias("u"))
    sizes = unit.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if(F.exists("u", lambda x: x != 0)).alias("whole"))
    sums = unit.select("doc_id", F.posexplode("u").alias("k", "x")).groupBy("doc_id", "k").agg(F.sum("x").alias("x")).groupBy("doc_id").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    out = sizes.join(sums, "doc_id", "left").join(near, "doc_id", "left").join(cuts, "doc_id", "left")
    pairs = F.col("segments") * (F.col("segments") - 1) / 2
    out = out.select("doc_id", "segments", F.coalesce("sequential", F.lit(0.0)).alias("sequential"), F.coalesce(F.try_divide((F.col("square") - F.col("whole")) / 2, pairs), F.lit(0.0)).alias("average"), F.coalesce("boundaries", F.lit(0)).alias("boundaries"))
    share = F.col("boundaries") / F.col("segments")
    score = (0.6 * F.col("sequential") + 0.4 * F.col("average")) * F.when(share > 0.5, 1 - (share - 0.5) * 0.5).otherwise(1.0)
    return out.withColumn("score", F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))


def chunk_contextual(docs: DataFrame, size: int = 512, embed=None) -> DataFrame:
    """Semantic chunks with their place, neighbours' ends, structure and, with embed, vectors."""
    chunks = K.chunk_semantic(docs, size, embed=embed)
    # place and neighbours are windows over the chunks themselves, so those are made once
    rows = chunks.select("doc_id", "chunk_no", "text", "tokens", T.chunk_structure(F.col("text")).alias("structure"), *[c.alias(name) for name, c in _position().items()])
    return embed(rows) if embed is not None else rows


def detect_boundaries(segments: DataFrame, method: str = "percentile", p: float = 0.3) -> DataFrame:
    scores = boundary_scores(segments)
    return scores.join(boundary_threshold(scores, method, p), "doc_id").filter("score <= threshold").select("doc_id", "pos", "score")


def outline(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind): headings (capitals, numbers, chapters), list items and text lines."""
    line = F.trim("line")
    each = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("k", "line")).filter(line != "")
    heading = (F.octet_length(line) < 100) & ((line == F.upper(line)) & line.rlike("[A-Z]") | line.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+[A-Z]") | line.rlike(r"(?i)^(chapter|section|part)\s"))
    kind = F.when(line.rlike(r"^([-*+•]|[0-9]+\))\s"), "item").when(heading, "heading").otherwise("text")
    return each.select("doc_id", (F.col("k") + 1).alias("line_no"), kind.alias("kind"))


def title_references(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst): a node's text holds another's title; both are compared within their document.

    A document's nodes get its titles in a row, if they are at most MOST_TITLES; a title is
    searched where its first word is among the node's.  In larger documents titles are looked
    up by that word, so only nodes that hold it are searched.
    """
    title = F.lower(F.trim("title"))
    titled = nodes.filter(F.trim("title") != "").select("doc_id", F.col("node").alias("dst"), title.alias("title"), T.trim_marks(F.split(title, r"\s+")[0]).alias("word"))
    titled = titled.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    low = nodes.select("doc_id", F.col("node").alias("src"), F.lower("text").alias("text"))
    holds = lambda word: F.array_contains(F.col("w"), word)
    listed = titled.filter(F.col("n") <= MOST_TITLES).groupBy("doc_id").agg(F.collect_list(F.struct("dst", "title", "word")).alias("titles"))
    words = F.array_distinct(T.trimmed_words(F.col("text")))
    near = low.join(listed, "doc_id").withColumn("w", words).select("doc_id", "src", F.filter("titles", lambda x: (F.col("src") != x["dst"]) & F.contains("text", x["title"]) & holds(x["word"])).alias("hits"))
    few = near.select("doc_id", "src", F.explode("hits").alias("hit")).select("doc_id", "src", "hit.dst")
    large = titled.filter(F.col("n") > MOST_TITLES).select("doc_id", "dst", "title", "word")
    # the texts stay behind while words are looked up
    each = low.join(large.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "src", F.explode(words).alias("word"))
    found = each.join(large, ["doc_id", "word"]).filter("src <> dst").distinct()
    many = found.join(low, ["doc_id", "src"]).filter(F.contains("text", "title")).withColumn("w", words).filter(holds(F.col("word"))).select("doc_id", "src", "dst")
    return few.unionByName(many).distinct()


def cross_references(nodes: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, src, dst): a node's keywords overlap another's of its document by more than a share of its own."""
    k = nodes.select("doc_id", "node", F.array_distinct(T.content_words(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    each = k.select("doc_id", "node", F.size("w").alias("n"), F.explode_outer("w").alias("word"))
    other = each.select("doc_id", F.col("node").alias("dst"), "word")
    hits = each.join(other, ["doc_id", "word"]).filter("node <> dst").groupBy("doc_id", F.col("node").alias("src"), "dst").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return hits.filter(F.col("shared") > share * F.col("n")).select("doc_id", "src", "dst", "shared")
