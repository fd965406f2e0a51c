"""Code by functions, small texts merged, marks of tables and code."""

import random
import re

from pyspark.sql import functions as F

from loomtext.functions import features as X
from loomtext.operators import structure as D

PYTHON = "```python\nimport os\n\ndef one(a):\n    return a\n\nclass Two:\n    def three(self):\n        return 3\n```"
SCRIPT = "```js\nconst f = (x) => {\n  return x;\n}\nfunction g(y) {\n  return f(y);\n}\nlet z = 1;\n```"
GO = "```go\npackage main\n\ntype T struct {\n\tx int\n}\n\nfunc (t T) Get() int {\n\treturn t.x\n}\n```"
JAVA = "```java\npublic class A {\n  private int x;\n  public String name() {\n    return \"a\";\n  }\n}\n```"
OTHER = "```\nloop {\n  step\n}\n// Function tail\nend\n```"


def begins(line, language):
    t = line.strip()
    if language == "python":
        return t.startswith(("def ", "class "))
    if language in ("javascript", "js"):
        return "function " in t or any(x in t for x in ("const ", "let ", "var ")) and "=>" in t
    if language == "go":
        return t.startswith(("func ", "type "))
    if language == "java":
        return any(x in t for x in ("public ", "private ", "protected ")) and any(x in t for x in ("class ", "interface ", "void ", "int ", "String "))
    return t.endswith("{") or "//" in t and ("Function" in t or "Method" in t)


def tokens(s):
    return len(s.split()) + len(re.findall(r"""[.,!?;:()\[\]{}"']""", s)) // 2


def plain_code(block, size):
    language = re.match(r"```[ \t]*([A-Za-z0-9_+#-]*)", block)[1].lower()
    sections = []
    for k, line in enumerate(block.split("\n")):
        if k == 0 or begins(line, language):
            sections.append([])
        sections[-1].append(line)
    out = []
    for section in sections:
        held, n = [], 0
        for line in section:
            if held and n + tokens(line) > size:
                out.append(("\n".join(held), n))
                held, n = [], 0
            held.append(line)
            n += tokens(line)
        out.append(("\n".join(held), n))
    return out


def test_code_is_cut_by_functions(spark):
    blocks = [PYTHON, SCRIPT, GO, JAVA, OTHER]
    rng = random.Random(2)
    words = ["def f():", "class C:", "x = 1", "if (a) {", "}", "func b() {", "type Q int", "public void m() {", "const k = () => 1", "// Method q", "  return  x", ""]
    blocks += [f"```{rng.choice(['python', 'go', 'java', 'js', '', 'Rust'])}\n" + "\n".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + "\nend\n```" for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(blocks)), "doc_id long, text string")
    for size in (4, 12, 200):
        got = {}
        for r in D.chunk_multimodal(docs, size).orderBy("doc_id", "chunk_no").collect():
            assert r["kind"] == "code"
            got.setdefault(r["doc_id"], []).append((r["text"], r["tokens"]))
        assert got == {k: plain_code(b, size) for k, b in enumerate(blocks)}, size
    whole = {r["doc_id"]: r["n"] for r in D.chunk_multimodal(docs, 200).filter("doc_id < 5").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert whole == {0: 4, 1: 3, 2: 3, 3: 4, 4: 3}


def test_small_texts_are_merged(spark):
    long = " ".join(f"w{k}" for k in range(18)) + "."
    text = f"One two. {long} Three four. Five six seven."
    got = [(r["text"], r["tokens"]) for r in D.chunk_multimodal(spark.createDataFrame([(1, text)], "doc_id long, text string"), 18).orderBy("chunk_no").collect()]
    assert got == [("One two.", 2), (long, 18), ("Three four.\nFive six seven.", 5)]
    # two chunks of 4 with a budget of 9 that a third would pass: 4 + 4 <= 9 and both under 4.5
    parts = ["a b c d.", "e f g h i j.", "k l m n.", "o p q r."]
    got = [r["text"] for r in D.chunk_multimodal(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string"), 9).orderBy("chunk_no").collect()]
    assert got == [parts[0], parts[1], f"{parts[2]}\n{parts[3]}"]


def test_merging_never_chains():
    import numpy as np

    from loomtext.operators.packing import Rule, _in_sections

    rule = Rule(10, max_units=1, merge_below=5)
    first, last = _in_sections(np.array([3, 3, 3, 4, 8, 2]), np.zeros(0, int), rule)
    assert list(zip(first, last)) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_marks_of_tables_and_code(spark):
    # expected values by hand: two kinds of marks, not two marks of a kind
    tables = {"a | b | c": False, "Table 1: Row": True, "Table without": False, "x\ty | z": True, "Column\tone": True, "row and column": False, "": False}
    code = {"public key": True, "a function of": True, "class": True, "let us": True, "define it": False, "```\nx\n```": False, "#include <x>": False}
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in tables], "t string").select("t", X.has_tables(F.col("t")).alias("v")).collect()}
    assert got == tables
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in code], "t string").select("t", X.has_code(F.col("t")).alias("v")).collect()}
    assert got == code


def plain_tree(sections, chunked, fan, levels, ratio, least=2):
    """One document's tree: leaves by section, then groups of fan nodes, then the root."""
    sentences = lambda s: [x.strip() for x in re.split(r"(?<=[.!?])\s+", s) if x.strip()]
    nodes = []
    for title, chunks in zip(sections, chunked):
        for text, n in chunks:
            k = len(nodes) + 1
            nodes.append((k, k, k, 0, n, [title], sentences(text)[0], ""))
    out = [(0, *x) for x in nodes]
    for level in range(1, levels + 2):
        groups = {}
        for x in nodes:
            groups.setdefault(1 if level > levels else (x[0] - 1) // fan + 1, []).append(x)
        nodes = []
        for k, c in sorted(groups.items()):
            tokens_, points = sum(x[4] for x in c), [x[6] for x in c]
            joined = " ".join(p for p in points if len(p.encode()) > 10)
            target = int(tokens_ * ratio + 1e-9)
            keep = target * 3 // 4
            if tokens(joined) > target and 0 < keep < len(joined.split()):
                joined = " ".join(joined.split()[:keep]) + "..."
            titles = list(dict.fromkeys(t for x in c for t in x[5]))
            nodes.append((k, c[0][1], c[-1][2], len(c), tokens_, titles, points[0], joined if len(c) >= least else ""))
        out += [(level, *x) for x in nodes if x[3] >= least]
    return out


def test_section_tree_equals_a_plain_one(spark):
    from loomtext.operators import chunk as K

    rng = random.Random(9)
    sentence = lambda: f"{rng.choice(['Alpha', 'Beta', 'No'])} " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 9))) + "."
    docs, parts = [], {}
    for d in range(6):
        held = [(f"Title {k}", " ".join(sentence() for _ in range(rng.randint(1, 14)))) for k in range(rng.choice([1, 3, 9]))]
        docs.append((d, "\n".join(f"# {t}\n{x}" for t, x in held)))
        parts[d] = held
    docs += [(6, None), (7, ""), (8, "One line alone.")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {(r["doc_id"], r["title"]): r["text"] for r in K.section_texts(table).collect()}
    assert texts[0, "Title 0"] == f"# Title 0\n{parts[0][0][1]}"
    for fan, levels in ((2, 3), (5, 1)):
        got = {}
        for r in D.section_tree(table, 20, fan, levels).collect():
            got.setdefault(r["doc_id"], []).append((r["level"], r["node_no"], r["first"], r["last"], r["children"], r["tokens"], r["titles"], r["point"], r["summary"]))
        for d, held in parts.items():
            chunked = []
            for title, x in held:
                rows = K.chunk_sentence(spark.createDataFrame([(1, f"# {title}\n{x}")], "doc_id long, text string"), 20).orderBy("chunk_no").collect()
                chunked.append([(r["text"], r["tokens"]) for r in rows])
            assert sorted(got[d]) == sorted(plain_tree([t for t, _ in held], chunked, fan, levels, 0.3)), (d, fan)
        assert 6 not in got and 7 not in got and [x[:2] for x in got[8]] == [(0, 1)]


def test_title_references_send_no_text_with_each_word(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    nodes = [(d, n, f"{rng.choice(words)} {rng.choice(words)}", " ".join(rng.choices(words, k=30)) + rng.choice(["", ".", " x" + words[0]])) for d, many in ((1, 5), (2, 40)) for n in range(many)]
    df = spark.createDataFrame(nodes, "doc_id long, node long, title string, text string")
    edges = lambda w: re.sub(r"""^[.,!?;:"'()\[\]]+|[.,!?;:"'()\[\]]+$""", "", w)
    expected = sorted((d, n, m) for d, n, _, x in nodes for e, m, title, _ in nodes if d == e and n != m and title in x and title.split()[0] in {edges(w) for w in x.split()})
    for most in (0, 8, 64):
        monkeypatch.setattr(D, "MOST_TITLES", most, raising=False)
        assert expected and sorted(map(tuple, D.title_references(df).collect())) == expected
    # what is joined has texts or one row a word, not both
    plan = D.title_references(df)._jdf.queryExecution().optimizedPlan()
    both, todo = [], [plan]
    while todo:
        node = todo.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        todo += below
        if node.nodeName() == "Join":
            names = [{x.split("#")[0] for x in re.findall(r"\w+#\d+", side.output().toString())} for side in below]
            both += [x for x in names if {"text", "word"} <= x and "title" not in x]
    assert not both


def test_recursive_pieces_come_from_one_pass(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "word", "b.", "c; ", ", ", ". ", "\n", "\n\n", "\n\n\n", " ", "? ", "x! "]) for _ in range(400))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "one"), (4, None)], "doc_id long, text string")

    def plain(piece, separators):
        if tokens(piece) <= 12 or not separators:
            return [piece]
        return [y for x in re.split(f"(?<={re.escape(separators[0])})", piece) if x for y in plain(x, separators[1:])]

    got = D.chunk_recursive(docs, 12)
    assert [r["text"] for r in got.filter("doc_id = 1").orderBy("piece_no").collect()] == plain(text, D.SEPARATORS)
    assert [(r["piece_no"], r["text"]) for r in got.filter("doc_id = 3").collect()] == [(1, "one")] and got.filter("doc_id in (2, 4)").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1 and "Window" not in plan.toString()


def test_recursive_parts_are_combined_and_cut_between_characters(spark):
    def plain(piece, separators, size):
        if tokens(piece) <= size:
            return [piece]
        if not separators:
            out = []
            while piece:
                n = max(k for k in range(1, min(len(piece), 4 * size) + 1) if tokens(piece[:k]) <= size)
                out, piece = [*out, piece[:n]], piece[n:]
            return out
        held, out = "", []
        for part in [x for x in re.split(f"(?<={re.escape(separators[0])})", piece) if x]:
            if held and tokens(held + part) > size:
                out, held = [*out, held], ""
            held += part
            if tokens(held) > size:
                out, held = out + plain(held, separators[1:], size), ""
        return out + [held] * (held != "")

    rng = random.Random(5)
    units = ["a", "wörd", "b.", "c; ", ", ", ". ", "\n", "\n\n", "\n\n\n", " ", "? ", "x! ", "\t", "日本", "(", '"']
    texts = ["".join(rng.choice(units) for _ in range(n)) for n in (0, 1, 5, 40, 300, 300, 900)]
    texts += ["\t".join(["word"] * 200), "é" * 500 + "(" * 99, ".\t" * 150]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").coalesce(1)
    for size in (1, 12, 64):
        got = D.chunk_recursive(docs, size, combine=True).orderBy("doc_id", "piece_no").collect()
        want = [(d, k + 1, x, tokens(x)) for d, t in enumerate(texts) if t for k, x in enumerate(plain(t, D.SEPARATORS, size))]
        assert list(map(tuple, got)) == want and max(r["tokens"] for r in got) <= size
    from loomtext.plans import registry
    import os, tempfile  # noqa: E401

    folder = tempfile.mkdtemp(prefix="recursive-")
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    rows = {r["doc_id"]: (r["bytes"], r["within"]) for r in registry.QUERIES["chunk_recursive"](spark, folder).collect()}
    assert rows == {d: (len(t.encode()), True) for d, t in enumerate(texts) if t}


def test_hierarchy_reads_chunks_once(spark):
    chunks = spark.createDataFrame([(d, k + 1, f"d{d}c{k}. more", 3) for d, n in ((1, 1), (2, 5), (3, 6), (4, 32), (5, 126)) for k in range(n)], "doc_id long, chunk_no int, text string, tokens int")
    expected = []
    for d, n in ((1, 1), (2, 5), (3, 6), (4, 32), (5, 126)):
        expected += [(d, 0, k, k, k, f"d{d}c{k - 1}") for k in range(1, n + 1)] + [(d, 4, 1, 1, n, "")]
        for level in (1, 2, 3):
            for first in range(1, n + 1, 5**level):
                last = min(first + 5**level - 1, n)
                if last - first >= 5 ** (level - 1):
                    expected.append((d, level, (first - 1) // 5**level + 1, first, last, f"d{d}c{first - 1}"))
    got = D.hierarchy(chunks)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
