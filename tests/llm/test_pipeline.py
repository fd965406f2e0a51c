import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from loomtext.llm import decontaminate
from loomtext.llm.queries import word_tokenizer

from .helpers import frame, words_text
from .test_leaks_and_quality import plain_clean
from .test_near_dedup import brute


def prose(rng, n):
    w = words_text(rng, n, 3000).split(" ")
    return " ".join(x + ("." if k % 9 == 8 else "") for k, x in enumerate(w)) + "."


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    import random

    rng = random.Random(6)
    items = [(k, prose(rng, 30)) for k in range(3)]
    rows = [(k, prose(rng, rng.randint(60, 150)), "en", f"s{k % 3}", 0) for k in range(40)]
    rows += [(100, rows[4][1], "en", "s0", 0), (101, rows[5][1].replace("w1", "q1", 1), "en", "s1", 0)]  # an exact and a near copy
    rows += [(102, f"{prose(rng, 60)}\n{items[1][1]}", "en", "s2", 0)]  # a leak
    rows += [(103, "BUY!! " * 80, "en", "s0", 0), (104, "short", "en", "s0", 0), (105, None, None, None, None)]
    rows += [(106, f"Home | News | Shop | About\n{prose(rng, 70)}", "en", None, 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    cleaned = [(i, c) for i, t, *_ in rows if (c := plain_clean(t)) is not None]
    assert {i for i, _ in cleaned} == set(range(40)) | {100, 101, 102, 106}
    kept = {i for i, _, _, k in brute(cleaned) if k}
    assert kept == set(range(40)) | {102, 106}
    texts = {i: t for i, t in cleaned if i in kept and i != 102}
    assert "Home" not in texts[106]
    model = Tokenizer.from_file(word_tokenizer())
    ids = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert {i: v[1:] for i, v in got.items()} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    order = sorted(got, key=lambda i: got[i][0])
    assert [got[i][0] for i in order] == np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])[:-1]]).tolist()


def test_stages_keep_the_columns(spark, tmp_path):
    docs = frame(spark, [(1, "Nothing of interest. " * 30 + " ".join(f"Word{k}." for k in range(90)), "en", "s", 0)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now, str(tmp_path)).columns == docs.columns, name
    assert decontaminate.find_leaks(now, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 0


def test_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_and_what_is_left_behind(spark, tmp_path):
    """A leak goes also under a null id or one that another text has too; only the token files stay in the shared folder."""
    import random
    from pathlib import Path

    rng = random.Random(8)
    item = prose(rng, 30)
    clean = [prose(rng, 80) for _ in range(5)]
    leak = lambda: f"{prose(rng, 60)}\n{item}"
    rows = [(None, clean[0], "en", "s", 0), (None, leak(), "en", "s", 0), (None, clean[1], None, None, 0), (5, clean[2], "en", "s", 0), (5, leak(), "en", "t", 0), (6, clean[3], "en", None, 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = Tokenizer.from_file(word_tokenizer())
    expected = sorted((str(i), len(model.encode(t, add_special_tokens=False).ids) + 1) for i, t in [(None, clean[0]), (None, clean[1]), (5, clean[2]), (6, clean[3])])
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == expected
    assert {p.name.split("-")[0] for p in set(shared.iterdir()) - before} == {"tokens", "manifest"}
