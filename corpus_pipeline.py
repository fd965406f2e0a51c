"""A corpus pipeline of five stages over `documents`.

Each stage takes all its predecessor kept, as a Parquet table, and all but the
last return the columns of `documents`.  Mixing changes no row: it writes the
documents in the mixed order, and the token stage writes its files in the order
of that table's files and rows.  Rows with a null id are documents like others:
they are linked with no near copy, and go if they fail the rules or leak.

Ids to be dropped are broadcast while they are few (a checked count), so texts
are shuffled for the mixed order only.  What a stage's operators write on the
way is deleted when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, mixing, near_dedup, quality_rules, token_files
from loomtext.llm.queries import word_tokenizer
from loomtext.llm.stage import Scratch, bounded, cleared_after, free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    dropped = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(bounded(Scratch(spark, "dropped").keep(dropped)), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item or an edited copy of one go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = free_name(docs, "key")  # of id and text, as ids may be null or repeat
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = decontaminate.find_leaks(keyed, items, id_col=key).select(key).distinct()
    return keyed.join(bounded(Scratch(spark, "leaks").keep(leaks)), key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the source mix."""
    key = free_name(docs, "key")  # of id and text, as ids may be null or repeat
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    # rows that are equal in both stand at the first one's turn
    turns = mixing.mix_sources(keyed, id_col=key).groupBy(key).agg(F.min(F.struct("slot", "place")).alias("turn"))
    ordered = keyed.join(turns, key).select(*docs.columns, "turn.slot", "turn.place")
    return ordered.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixed table, read back."""
    return token_files.token_table(docs, word_tokenizer(), as_stored=True)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", mix),
    ("token files", tokens),
]

#: The token stage has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline", lasting=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with cleared_after(spark):
            done = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    out = STAGES[-1][1](spark, docs, sf_dir)
    if len(STAGES) > 1:
        scratch.drop(docs)  # the token files are written by now
    return out
