"""Readers and writers: memory lists, cubes, snapshots, text, CSV and JSON documents, graphs, audit logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import chunk as K
from loomtext.operators import store as S
from loomtext.plans.shared import Scratch

MEMORIES = "id string, memory string, metadata map<string,string>, created_at string, updated_at string"


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of items, or an object with a list under nodes; unreadable dates become null."""
    raw = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"array<struct<{MEMORIES.replace(' ', ':').replace(',:', ',')}>>")
    tree = F.from_json("value", f"struct<nodes:array<struct<{MEMORIES.replace(' ', ':').replace(',:', ',')}>>>")["nodes"]
    items = raw.select(F.explode_outer(F.when(F.ltrim("value").startswith("["), plain).otherwise(tree)).alias("m")).select("m.*").filter("id is not null")
    return items.withColumns({c: F.try_to_timestamp(c) for c in ("created_at", "updated_at")})


def write_memories(df: DataFrame, path: str, kind: str = "json", edges: DataFrame | None = None) -> None:
    """The items; with edges a tree export: nodes, edges, and a header with their counts."""
    if edges is None:
        df.write.mode("overwrite").format(kind).save(path)
        return
    df.write.mode("overwrite").format(kind).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(kind).save(f"{path}/edges")
    header = df.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))  # one row each
    header.withColumn("exported_at", F.current_timestamp()).write.mode("overwrite").format(kind).save(f"{path}/header")


CUBE_TABLES = ("textual", "activation", "parametric")


def write_cube(memories: DataFrame, path: str, config: dict[str, str] | None = None, **more: DataFrame) -> None:
    """One folder per memory table (textual, and activation or parametric if given), partitioned by cube, and the configuration."""
    for name, df in {"textual": memories, **more}.items():
        if name not in CUBE_TABLES:
            raise ValueError(f"unknown memory table: {name}")
        df.write.mode("overwrite").partitionBy("cube_id").parquet(f"{path}/{name}")
    rows = memories.sparkSession.createDataFrame(sorted((config or {}).items()), "key string, value string")
    rows.write.mode("overwrite").json(f"{path}/config")


def read_cube(spark: SparkSession, path: str, cube_id: str | None = None, table: str = "textual") -> DataFrame:
    df = spark.read.parquet(f"{path}/{table}")
    return df.filter(F.col("cube_id") == cube_id) if cube_id is not None else df


def read_cube_config(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/config").collect()}


def snapshot(df: DataFrame, path: str, stamp: str) -> None:
    df.withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("snapshot").parquet(path)


def snapshot_and_clear(df: DataFrame, path: str, stamp: str) -> DataFrame:
    """Writes a snapshot; what is left is an empty table of the same columns."""
    snapshot(df, path, stamp)
    return df.limit(0)


def read_snapshots(spark: SparkSession, path: str, keep_last: int) -> DataFrame:
    """Rows of the newest snapshots."""
    df = spark.read.parquet(path)
    last = df.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(keep_last)
    return df.join(F.broadcast(last), "snapshot", "left_semi")  # keep_last rows


def readable(c: Column) -> Column:
    """At least 80 % of the first 1024 characters can be printed."""
    head = F.substring(c, 1, 1024)
    return F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]")) <= 0.2 * F.length(head)


def read_text_docs(spark: SparkSession, path: str, squeeze: bool = False) -> DataFrame:
    """(file, text): whole files that are readable, without a byte order mark."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("text")).filter(readable(F.col("text")))
    return raw.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))) if squeeze else raw


def value_class(c: Column) -> Column:
    s = F.trim(c)
    return (
        F.when(s == "", "empty")
        .when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), "number")
        .when(s.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(s.rlike(r"^https?://"), "url")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date")
        .otherwise("text")
    )


def read_csv_profiled(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as strings; its first line is a header if more columns hold text there over numbers below than the other way round."""
    raw = spark.read.csv(path, header=False)
    head = raw.first()
    below = raw.limit(20).offset(1).select([F.coalesce(F.max(F.col(c).rlike(r"^\s*[+-]?[0-9.]+\s*$").cast("int")), F.lit(0)).alias(c) for c in raw.columns]).first() if head else None
    number = lambda v: v is not None and v.strip().replace(".", "", 1).lstrip("+-").isdigit()
    score = sum((not number(v)) * bool(b) - number(v) for v, b in zip(head, below)) if head else 0
    return spark.read.csv(path, header=True) if score > 0 else raw


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, class, share): the most frequent class of each column's non-empty values, if over half."""
    strings = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    long = strings.unpivot([], df.columns, "column", "value").filter("value is not null").withColumn("class", value_class(F.col("value"))).filter("class <> 'empty'")
    g = long.groupBy("column", "class").agg(F.count("*").alias("n")).groupBy("column").agg(F.max_by("class", F.struct("n", "class")).alias("class"), (F.max("n") / F.sum("n")).alias("share"))
    return g.select("column", F.when(F.col("share") > 0.5, F.col("class")).otherwise("text").alias("class"), "share")


def json_paths(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, value): the scalars of a JSON column, however deep, level by level.

    Each level is written in the shared folder, as JSON texts; the loop ends
    when nothing nested is left.
    """
    scratch = Scratch(df.sparkSession, "json")
    level = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.col(json_col).alias("json")).filter("json is not null")
    out = None
    while True:
        parsed = level.select("id", "path", F.try_parse_json("json").alias("v")).filter("v is not null")
        kind = F.schema_of_variant("v")
        parsed = parsed.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        name = "e_" + uuid.uuid4().hex
        parsed.filter("nested").createOrReplaceTempView(name)
        try:
            below = df.sparkSession.sql(f"SELECT id, concat(path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) AS path, to_json(e.value) AS json FROM {name}, LATERAL variant_explode(v) AS e")
            below = scratch.keep(below)
        finally:
            df.sparkSession.catalog.dropTempView(name)
        scalars = parsed.filter("not nested").select("id", "path", F.expr("cast(v as string)").alias("value"))
        out = scalars if out is None else out.unionByName(scalars)
        if below.isEmpty():
            return out
        level = below


def ingest_documents(docs: DataFrame, least: int = 10, most: int = 1_000_000, size: int = 512) -> DataFrame:
    """Preprocess, validate, chunk and analyse (doc_id, text); refused documents keep a row with an error."""
    cleaned = docs.select("doc_id", F.trim("text").alias("text"))
    ok = F.coalesce(S.valid_content(F.col("text"), least, most), F.lit(False))
    chunks = K.chunk_sentence(cleaned.filter(ok), size)
    text = F.col("text")
    good = chunks.select("doc_id", "chunk_no", "tokens", T.content_density(text).alias("density"), T.content_type(text).alias("content_type"), F.lit(None).cast("string").alias("error"))
    bad = cleaned.filter(~ok).select("doc_id", F.lit(None).cast("int").alias("chunk_no"), F.lit(None).cast("int").alias("tokens"), F.lit(None).cast("double").alias("density"), F.lit(None).cast("string").alias("content_type"), F.lit("length out of bounds").alias("error"))
    return good.unionByName(bad)


def load_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each vertex once, and the edges whose ends exist."""
    from loomtext.operators.graph import verified_edges

    once = vertices.dropDuplicates(["id"])
    return once, verified_edges(once, edges)


def export_graph_json(vertices: DataFrame, edges: DataFrame, path: str, limit: int | None = None) -> None:
    """All nodes and relations; with a limit the first so many nodes, and the relations between them."""
    if limit is not None:
        vertices = vertices.orderBy("id").limit(limit)
        kept = vertices.select("id")
        edges = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    vertices.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/relations")


def append_audit_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)
