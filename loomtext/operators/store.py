"""Row maintenance, filters, access rules and expiry over memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T

# What each role may do, as role -> actions; root may do all.
PERMISSIONS = {"admin": ("read", "write", "delete", "manage"), "user": ("read", "write"), "guest": ("read",)}
# Token scopes from wide to narrow; each holds those after it.
SCOPES = ("full", "admin", "write", "read")


def get_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def upsert(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates replace rows by id; created_at of a replaced row stays."""
    old = df.select("id", F.col("created_at").alias("was"))
    fresh = updates.join(old, "id", "left").withColumn("created_at", F.coalesce("was", "created_at")).select(df.columns)
    return df.join(updates.select("id"), "id", "left_anti").unionByName(fresh)


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def apply_bulk_ops(df: DataFrame, ops: DataFrame) -> DataFrame:
    """ops: (seq, op, id, text); the last op of an id counts: add, update, upsert or delete."""
    last = ops.groupBy("id").agg(F.max_by(F.struct("op", "text"), "seq").alias("o")).select("id", "o.op", "o.text")
    both = df.withColumn("there", F.lit(True)).join(last.withColumnRenamed("text", "new_text"), "id", "full")
    there = F.col("there").isNotNull()
    lost = (F.col("op") == "delete") | (~there & (F.col("op") == "update"))
    keeps = F.col("op").isNull() | (there & (F.col("op") == "add"))
    text = F.when(keeps, F.col("text")).otherwise(F.col("new_text"))
    return both.filter(~F.coalesce(lost, F.lit(False))).select("id", text.alias("text"))


def bulk_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("processed"))


def metadata_filter(wanted: dict[str, str], metadata: str = "metadata", promoted: tuple[str, ...] = ()) -> Column:
    """All keys equal; promoted keys are columns, so their tests reach the scan."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & ((F.col(k) if k in promoted else F.col(metadata)[k]).cast("string") == v)
    return out


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def valid_content(c: Column, least: int, most: int, exclude: tuple[str, ...] = ()) -> Column:
    out = F.octet_length(c).between(least, most)
    for x in exclude:
        out = out & ~F.contains(F.lower(c), F.lit(x.lower()))
    return out


def purge_expired(df: DataFrame, now: Column, active: str | None = None) -> DataFrame:
    kept = df.filter(F.col("expires_at") >= now)
    return kept.filter(F.col(active)) if active else kept


def allowed(requests: DataFrame) -> DataFrame:
    """Requests (role, action, …) that their role permits; root may do all."""
    table = requests.sparkSession.createDataFrame([(r, a) for r, actions in PERMISSIONS.items() for a in actions], "role string, action string")
    return requests.filter("role = 'root'").unionByName(requests.filter("role <> 'root'").join(F.broadcast(table), ["role", "action"], "left_semi"))  # a fixed table


def token_has_scope(scopes: Column, wanted: str) -> Column:
    return F.arrays_overlap(scopes, F.array(*[F.lit(s) for s in SCOPES[: SCOPES.index(wanted) + 1]]))


def audit_query(log: DataFrame, limit: int, **wanted: str) -> DataFrame:
    for k, v in wanted.items():
        log = log.filter(F.col(k) == v)
    return page(log, [F.desc("ts"), "id"], limit)


def user_cubes(users: DataFrame, cubes: DataFrame, links: DataFrame) -> DataFrame:
    """Active cubes of each user by association."""
    return links.join(users.filter("is_active").select("user_id"), "user_id", "left_semi").join(cubes.filter("is_active"), "cube_id").select("user_id", "cube_id", "cube_name")


def accessible(pairs: DataFrame, users: DataFrame, cubes: DataFrame, links: DataFrame) -> DataFrame:
    """Of (user_id, cube_id): user and cube active, and the user owns it or is associated."""
    owns = cubes.filter("is_active").select(F.col("owner_id").alias("user_id"), "cube_id")
    linked = links.select("user_id", "cube_id").join(cubes.filter("is_active").select("cube_id"), "cube_id", "left_semi").select("user_id", "cube_id")
    rights = owns.unionByName(linked).distinct()
    return pairs.join(users.filter("is_active").select("user_id"), "user_id", "left_semi").join(rights, ["user_id", "cube_id"], "left_semi")


def collection_info(vectors: DataFrame) -> DataFrame:
    n = F.size("embedding")
    return vectors.agg(F.count("*").alias("points"), F.min(n).alias("least_dims"), F.max(n).alias("most_dims"))


def ordered_distinct(df: DataFrame, key: str, pos: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("checksum", F.sha2(F.concat_ws("\x1f", *columns), 256))


def latest_kv(changes: DataFrame) -> DataFrame:
    """(key, revision, value, op): the last value of each key; deleted keys drop out."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value", "op"), "revision").alias("l"), F.max("revision").alias("revision"))
    return last.filter("l.op <> 'delete'").select("key", "revision", "l.value")


def cluster_health(beats: DataFrame, now: Column, interval: int = 60) -> DataFrame:
    """(node, ts, tasks, errors): healthy if the last beat is at most three intervals old."""
    last = beats.groupBy("node").agg(F.max("ts").alias("ts"), F.sum("tasks").alias("tasks"), F.sum("errors").alias("errors"))
    return last.select("node", (F.unix_timestamp(now) - F.unix_timestamp(F.col("ts").cast("timestamp")) <= 3 * interval).alias("healthy"), "tasks", "errors", F.coalesce(F.try_divide(100 * F.col("errors"), F.col("tasks")), F.lit(0.0)).alias("error_rate"))


def pool_vectors(tokens: DataFrame, how: str = "mean") -> DataFrame:
    """(id, pos, vector): the first (cls), the mean, the maximum, or mean and maximum one behind the other (mean_max) of each id's token vectors.

    With a column mask, tokens where it isn't true are padding: they count for no
    mean (an id of padding alone has zeros), but for the maximum, as do all.
    """
    if how == "cls":
        return tokens.groupBy("id").agg(F.min_by("vector", "pos").alias("vector"))
    if how not in ("mean", "max", "mean_max"):
        raise ValueError(f"unknown pooling: {how}")
    counts = F.coalesce(F.col("mask").cast("boolean"), F.lit(False)) if "mask" in tokens.columns else F.lit(True)
    x = F.col("x").cast("double")
    each = tokens.select("id", counts.alias("counts"), F.posexplode_outer("vector").alias("k", "x")).filter("k is not null")
    g = each.groupBy("id", "k").agg(F.coalesce(F.avg(F.when(F.col("counts"), x)), F.lit(0.0)).alias("mean"), F.max(x).alias("max"))
    listed = g.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "mean", "max"))).alias("v"))
    part = lambda name: F.transform("v", lambda e: e[name])
    return listed.select("id", (F.concat(part("mean"), part("max")) if how == "mean_max" else part(how)).alias("vector"))


def concat_arrays(parts: DataFrame) -> DataFrame:
    """(id, pos, vector): the arrays of each id, one behind the other.

    With a column shape, parts of one id must have the same: the result then has
    the columns length (of all parts) and fits; where they differ, or one is null,
    fits is false and the vector null.
    """
    shaped = ["shape"] if "shape" in parts.columns else []
    more = [F.sum(F.size("vector")).alias("length"), ((F.count_distinct("shape") == 1) & (F.count("shape") == F.count("*"))).alias("fits")] if shaped else []
    g = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("p"), *more)
    joined = F.flatten(F.transform("p", lambda e: e["vector"]))
    if not shaped:
        return g.select("id", joined.alias("vector"))
    return g.select("id", F.when(F.col("fits"), joined).alias("vector"), "length", "fits")


# --- sizes of a memory, kept with each write --------------------------------


def size_counts(memories: DataFrame, vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(measure, n) and (term, n): what a table of memories (id, memory_type, text), vectors, nodes and edges adds to the sizes.

    Both are sums, so the counts of a write are added to the stored ones by
    ``merge_sizes``; terms are counted by memory, which makes them removable.
    """
    total = memories.agg(F.count("*").alias("n")).select(F.lit("total").alias("measure"), "n")
    types = memories.groupBy(F.concat(F.lit("type:"), F.coalesce("memory_type", F.lit(""))).alias("measure")).agg(F.count("*").alias("n"))
    counts = total.unionByName(types)
    for name, table in (("embeddings", vectors), ("graph_nodes", nodes), ("graph_edges", edges)):
        if table is not None:
            counts = counts.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n"))
    terms = memories.select(F.explode(F.array_distinct(T.clean_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts, terms


def merge_sizes(stored: tuple[DataFrame, DataFrame], change: tuple[DataFrame, DataFrame], removed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored counts with those of rows that were added, or removed; what falls to nothing drops out."""
    sign, out = -1 if removed else 1, []
    for key, old, new in zip(("measure", "term"), stored, change):
        both = old.unionByName(new.select(key, (F.col("n") * sign).alias("n")))
        out.append(both.groupBy(key).agg(F.sum("n").alias("n")).filter("n > 0"))
    return out[0], out[1]


def memory_sizes(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(measure, n): memories in all and by type, vectors, nodes, edges, and the different terms of the index (index_size)."""
    return counts.unionByName(terms.agg(F.count("*").alias("n")).select(F.lit("index_size").alias("measure"), "n"))


def newest(df: DataFrame, by: str, order: list, k: int = 1) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")
