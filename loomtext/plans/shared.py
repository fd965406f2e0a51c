"""Where intermediate tables live, and the session settings the operators need."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: The folders made since a cleared_after() began.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session has none (tests) a temporary folder is made and
    put there; on a cluster the executors couldn't see one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def cleared_after(spark: SparkSession) -> Iterator[None]:
    """Deletes what is written in the shared folder within the block, when it ends.

    Operators give DataFrames that read such tables; a caller who writes the
    result within the block needs none of them afterwards.  Tables of
    ``Scratch(..., lasting=True)`` stay.
    """
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            drop_folder(spark, path)
        _made.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written in the shared folder; each cuts the lineage behind it."""

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        self.spark, self.name, self.lasting, self.paths = spark, name, lasting, {}

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes df and gives the written table; by: a folder "by=value" for each value of that column."""
        path = new_folder(self.spark, self.name)
        if self.lasting and (made := _made.get()) is not None:
            made.remove(path)
        df.write.parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def path(self, df: DataFrame) -> str:
        """The folder of a table that keep() gave."""
        return self.paths[id(df)][0]

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        path, _ = self.paths.pop(id(df))
        drop_folder(self.spark, path)

    def drop_all_but(self, *kept: DataFrame) -> None:
        for key in [k for k in self.paths if k not in {id(x) for x in kept}]:
            path, _ = self.paths.pop(key)
            drop_folder(self.spark, path)


def stored_batches(folder: str, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a written table in batches, for a task that reads it by itself; file by file by name."""
    from pyarrow import fs, parquet

    store, path = fs.FileSystem.from_uri(folder)
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)) if x.path.endswith(".parquet"))
    for name in names:
        with store.open_input_file(name) as stream:
            yield from parquet.ParquetFile(stream).iter_batches(rows)


def bounded(ids: DataFrame) -> DataFrame:
    """ids (written, one narrow column) marked to be broadcast if there are at most BROADCAST_IDS of them."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Arrow batches of about so many bytes, as a worker holds a batch whole; a limit that the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, f"{limit}b")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table in fewer splits than cores over all cores.

    A small file with one row group is read by one task; without this, all
    that follows would run there too.  Large tables stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
