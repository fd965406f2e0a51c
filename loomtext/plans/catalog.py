"""The registry of named queries, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import spread

#: Tables whose rows take much work each.
TEXT_TABLES = ("documents", "pages", "conversations")
Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Registers fn(t), where t(table) gives a table of the data folder."""

        def register(fn):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                def read(table: str) -> DataFrame:
                    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                    return spread(df) if table in TEXT_TABLES else df

                return fn(read)

            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return fn

        return register


#: SQL pieces that several twins share.
def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def sql_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


SQL_MARKS = "greatest(len(regexp_extract_all(text, '[.!?]')), 1)"
SQL_N_WORDS = "len(regexp_extract_all(text, '\\S+'))"
