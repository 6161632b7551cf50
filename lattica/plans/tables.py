"""The driver's tables as datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.dataset import Dataset

#: Columns that order each table's rows totally.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return Dataset.of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, KEYS[name])


class Registry:
    """Collects a module's queries and SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None) -> Callable:
        """Decorator: a function of a table getter becomes a query."""

        def take(f: Callable[[Callable[[str], Dataset]], Dataset]) -> Callable:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                made = f(lambda name: table(spark, sf_dir, name))
                return made.toDF() if isinstance(made, Dataset) else made

            self.queries[f.__name__] = query
            if sql:
                self.sql[f.__name__] = sql
            return f

        return take
