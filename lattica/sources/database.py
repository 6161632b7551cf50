"""Tables that keep datasets: saved folders, stored tables of the catalog, databases over JDBC."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lattica.dataset import Dataset, Slice


def _meta(ds: Dataset) -> str:
    return json.dumps({"rows": ds.rows, "order_by": [], "slices": [[s.name, list(s.dims), sorted(s.marks)] for s in ds.slices]})


def _frame(ds: Dataset) -> DataFrame:
    return ds.df.select(*(ds.df[s.column].alias(f"c{k}") for k, s in enumerate(ds.slices)))


def save(ds: Dataset, path: str) -> None:
    """Data as Parquet in path/data, slices and dims in path/meta."""
    _frame(ds).write.mode("overwrite").parquet(f"{path}/data")
    ds.df.sparkSession.createDataFrame([(_meta(ds),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Dataset:
    """What save() wrote."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return _restored(spark.read.parquet(f"{path}/data"), meta)


def _restored(df: DataFrame, meta: dict) -> Dataset:
    return Dataset(df, [Slice(n, f"c{k}", tuple(d), frozenset(m)) for k, (n, d, m) in enumerate(meta["slices"])], meta["rows"], meta["order_by"])


class Catalog:
    """Datasets as tables of the session's catalog; attribute access reads one."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def Store(self, name: str, ds: Dataset) -> None:
        """A new table, or more rows of one that is there."""
        full = f"{self.database}.{name}"
        if not self.spark.catalog.tableExists(full):
            _frame(ds).write.format("parquet").saveAsTable(full)
            self.spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('dims' = '{_meta(ds)}')")
        else:
            _frame(ds).write.format("parquet").mode("append").saveAsTable(full)

    def Get(self, name: str) -> Dataset:
        full = f"{self.database}.{name}"
        found = {r[0]: r[1] for r in self.spark.sql(f"SHOW TBLPROPERTIES {full}").collect()}
        return _restored(self.spark.table(full), json.loads(found["dims"])) if "dims" in found else Dataset.of(self.spark.table(full), name)

    def Drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")

    def Query(self, sql: str) -> Dataset:
        """The result of a query in the engine's SQL."""
        return Dataset.of(self.spark.sql(sql), "rows")

    def Tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(self.database)]


class Database:
    """Tables of another database over JDBC; filters, columns and limits go to it."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def Get(self, name: str, rows: str | None = None) -> Dataset:
        return Dataset.of(self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load(), rows or name)

    def Query(self, sql: str) -> Dataset:
        return Dataset.of(self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.options).load(), "rows")

    def Store(self, name: str, ds: Dataset) -> None:
        ds.toDF().write.format("jdbc").options(url=self.url, dbtable=name, **self.options).mode("append").save()
