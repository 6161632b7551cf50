"""Tables in the folder that all executors share, and dense row positions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local folder on one machine, and an error on several."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir: intermediate tables go there")
    if not found:
        found = "/tmp/checkpoints/lattica"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; it goes by spent(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    at, files = _file(spark, path)
    df.write.mode("overwrite").parquet(path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        at, files = _file(df.sparkSession, df._lattica_path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def positions(df: DataFrame, order_by: list[str], name: str = "__pos") -> DataFrame:
    """df with each row's 0-based place in the order of order_by, which must be total.

    No task gets all rows: the rows are range-partitioned and sorted, each numbered within its partition and written;
    the counts before each partition, one row for each, are added. spent() deletes the table below.
    """
    placed = written(df.orderBy(*order_by).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before")).drop("__part", "__id", "__before")
    out._lattica_path = placed._lattica_path
    return out
