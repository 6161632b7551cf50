"""Round trips through formats: files are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from lattica.expr import _
from lattica.plans.tables import Registry
from lattica.sources import read, write
from lattica.tables import shared_dir

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


def _back(ds, extension: str, **options):
    """The dataset written in a format and read again; the folder goes when the driver's JVM ends."""
    spark = ds.df.sparkSession
    path = f"{shared_dir(spark)}/lattica-trip-{uuid.uuid4().hex}.{extension}"
    write(ds, path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return read(spark, path, **options)


@_r.add("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_sniff(t):
    return _back(t("customer"), "tsv", detect=True)


@_r.add("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def save_load(t):
    return _back(t("nation").Get("n_name", "n_nationkey", "n_regionkey"), "parquet")


@_r.add("SELECT CAST(p_partkey AS VARCHAR) AS f0, p_brand AS f1, replace(p_type, ' ', '') AS seq FROM part")
def fasta_roundtrip(t):
    return _back(t("part").Get("p_partkey", "p_brand", seq=_.p_type), "fasta")


@_r.add("SELECT CAST(vec_id AS VARCHAR) AS vec_id, embedding[1:4] AS matrix FROM embeddings")
def matrix_roundtrip(t):
    m = t("embeddings").Get("vec_id", matrix=_.embedding[0:4])
    named = m.AddSlice("cols", ["a", "b", "c", "d"])
    named = named._with(slices=[s if s.name != "cols" else type(s)("cols", s.column, m.slice("matrix").dims[1:]) for s in named.slices])
    return _back(named.Get("vec_id", "cols", "matrix"), "tsv_matrix", kind="float").Get("vec_id", "matrix")


@_r.add("SELECT CAST(vec_id AS VARCHAR) AS vec_id, embedding AS matrix FROM embeddings")
def matrix_roundtrip_whole(t):
    from pyspark.sql import functions as F

    m = t("embeddings").Get("vec_id", matrix=_.embedding)
    width = m.df.agg(F.max(F.size(m.slice("matrix").column))).first()[0] or 0
    named = m.AddSlice("cols", [f"c{k}" for k in range(width)])
    named = named._with(slices=[s if s.name != "cols" else type(s)("cols", s.column, m.slice("matrix").dims[1:]) for s in named.slices])
    return _back(named.Get("vec_id", "cols", "matrix"), "tsv_matrix", kind="float").Get("vec_id", "matrix")


@_r.add("""SELECT 'chr' || n_regionkey AS seqname, CAST(n_nationkey * 10 + 1 AS BIGINT) AS start, CAST(n_nationkey * 10 + 9 AS BIGINT) AS "end", n_name AS name FROM nation""")
def gff_roundtrip(t):
    from pyspark.sql import functions as F

    df = t("nation").df.select(
        F.concat(F.lit("chr"), F.col("n_regionkey")).alias("seqname"), F.lit("x").alias("source"), F.lit("gene").alias("feature"), (F.col("n_nationkey") * 10 + 1).alias("start"), (F.col("n_nationkey") * 10 + 9).alias("end"),
        F.lit(None).cast("double").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("frame"), F.create_map(F.lit("Name"), "n_name").alias("attr"),
    )
    from lattica.dataset import Dataset

    return _back(Dataset.of(df, "features"), "gff").Get("seqname", "start", "end", "name")
