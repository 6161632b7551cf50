"""A training corpus from documents: toxic and bad texts go, near copies go, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import fewer_files, free_prefix, read, spent, spread_join, written
from lattica.llm.near_dups import MOST_BROADCAST, near_dups
from lattica.llm.packing import packed
from lattica.llm.quality_rules import quality_rules
from lattica.llm.toxicity import toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that operator 7 doesn't call toxic; scores come in the same pass as the rows.

    Null and empty texts get the score of no evidence and stay unless that alone is toxic; null ids are scored like
    others; repeated rows get equal scores and go or stay together; a score at the threshold is toxic. A very long text
    is read whole. An empty table stays empty. Columns keep their names, whatever they are.
    """
    rated = toxicity(docs, read(spark, sf_dir, "labels"), training=read(spark, sf_dir, "documents"), keep_columns=True)
    return rated.where(F.col(rated.columns[-1]) == 0).select(*docs.columns)


def without_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that operator 5 keeps.

    Null, empty and blank texts have no words and go; a null id changes nothing; repeated rows go or stay together; a
    measure at its limit is good. A very long text is read whole. An empty table stays empty. Columns keep their names,
    whatever they are.
    """
    judged = quality_rules(docs, keep_columns=True)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group of operator 4, five words a shingle and a similarity of 0.8.

    Rows are numbered and grouped by their texts, whatever their ids: repeated rows and rows without an id are copies
    like others, two texts under one id aren't. The least id stays, of equal ones any one row; a row without an id stays
    only where its group has no id. Null, empty and blank texts are linked with nothing: those rows all stay. An empty
    table stays empty. A very long text is read whole. Columns keep their names, whatever they are.
    """
    row = free_prefix(docs.columns, "row_")
    docs_by_row = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_dups(docs_by_row.select(F.col(row).alias("doc_id"), "text"), size=5, percent=80)
    found = written(found.where("n_shingles > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias("group")), "found")
    total = found.count()
    sizes = written(fewer_files(found.groupBy("group").agg(F.count(row).alias("k")).where("k > 1"), total // 2), "sizes")
    grouped = spread_join(found.select(row, "group"), sizes.select("group"), "group", sizes, total)
    members = written(fewer_files(grouped.join(docs_by_row.select(row, "doc_id"), row).select(row, "group", "doc_id"), total), "members")
    stay = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))[row].alias("stays"))
    gone = spread_join(members, stay, "group", sizes, total).where(F.col(row) != F.col("stays")).select(row)
    gone = written(fewer_files(gone, total), "gone")
    few = F.broadcast if gone.count() <= MOST_BROADCAST else lambda x: x
    spent(found, sizes, members)
    return docs_by_row.join(few(gone), row, "left_anti").select(*docs.columns)


def into_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces in sequences, by operator 6.

    A null or empty text is one end token; a null id stays null; repeated rows are documents of their own; a very long
    text fills whole sequences; an empty table gives no rows. Other columns aren't read.
    """
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", without_toxic), ("quality rules", without_bad), ("near duplicates", without_copies), ("packing", into_windows)]
#: The learned filter and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(out, f"stage-{k}")
    return out
