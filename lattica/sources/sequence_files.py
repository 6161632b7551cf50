"""FASTA, FASTQ and SAM."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.dataset import Dataset

#: The mandatory SAM fields and their types.
SAM_FIELDS = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "int"), ("tlen", "int"), ("seq", "string"), ("qual", "string")]
HEADER_CUTS = ["\t", "|", ", ", ","]


def read_fasta(spark: SparkSession, path: str, sep: str | None = "auto") -> Dataset:
    """One row a record: header fields f0, f1 … cut by sep (auto: the first of tab, bar, comma that occurs), and seq."""
    # A record begins with > at the start of a line; in a header > is like other characters.
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head, seq = F.split("value", "\n", 2)[0], F.regexp_replace(F.get(F.split("value", "\n", 2), F.lit(1)), r"\s+", "")
    rows = text.select(F.trim(head).alias("head"), F.coalesce(seq, F.lit("")).alias("seq"))
    if sep == "auto":
        found = rows.select(*(F.max(F.col("head").contains(c)).alias(f"c{k}") for k, c in enumerate(HEADER_CUTS))).first()
        sep = next((c for k, c in enumerate(HEADER_CUTS) if found[k]), None)
    if not sep:
        return Dataset.of(rows.select(F.col("head").alias("f0"), "seq"), "records")
    quoted = sep.replace("|", "[|]")
    parts = rows.select(F.split("head", quoted).alias("parts"), "seq")
    width = parts.agg(F.max(F.size("parts"))).first()[0] or 1
    return Dataset.of(parts.select(*(F.get("parts", F.lit(k)).alias(f"f{k}") for k in range(width)), "seq"), "records")


def write_fasta(ds: Dataset, path: str, seq: str = "seq", width: int = 70) -> None:
    """Header fields joined by bars, the sequence in lines of `width`."""
    df = ds.toDF()
    head = F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns if c != seq))
    lines = F.trim(F.regexp_replace(F.col(seq), f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat(F.lit(">"), head, F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def read_fastq(spark: SparkSession, path: str) -> Dataset:
    """sequenceid, sequence, quality: records of four lines. A record may not lie across files."""
    from lattica.tables import positions

    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    placed = positions(lines, ["file", "id"], "line")
    rows = placed.groupBy(F.floor(F.col("line") / 4).alias("record")).agg(*(F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(n) for k, n in ((0, "h"), (1, "sequence"), (3, "quality"))))
    return Dataset.of(rows.where("sequence IS NOT NULL").select(F.expr("substring(h, 2)").alias("sequenceid"), "sequence", "quality"), "reads")


def read_sam(spark: SparkSession, path: str) -> Dataset:
    """The 11 mandatory fields, typed, and the optional ones as text; header and short lines are left out."""
    parts = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t", 12).alias("p")).where(F.size("p") >= 11)
    return Dataset.of(parts.select(*(F.get("p", F.lit(k)).cast(t).alias(n) for k, (n, t) in enumerate(SAM_FIELDS)), F.get("p", F.lit(11)).alias("optional")), "alignments")


def write_sam(ds: Dataset, path: str) -> None:
    df = ds.toDF()
    fields = [n for n, _ in SAM_FIELDS] + ["optional"] * ("optional" in df.columns)
    df.select(F.concat_ws("\t", *(F.col(n).cast("string") for n in fields)).alias("value")).write.mode("overwrite").text(path)
