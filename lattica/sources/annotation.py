"""GFF3, MAF and VCF."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.dataset import Dataset, Slice

#: The columns of GFF3 lines and of VCF lines.
GFF = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]
VCF = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
VCF_TYPES = {"Integer": "int", "Float": "double", "Flag": "boolean"}


def _lines(spark: SparkSession, path: str, fields: int):
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(F.split("value", "\t").alias("p")).where(F.size("p") >= fields)


def read_gff(spark: SparkSession, path: str) -> Dataset:
    """seqname, source, id, parent, name, feature, start, end, score, strand, frame, attr (a map)."""
    p = lambda k: F.when(F.get("p", F.lit(k)) != ".", F.get("p", F.lit(k)))
    pairs = F.filter(F.split(F.get("p", F.lit(8)), ";"), lambda x: x.contains("="))
    attr = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]), F.url_decode(F.split(x, "=", 2)[1]))))
    rows = _lines(spark, path, 9).withColumn("attr", attr)
    at = lambda n: F.try_element_at("attr", F.lit(n))
    return Dataset.of(
        rows.select(p(0).alias("seqname"), p(1).alias("source"), at("ID").alias("id"), at("Parent").alias("parent"), at("Name").alias("name"), p(2).alias("feature"), p(3).cast("long").alias("start"), p(4).cast("long").alias("end"), p(5).cast("double").alias("score"), p(6).alias("strand"), p(7).cast("int").alias("frame"), "attr"), "features",
    )


def write_gff(ds: Dataset, path: str) -> None:
    """The inverse of read_gff."""
    df = ds.toDF()
    dot = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("."))
    attributes = F.array_join(F.transform(F.map_entries("attr"), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), ";")
    df.select(F.concat_ws("\t", *(dot(n) for n in GFF[:-1]), attributes).alias("value")).write.mode("overwrite").text(path)


def read_maf(spark: SparkSession, path: str) -> Dataset:
    """One row an alignment block: score, and its sequences' src, start, size, strand, src_size, text along an inner dim."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.split("value", "\n").alias("lines"))
    blocks = blocks.where(F.exists("lines", lambda x: x.startswith("a")))
    score = F.regexp_extract(F.get(F.filter("lines", lambda x: x.startswith("a")), F.lit(0)), r"score=(\S+)", 1)
    rows = blocks.select(score.try_cast("double").alias("score"), F.transform(F.filter("lines", lambda x: x.startswith("s")), lambda x: F.split(F.trim(x), r"\s+")).alias("s"))
    names = [("src", "string"), ("start", "long"), ("size", "long"), ("strand", "string"), ("src_size", "long"), ("text", "string")]
    pick = lambda k, t: F.transform("s", lambda x: F.get(x, F.lit(k + 1)).cast(t))
    df = rows.select("score", *(pick(k, t).alias(n) for k, (n, t) in enumerate(names)))
    return Dataset(df, [Slice("score", "score", ("blocks",)), *(Slice(n, n, ("blocks", "seqs")) for n, _ in names)], "blocks")


def _described(header: list[str], kind: str) -> dict[str, tuple[str, str]]:
    """Of ##INFO and ##FORMAT lines: number and type by id."""
    import re

    out = {}
    for line in header:
        m = re.match(rf"##{kind}=<ID=([^,]+),Number=([^,]+),Type=([^,]+)", line)
        if m:
            out[m[1]] = m[2], m[3]
    return out


def read_vcf(spark: SparkSession, path: str) -> Dataset:
    """Variants: fixed fields (qual as an error probability), INFO fields, and FORMAT fields along the dim of samples.

    Fields of number 1 or 0 are single values, others arrays.
    """
    header = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]  # the header, not the data
    samples = next((h.split("\t")[9:] for h in header if h.startswith("#CHROM")), [])
    p = lambda k: F.get("p", F.lit(k))
    some = lambda c: F.when(c != ".", c)
    rows = _lines(spark, path, 8)
    info = F.map_from_entries(F.transform(F.split(p(7), ";"), lambda x: F.struct(F.split(x, "=", 2)[0], F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("true")))))
    rows = rows.withColumn("i", F.when(p(7) != ".", info))

    def typed(value, number: str, kind: str):
        t = VCF_TYPES.get(kind, "string")
        if number in ("0", "1"):
            return some(value).try_cast(t)
        return F.transform(F.split(some(value), ","), lambda x: some(x).try_cast(t))

    columns = [p(0).alias("chrom"), p(1).cast("long").alias("pos"), F.split(some(p(2)), ";").alias("id"), p(3).alias("ref"), F.split(some(p(4)), ",").alias("alt"), F.pow(F.lit(10.0), -some(p(5)).try_cast("double") / 10).alias("qual"), F.split(some(p(6)), ";").alias("filter")]
    slices = [("chrom", ()), ("pos", ()), ("id", ("ids",)), ("ref", ()), ("alt", ("alt_alleles",)), ("qual", ()), ("filter", ("filters",))]
    for name, (number, kind) in _described(header, "INFO").items():
        columns.append(typed(F.try_element_at("i", F.lit(name)), number, kind).alias(f"info_{name.lower()}"))
        slices.append((f"info_{name.lower()}", () if number in ("0", "1") else (f"n_{name.lower()}",)))
    for name, (number, kind) in _described(header, "FORMAT").items() if samples else ():
        each = lambda x, name=name: F.try_element_at(F.map_from_arrays(F.slice(F.split(p(8), ":"), F.lit(1), F.size(F.split(x, ":"))), F.split(x, ":")), F.lit(name))
        values = F.array(*(typed(each(p(9 + k)), number, kind) for k in range(len(samples))))
        columns.append(values.alias(f"fmt_{name.lower()}"))
        slices.append((f"fmt_{name.lower()}", ("samples",) if number in ("0", "1") else ("samples", f"n_{name.lower()}")))
    columns.append(F.array(*map(F.lit, samples)).cast(T.ArrayType(T.StringType())).alias("sample_names"))
    df = rows.select(*columns)
    return Dataset(df, [*(Slice(n, n, ("variants", *d)) for n, d in slices), Slice("sample_names", "sample_names", ("samples",))], "variants", ["chrom", "pos"])
