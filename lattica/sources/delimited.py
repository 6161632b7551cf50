"""Delimited text: sniffed tables, plain tables, matrices."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.dataset import Dataset, Slice

#: The sniffer looks at so many lines; the table is read whole.
LOOK = 500


def clean_name(text: str) -> str:
    """Lower case, other characters as _, no digit first."""
    name = re.sub(r"[^0-9a-z]+", "_", text.strip().lower()).strip("_") or "f"
    return f"_{name}" if name[0].isdigit() else name


def clean_names(texts: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for t in texts:
        n = clean_name(t)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


@dataclass(frozen=True)
class Dialect:
    """What a sniffer found out."""

    delimiter: str
    quote: str | None
    comment: str | None
    header: list[str] | None
    width: int


def _number(text: str) -> bool:
    try:
        float(text)
        return True
    except ValueError:
        return False


def sniff(lines: list[str]) -> Dialect:
    """Delimiter, quotes, comment sign and header of some first lines.

    The delimiter is the one that cuts most lines into the same number, over one, of fields. A header is a first row
    of texts none of which are numbers or recur below it, where some column below is numeric, or whose names are distinct
    and clean.
    """
    comment = next((c for c in "#%;" if lines and lines[0].startswith(c)), None)
    body = [x for x in lines if x.strip() and not (comment and x.startswith(comment))]
    quote = '"' if any('"' in x for x in body) else None

    def rows(delimiter: str) -> list[list[str]]:
        return list(csv.reader(body, delimiter=delimiter, quotechar='"') if quote else csv.reader(body, delimiter=delimiter, quoting=csv.QUOTE_NONE))

    best, found = (0.0, 1), "\t"
    for d in "\t,;| ":
        widths = [len(r) for r in rows(d)]
        if widths:
            common = max(set(widths), key=widths.count)
            score = (widths.count(common) / len(widths), common)
            if common > 1 and score > best:
                best, found = score, d
    table = rows(found)
    header = None
    if table:
        first, rest = table[0], table[1:]
        clean = len(set(first)) == len(first) and not any(_number(x) or not x.strip() for x in first)
        numeric = any(all(_number(r[k]) for r in rest if k < len(r) and r[k]) for k in range(len(first))) if rest else False
        recurs = any(first[k] in {r[k] for r in rest if k < len(r)} for k in range(len(first)))
        if clean and not recurs and (numeric or not rest or all(re.fullmatch(r"[A-Za-z_][\w .:-]*", x) for x in first)):
            header = first
    return Dialect(found, quote, comment, header, max((len(r) for r in table), default=1))


def read_tsv(spark: SparkSession, path: str, dialect: Dialect | None = None, fieldnames: list[str] | bool | None = None, skiprows: int = 0, rows: str = "rows") -> Dataset:
    """A table of text columns whose dialect is sniffed from its first lines. fieldnames: names, or whether the first line has them."""
    lines = [r[0] for r in spark.read.text(path).limit(LOOK + skiprows).collect()][skiprows:]
    d = dialect or sniff(lines)
    if fieldnames is True and not d.header:  # the caller knows better than the sniffer
        body = [x for x in lines if x.strip() and not (d.comment and x.startswith(d.comment))]
        head = next(csv.reader(body[:1], delimiter=d.delimiter, **({"quotechar": d.quote} if d.quote else {"quoting": csv.QUOTE_NONE})), None)
        d = replace(d, header=head)
    header = not isinstance(fieldnames, list) and fieldnames is not False
    names = fieldnames if isinstance(fieldnames, list) else d.header if header else None
    fields = clean_names(names) if names else [f"f{k}" for k in range(d.width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    reader = spark.read.schema(schema).option("sep", d.delimiter).option("header", False).option("ignoreLeadingWhiteSpace", False).option("nullValue", "\0").option("emptyValue", "")
    reader = reader.option("quote", d.quote or "\0").option("escape", d.quote or "\\")
    if d.comment:
        reader = reader.option("comment", d.comment)
    has_header = bool(header and d.header)
    if not skiprows:
        return Dataset.of(reader.option("header", has_header).csv(path), rows)  # each file's first line, whatever is in others
    kept = _after(spark, path, skiprows, has_header, d.comment).where(F.length("value") > 0)
    options = {"sep": d.delimiter, "nullValue": "\0", "emptyValue": "", "quote": d.quote or "\0", "escape": d.quote or "\\"}
    return Dataset.of(kept.select(F.from_csv("value", ", ".join(f"`{n}` STRING" for n in fields), options).alias("r")).select("r.*"), rows)


def _after(spark: SparkSession, path: str, skip: int, header: bool, comment: str | None) -> DataFrame:
    """The lines of each file after its first `skip` ones and, with a header, the next one; comments left out. A line break ends a line, also within quotes."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    starts = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min("id").alias("start"))  # one row a file
    placed = lines.join(F.broadcast(starts), "file_path").where((F.col("file_block_start") > 0) | (F.col("id") >= F.col("start") + skip))
    if comment:
        placed = placed.where(~F.col("value").startswith(comment))
    if header:
        heads = placed.where("file_block_start = 0").groupBy("file_path").agg(F.min("id").alias("head"))
        placed = placed.join(F.broadcast(heads), "file_path", "left").where(F.col("head").isNull() | (F.col("id") != F.col("head")))
    return placed.select("value")


def read_plain(spark: SparkSession, path: str, rows: str = "rows") -> Dataset:
    """Tab-separated text without a header or quotes."""
    width = max((len(r[0].split("\t")) for r in spark.read.text(path).limit(LOOK).collect()), default=1)
    return read_tsv(spark, path, Dialect("\t", None, "#", None, width), rows=rows)


def read_matrix(spark: SparkSession, path: str, row_headers: int = 1, delimiter: str = "\t", kind: str = "double") -> Dataset:
    """Row headers, and a matrix of rows by columns with the column names along its inner dim."""
    first = spark.read.text(path).first()
    names = first[0].split(delimiter) if first else []
    schema = T.StructType([T.StructField(f"f{k}", T.StringType()) for k in range(len(names))])
    df = spark.read.schema(schema).option("sep", delimiter).option("quote", "\0").option("header", True).csv(path)  # of each file the first line
    heads = clean_names([n or f"row{k}" for k, n in enumerate(names[:row_headers])])
    out = df.select(*(F.col(f"f{k}").alias(h) for k, h in enumerate(heads)), F.array(*map(F.lit, names[row_headers:])).alias("cols"), F.array(*(F.col(f"f{k}").try_cast(kind) for k in range(row_headers, len(names)))).alias("matrix"))
    return Dataset(out, [*(Slice(h, h, ("rows",)) for h in heads), Slice("cols", "cols", ("cols",)), Slice("matrix", "matrix", ("rows", "cols"))], "rows", heads)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: truth values as 1 and 0, arrays joined by commas, line breaks as spaces."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        c = c.cast("int") if isinstance(f.dataType, T.BooleanType) else F.array_join(c.cast("array<string>"), ",") if isinstance(f.dataType, T.ArrayType) else c
        out.append(F.regexp_replace(c.cast("string"), r"[\r\n\t]+", " ").alias(f.name))
    return df.select(*out)


def write_tsv(ds: Dataset, path: str, delimiter: str = "\t", header: bool = True) -> None:
    as_text(ds.toDF()).write.mode("overwrite").option("sep", delimiter).option("header", header).option("emptyValue", "").option("nullValue", "").csv(path)


def write_csv(ds: Dataset, path: str) -> None:
    write_tsv(ds, path, ",")


def write_plain(ds: Dataset, path: str) -> None:
    write_tsv(ds, path, "\t", header=False)


def write_matrix(ds: Dataset, path: str) -> None:
    """One slice of row headers and one matrix whose inner dim another slice names; a header line in each part."""
    matrix = next(s for s in ds.slices if len(s.dims) == 2)
    names = next(s for s in ds.slices if s.dims == matrix.dims[1:])
    heads = [s for s in ds.slices if s.dims == (ds.rows,)]
    head = ds.df.select(names.column).first()
    labels = [s.name for s in heads] + list(head[0] if head else [])
    columns = [*(F.col(s.column).alias(labels[k]) for k, s in enumerate(heads)), *(F.get(F.col(matrix.column), F.lit(k)).alias(n) for k, n in enumerate(labels[len(heads) :]))]
    ds.df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_xlsx(ds: Dataset, path: str, most: int = 1_000_000) -> None:
    """A small result as a sheet, where the writer's library is installed; over `most` rows is an error."""
    import openpyxl

    rows = ds.toDF().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write another format")
    book = openpyxl.Workbook()
    for k, r in enumerate([tuple(ds.Names), *map(tuple, rows)]):
        for j, x in enumerate(r):
            book.active.cell(k + 1, j + 1, x)
    book.save(path)
