"""What the operators of this subpackage share: word rules, batches, sampling, and the library's shared tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.tables import shared_dir, spent, written

__all__ = ["WORD_GAP", "ascii_lower", "crc_of", "fewer_files", "free_prefix", "kept_for", "let", "null_as", "read", "sampled", "spread_join", "shared_dir", "sliced", "spent", "texts_of", "tidy", "written"]

#: The characters that separate words.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of(column: str | Column) -> Column:
    """crc32 of the decimal text of a column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary"))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_as(text: str | Column) -> Column:
    """Null texts as empty ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit(""))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The strings of an Arrow column; null: empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about most_bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def sampled(df: DataFrame, keys: list[str], by: str, most: tuple[int, ...]) -> DataFrame:
    """Of the rows of class 0, 1 … in column `by`, the most[class] whose hashed keys come first: as good as random, and stable."""
    parts = [df.where(F.col(by) == c).orderBy(F.xxhash64(*keys), *keys).limit(n) for c, n in enumerate(most)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_kept: dict[str, dict[str, Any]] = {}


def kept_for(operator: str) -> dict[str, Any]:
    """What a Python process keeps between tasks for an operator; what it kept for others goes."""
    for other in [x for x in _kept if x != operator]:
        del _kept[other]
    return _kept.setdefault(operator, {})


def tidy(operator: str) -> Callable:
    """Decorator of an operator's work on batches: processes serve one operator after another, so at a task's end free memory goes back to the system."""

    def around(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
        @functools.wraps(run)
        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept_for(operator)
            try:
                yield from run(batches)
            finally:
                pa.default_memory_pool().release_unused()
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim:
                    trim(0)

        return out

    return around


def fewer_files(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in as many partitions as this many rows need, where that is fewer than a shuffle's: small tables get few files."""
    n = max(1, -(-rows // each))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, where a key has one row, so that no task gets all of a key's rows.

    counts: key and k, the number of rows of left that it has; total: that of all keys. A key with more than a
    partition's share is hot: its rows of left are dealt by a hash of all columns, and its row of right goes along to
    each place. Fewer keys than partitions can be hot, so they are broadcast.
    """
    each = max(256, total // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = counts.where(F.col("k") > each).select(key, F.ceil(F.col("k") / each).cast("int").alias("salts"))
    if found.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(found)
    dealt = left.join(hot, key, "left").withColumn("salts", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), "salts").cast("int")))
    along = right.join(hot, key, "left").withColumn("salts", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return dealt.join(along, [key, "salts"], how).drop("salts")


def free_prefix(columns: list[str], prefix: str) -> str:
    """The prefix, longer by underscores while a column's name begins with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z as a-z; other letters stay."""
    return text.encode("utf-8", "replace").lower()
