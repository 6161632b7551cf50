"""Pearson correlations of an array column's places over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of each pair of places: rows that have both, means, sums of squares and products about the means, rows with a value that isn't finite.
_PARTS = ["n", "mx", "my", "xx", "yy", "xy", "bad"]
_ROWS = "i long, j long, " + ", ".join(f"{p} double" for p in _PARTS)


def _table(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The arrays as rows of `width` places, and which places have a value."""
    lists = batch.column(0)
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = place < width
    x, has = np.zeros((len(size), width)), np.zeros((len(size), width), bool)
    x[row[inside], place[inside]] = pa.compute.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)[inside]
    has[row[inside], place[inside]] = flat.is_valid().to_numpy(zero_copy_only=False)[inside]
    return x, has


def _sums(x: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The parts of all pairs of places; values are taken relative to each place's first and then to the mean, so large ones don't cancel."""
    finite = np.isfinite(x)
    v, ok = has.astype(float), has & finite
    first = x[ok.argmax(axis=0), np.arange(x.shape[1])]
    first = np.where(ok.any(axis=0), first, 0)
    x = np.where(ok, x - first, 0)
    mean = x.sum(axis=0) / np.maximum(ok.sum(axis=0), 1)
    x = np.where(ok, x - mean, 0)
    n, s, q, odd = v.T @ v, x.T @ v, (x * x).T @ v, (has & ~finite).astype(float).T @ v
    many, shift = np.maximum(n, 1), (first + mean)[:, None]
    return np.stack([n, shift + s / many, shift.T + s.T / many, q - s * s / many, q.T - s.T * s.T / many, x.T @ x - s * s.T / many, odd + odd.T])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The parts of two disjoint sets of rows together."""
    n = np.maximum(a[0] + b[0], 1)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return np.stack([a[0] + b[0], a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w, a[6] + b[6]])


def correlations(df: DataFrame, name: str, width: int | None = None) -> DataFrame:
    """i, j, r of all pairs of places, or of the first `width`; without a width it is the longest array's length.

    Each task gives the sums of all pairs once, so rows aren't multiplied. A pair goes by the rows that have both of its
    places; r is null where fewer than two do or one of them doesn't vary, NaN where a value isn't finite.
    """
    if width is None:
        width = df.agg(F.max(F.size(name))).first()[0] or 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for batch in batches:
            if batch.num_rows and width > 0:
                own = _sums(*_table(batch, width))
                all_ = own if all_ is None else _joined(all_, own)
        if all_ is not None:
            for i in range(width):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width, i)), pa.array(np.arange(width)), *map(pa.array, all_[:, i])], ["i", "j", *_PARTS])

    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by("j")
        found = np.stack([table[p].to_numpy().reshape(width, -1).T for p in _PARTS], 1)
        all_ = found[0]
        for own in found[1:]:
            all_ = _joined(all_, own)
        n, _, _, xx, yy, xy, bad = all_
        known = (n > 1) & ((xx > 0) & (yy > 0) | (bad > 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where(bad > 0, np.nan, np.clip(xy / np.sqrt(xx) / np.sqrt(yy), -1, 1))
        return pa.table({"i": pa.array(np.full(width, table["i"][0].as_py())), "j": pa.array(np.arange(width)), "r": pa.array(r, mask=~known)})

    arrays = df.select(F.col(name).cast("array<double>").alias("x"))
    return arrays.mapInArrow(parts, _ROWS).groupBy("i").applyInArrow(rows, "i long, j long, r double")
