"""Set operations and stacking of datasets."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.types import common_type

if TYPE_CHECKING:
    from lattica.dataset import Dataset


def _aligned(sources: tuple[Dataset, ...], by: str, missing: bool = False, slices: tuple | None = None) -> tuple[list[DataFrame], list[str]]:
    """Frames with the same columns in common types: by place, or by name (missing: absent ones become null).

    slices: for each source the name, or names, of the slices to take; they go together by place.
    """
    if slices is not None:
        sources, by = tuple(s.Get(*([names] if isinstance(names, str) else names)) for s, names in zip(sources, slices, strict=True)), "pos"
    frames = [s.toDF() for s in sources]
    if by == "pos":
        if len({len(f.columns) for f in frames}) > 1:
            raise ValueError("different numbers of slices: select them, or go by name")
        names = frames[0].columns
        frames = [f.toDF(*names) for f in frames]
    elif missing:
        names = list(dict.fromkeys(n for f in frames for n in f.columns))
    else:
        names = [n for n in frames[0].columns if all(n in f.columns for f in frames)]
    out = []
    for f in frames:
        columns = []
        for n in names:
            t = reduce(common_type, (g.schema[n].dataType for g in frames if n in g.columns))
            columns.append((F.col(f"`{n}`") if n in f.columns else F.lit(None)).cast(t).alias(n))
        out.append(f.select(*columns))
    return out, names


def _made(self: Dataset, df: DataFrame, names: list[str], rows: str) -> Dataset:
    from lattica.dataset import Dataset

    return Dataset.of(df, rows, unpack=False)


def Union(self: Dataset, *others: Dataset, by: str = "pos", slices: tuple | None = None) -> Dataset:
    frames, names = _aligned((self, *others), by, slices=slices)
    return _made(self, reduce(DataFrame.union, frames).distinct(), names, "s" + str(self.rows))


def Intersect(self: Dataset, *others: Dataset, by: str = "pos", slices: tuple | None = None) -> Dataset:
    frames, names = _aligned((self, *others), by, slices=slices)
    return _made(self, reduce(DataFrame.intersect, frames), names, "s" + str(self.rows))


def Except(self: Dataset, *others: Dataset, by: str = "pos", slices: tuple | None = None) -> Dataset:
    frames, names = _aligned((self, *others), by, slices=slices)
    return _made(self, reduce(DataFrame.subtract, frames), names, "s" + str(self.rows))


def Difference(self: Dataset, other: Dataset, by: str = "pos", slices: tuple | None = None) -> Dataset:
    """What exactly one of both has: rows are marked by side and grouped once."""
    (a, b), names = _aligned((self, other), by, slices=slices)
    both = a.select("*", F.lit(0).alias("__side")).union(b.select("*", F.lit(1).alias("__side")))
    return _made(self, both.groupBy(*names).agg(F.min("__side").alias("x"), F.max("__side").alias("y")).where("x = y").select(*names), names, "s" + str(self.rows))


def Stack(self: Dataset, *others: Dataset, by: str = "pos", stack_missing: bool = False) -> Dataset:
    """All rows of all sources; stack_missing: slices that a source lacks are missing there."""
    frames, names = _aligned((self, *others), by, stack_missing)
    return _made(self, reduce(DataFrame.union, frames), names, "stack")


METHODS = {"Union": Union, "Intersect": Intersect, "Except": Except, "Difference": Difference, "Stack": Stack}
