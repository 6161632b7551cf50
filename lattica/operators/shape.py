"""Operators on dims: pack, unpack, flatten, split, transpose, insert, rename, measure."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.expr import Value, at_depth, fields, lifted, swapped_in

if TYPE_CHECKING:
    from lattica.dataset import Dataset


def Elems(self: Dataset, name: str | None = None) -> Dataset:
    """Array elements become a dim; a text's become its characters."""
    out = []
    for s in self.slices:
        v = self.value(s)
        if isinstance(v.type, T.ArrayType):
            v = replace(v, dims=(*v.dims, name or f"e{s.name}"), type=v.type.elementType)
        elif isinstance(v.type, T.StringType):
            column, dims = lifted([v], self.rows, lambda x: F.split(x, ""))
            v = Value(column, (*dims, name or f"e{s.name}"), T.StringType(), v.name)
        out.append((s.name, v, s.marks))
    return self.made(out)


def Array(self: Dataset, tolevel: int | None = None) -> Dataset:
    """The last dim becomes part of the elements; of the row dim alone: one row with all of it, in row order. tolevel: dims deeper than that do."""
    if tolevel is not None:
        return Level(self, tolevel) if tolevel else Array(Level(self, 1))
    if all(len(s.dims) > 1 for s in self.slices):
        return self.made([(s.name, self._packed(self.value(s)), s.marks) for s in self.slices])
    ds = self.placed()
    from lattica.dataset import Dataset, Slice

    rows = F.sort_array(F.collect_list(F.struct("__pos", *(F.col(f"`{s.column}`").alias(f"v{k}") for k, s in enumerate(ds.slices)))))
    one = ds.df.agg(rows.alias("__rows"))
    return Dataset(one.select(*(fields("__rows", f"v{k}").alias(f"c{k}") for k in range(len(ds.slices)))), [Slice(s.name, f"c{k}", ()) for k, s in enumerate(ds.slices)], None)


def Flat(self: Dataset, dim: str | None = None, name: str | None = None) -> Dataset:
    """An inner dim merged with the row dim: one row for each element; rows without elements go. Other slices are repeated."""
    inner = [d for s in self.slices for d in s.dims if d != self.rows]
    dim = dim or inner[-1]
    moved = [s for s in self.slices if dim in s.dims]
    first = {s.dims.index(dim) for s in moved}
    if max(first) > 1:  # the levels above go first
        above = next(s.dims[1] for s in moved if s.dims.index(dim) > 1)
        return Flat(Flat(self, above), dim, name)
    from lattica.dataset import Dataset, Slice

    zipped = F.arrays_zip(*(F.col(f"`{s.column}`").alias(f"z{k}") for k, s in enumerate(moved)))
    rest = [s for s in self.slices if s not in moved]
    hidden = [c for c in self.df.columns if c in self.order_by or c == "__pos"]
    order = [f"__o{k}" for k in range(len(self.order_by))]
    df = self.df.select(*(F.col(f"`{s.column}`").alias(f"r{k}") for k, s in enumerate(rest)), *(F.col(c).alias(o) for c, o in zip(self.order_by, order)), F.posexplode(zipped).alias("__in", "__z"))
    rows = name or f"{self.rows}_{dim}"
    columns, slices = [], []
    for s in self.slices:
        at = F.col("__z")[f"z{moved.index(s)}"] if s in moved else F.col(f"r{rest.index(s)}")
        columns.append(at.alias(f"c{len(columns)}"))
        slices.append(Slice(s.name, f"c{len(slices)}", tuple(rows if d == self.rows else d for d in s.dims if d != dim), s.marks))
    return Dataset(df.select(*columns, *order, *(["__in"] if order else [])), slices, rows, [*order, "__in"] if hidden and order else [])


def FlatAll(self: Dataset, name: str = "flat") -> Dataset:
    """All dims merged to one; what lacks a dim is repeated along it."""
    ds = self
    while inner := [d for d in ds.AllDims if d != ds.rows]:
        ds = Flat(ds, inner[0])
    return ds._with(rows=name, slices=[replace(s, dims=(name,)) for s in ds.slices])


def SplitDim(self: Dataset, left: int, right: int, lname: str = "split1", rname: str = "split2", dim: str | None = None) -> Dataset:
    """The row dim, or an inner one, as left times right: `right` places each. A length that doesn't fit is an error."""
    if dim not in (None, self.rows):

        def cut(a: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.lit(left - 1)), lambda j: F.slice(a, j * right + 1, F.lit(right)))
            return F.when(F.size(a) == left * right, parts).otherwise(F.raise_error(F.lit("SplitDim: sizes don't fit")))

        out = []
        for s in self.slices:
            v = self.value(s)
            if dim in v.dims:
                v = replace(v, column=at_depth(v, self.rows, dim, cut), dims=tuple(x for d in v.dims for x in ((lname, rname) if d == dim else (d,))))
            out.append((s.name, v, s.marks))
        return self.made(out)
    ds = self.placed()
    from lattica.dataset import Dataset, Slice

    rows = F.sort_array(F.collect_list(F.struct("__pos", *(F.col(f"`{s.column}`").alias(f"v{k}") for k, s in enumerate(ds.slices)))))
    df = ds.df.groupBy(F.floor(F.col("__pos") / right).cast("long").alias("__pos")).agg(rows.alias("__rows"))
    fits = (F.size("__rows") == right) & (F.col("__pos") < left)
    df = df.withColumn("__rows", F.when(fits, F.col("__rows")).otherwise(F.raise_error(F.lit("SplitDim: sizes don't fit"))))
    return Dataset(df.select("__pos", *(fields("__rows", f"v{k}").alias(f"c{k}") for k in range(len(ds.slices)))), [Slice(s.name, f"c{k}", (lname, rname, *s.dims[1:]), s.marks) for k, s in enumerate(ds.slices)], lname, ["__pos"])


def _flipped(self: Dataset, k: int) -> Dataset:
    """Two inner dims that follow each other exchanged; the arrays of the second must be as long in all places of the first."""
    out = []
    for s in self.slices:
        v = self.value(s)
        flip = lambda a: F.transform(F.sequence(F.lit(0), F.size(F.get(a, F.lit(0))) - 1), lambda j: F.transform(a, lambda r: F.get(r, j)))
        column = at_depth(v, self.rows, v.dims[k], lambda a: F.when(F.size(a) > 0, flip(a)).otherwise(a))
        out.append((s.name, replace(v, column=column, dims=(*v.dims[:k], v.dims[k + 1], v.dims[k], *v.dims[k + 2 :])), s.marks))
    return self.made(out)


def Transpose(self: Dataset, order: list[int] | tuple[int, ...] | None = None) -> Dataset:
    """The row dim and the first inner dim of all slices exchanged, through one row for each element.

    order: the places of the dims that come first, second and so on; other dims follow. Neighbours are exchanged until
    that order is there.
    """
    if order is not None:
        dims = self.slices[0].dims
        if any(s.dims != dims for s in self.slices):
            raise ValueError("Transpose: all slices need the same dims")
        now, want = list(range(len(dims))), [*order, *(k for k in range(len(dims)) if k not in order)]
        ds = self
        for to, d in enumerate(want):
            for k in range(now.index(d), to, -1):
                ds = Transpose(ds) if k == 1 else _flipped(ds, k - 1)
                now[k - 1], now[k] = now[k], now[k - 1]
        return ds
    ds = self.placed()
    from lattica.dataset import Dataset, Slice

    inner = ds.slices[0].dims[1]
    flat = ds.df.select("__pos", F.posexplode(F.arrays_zip(*(F.col(f"`{s.column}`").alias(f"z{k}") for k, s in enumerate(ds.slices)))).alias("__in", "__z"))
    rows = F.sort_array(F.collect_list(F.struct("__pos", "__z")))
    df = flat.groupBy(F.col("__in").cast("long").alias("__at")).agg(rows.alias("__rows")).withColumnRenamed("__at", "__pos")
    return Dataset(df.select("__pos", *(fields("__rows", "__z", f"z{k}").alias(f"c{k}") for k in range(len(ds.slices)))), [Slice(s.name, f"c{k}", (inner, ds.rows, *s.dims[2:]), s.marks) for k, s in enumerate(ds.slices)], inner, ["__pos"])


def SwapInner(self: Dataset, dim: str) -> Dataset:
    """An inner dim moved to the innermost place, without a shuffle."""
    return self.made([(s.name, swapped_in(self.value(s), self.rows, dim) if dim in s.dims else self.value(s), s.marks) for s in self.slices])


def InsertDim(self: Dataset, name: str) -> Dataset:
    """A new innermost dim of length one."""
    out = []
    for s in self.slices:
        v = self.value(s)
        column, dims = lifted([v], self.rows, lambda x: F.array(x))
        out.append((s.name, replace(v, column=column, dims=(*dims, name)), s.marks))
    return self.made(out)


def DimRename(self: Dataset, **names: str) -> Dataset:
    """old=new."""
    return self._with(slices=[replace(s, dims=tuple(names.get(d, d) for d in s.dims)) for s in self.slices], rows=names.get(self.rows or "", self.rows))


def Redim(self: Dataset, name: str, **dims: str) -> Dataset:
    """slice=dim pairs whose array levels are one dim from now on; rows where their lengths differ are an error."""
    sizes = [F.size(F.col(f"`{self.slice(s).column}`")) for s in dims]
    same = F.lit(True)
    for n in sizes[1:]:
        same = same & n.eqNullSafe(sizes[0])
    first = self.slice(next(iter(dims))).column
    checked = F.when(same, F.col(f"`{first}`")).otherwise(F.raise_error(F.lit("Redim: lengths differ")))
    return self._with(df=self.df.withColumn(first, checked), slices=[replace(s, dims=tuple(name if dims.get(s.name) == d else d for d in s.dims)) for s in self.slices])


def Level(self: Dataset, depth: int) -> Dataset:
    """Dims deeper than depth become part of the elements; slices with fewer dims stay."""
    out = []
    for s in self.slices:
        v = self.value(s)
        while len(v.dims) > depth:
            v = self._packed(v)
        out.append((s.name, v, s.marks))
    return self.made(out)


def Promote(self: Dataset, name: str, like: str) -> Dataset:
    """A slice repeated along the dims of another."""
    v, other = self.value(self.slice(name)), self.value(self.slice(like))
    column, dims = lifted([v, other], self.rows, lambda x, y: x)
    return self.made([(s.name, Value(column, dims, v.type, name) if s.name == name else self.value(s), s.marks) for s in self.slices])


def Shape(self: Dataset) -> Dataset:
    """One slice for each dim: its length, for each place of the dims above it. Rows are counted at once."""
    out = []
    for dim in self.AllDims:
        s = next(x for x in self.slices if dim in x.dims)
        if dim == self.rows:
            out.append((dim, Value(F.lit(self.df.count()).cast("long"), (), T.LongType()), frozenset()))
            continue
        v = self.value(s)
        v = replace(v, dims=v.dims[: v.dims.index(dim) + 1])
        out.append((dim, Value(at_depth(v, self.rows, dim, lambda a: F.size(a).cast("long")), v.dims[:-1], T.LongType()), frozenset()))
    return self.made(out)


METHODS = {f.__name__: f for f in (Elems, Array, Flat, FlatAll, SplitDim, Transpose, SwapInner, InsertDim, DimRename, Redim, Level, Promote, Shape)}
