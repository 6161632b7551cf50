"""Filters: by condition, by place, by list of places, by window of places; along rows or along an inner dim."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.expr import Expr, Value, lifted

if TYPE_CHECKING:
    from lattica.dataset import Dataset


def filtered(ds: Dataset, condition: Any, dim: str | int | None = None, mode: str | None = None) -> Dataset:
    """A condition keeps what it holds for along its last dim; missing counts as false. Places select along `dim`.

    dim: a name, or a place in the order of dims; None: the last dim that all slices share. Slices without the dim stay as
    they are. Lists of places along an inner dim have two modes. "pos", the default: the list's last dim goes along the
    dim above, so each place there gets a pick of its own, and a further level of lists becomes a dim in front. "dim":
    every place above gets all of the list's picks. A place that isn't there is an error.
    """
    if isinstance(dim, int):
        dim = ds.AllDims[dim]
    if isinstance(condition, (int, slice, list, tuple)) and not isinstance(condition, bool):
        shared = [d for d in ds.slices[0].dims if all(d in s.dims for s in ds.slices)]
        dim = dim or shared[-1]
        if dim == ds.rows:
            return _rows(ds, condition)
        if isinstance(condition, (list, tuple)) and mode in (None, "pos"):
            return _each_place(ds, list(condition), dim)
        return ds.made([(s.name, _picked(ds, s, condition, dim), s.marks) for s in ds.slices])
    c = ds.compile(condition)
    along = c.dims[-1]
    if along == ds.rows:
        return ds._with(df=ds.df.where(c.column))
    return ds.made([(s.name, ds._kept(ds.value(s), c), s.marks) for s in ds.slices])


def _depth(key: Any) -> int:
    return 1 + max(map(_depth, key), default=0) if isinstance(key, (list, tuple)) else 0


def _each_place(ds: Dataset, key: list, dim: str) -> Dataset:
    """Picks along an inner dim, one for each place of the dim above it; of a list of lists all of them, along a new dim in front."""
    if _depth(key) > 2:
        raise ValueError("Filter: a list of places has one or two levels")
    several = key if _depth(key) == 2 else [key]
    above = next(s.dims[s.dims.index(dim) - 1] for s in ds.slices if dim in s.dims)
    if above == ds.rows:
        ds = ds.placed()
        n = ds.df.count()
        if any(len(k) != n for k in several):
            raise ValueError(f"Filter: {[len(k) for k in several]} places for {n} rows")
    out = []
    for s in ds.slices:
        v = ds.value(s)
        if dim not in v.dims:
            out.append((s.name, v, s.marks))
            continue
        cut = v.dims.index(dim)
        packed = replace(v, dims=v.dims[:cut], type=T.ArrayType(v.type))
        picks = []
        for own in several:
            place = F.array(*(F.lit(int(i)) for i in own))
            at = Value(F.get(place, F.col("__pos")), (ds.rows,), T.LongType()) if above == ds.rows else Value(place, (above,), T.LongType())
            picks.append(lifted([packed, at], ds.rows, _pick))
        if _depth(key) == 1:
            out.append((s.name, replace(v, column=picks[0][0], dims=picks[0][1] + v.dims[cut + 1 :]), s.marks))
        else:
            column = F.array(*(c for c, _ in picks))
            if len(picks[0][1]) > 1:
                raise ValueError("Filter: a list of lists needs the dim above to be the row dim")
            out.append((s.name, replace(v, column=column, dims=(*picks[0][1], f"f{dim}", *v.dims[cut + 1 :])), s.marks))
    made = ds.made(out)
    return made.Transpose() if _depth(key) == 2 else made


def _pick(a: Any, i: Any) -> Any:
    """One element by its place, from behind where that is negative."""
    known = F.when(i.isNull(), F.raise_error(F.lit("Filter: fewer places than there are arrays"))).otherwise(i)
    return F.element_at(a, F.when(known >= 0, known + 1).otherwise(known).cast("int"))


def _picked(ds: Dataset, s: Any, key: Any, dim: str) -> Any:
    v = ds.value(s)
    if dim not in v.dims:
        return v
    if v.dims[-1] == dim:
        return ds._at(Expr("at", (Expr("value", (v,)), key)))
    # A level with others below it: its arrays are elements for the moment.
    inner = list(v.dims)
    cut = inner.index(dim) + 1
    shallow = replace(v, dims=tuple(inner[:cut]))
    got = ds._at(Expr("at", (Expr("value", (shallow,)), key)))
    return replace(got, dims=got.dims + tuple(inner[cut:]))


def _rows(ds: Dataset, key: Any) -> Dataset:
    """Rows by place."""
    if isinstance(key, slice) and (key.start or 0) >= 0 and (key.stop or 0) >= 0 and key.step in (None, 1) and ds.order_by and key.stop is not None:
        # The first rows by order: a top-k, not a sort of all.
        return ds._with(df=ds.df.orderBy(*ds.order_by).offset(key.start or 0).limit(key.stop - (key.start or 0)))
    ds = ds.placed()
    place = F.col("__pos")
    if isinstance(key, slice):
        n = None
        if (key.start or 0) < 0 or (key.stop or 0) < 0:
            n = ds.df.count()
        start, stop, step = key.start or 0, key.stop, key.step or 1
        start = start + n if start < 0 else start
        stop = stop + n if stop is not None and stop < 0 else stop
        kept = (place >= start) & ((place - start) % step == 0)
        return ds._with(df=ds.df.where(kept if stop is None else kept & (place < stop)))
    n = ds.df.count()
    for k in key if isinstance(key, (list, tuple)) else [key]:
        if not isinstance(k, int):
            raise TypeError("rows by place: a number, a list of numbers or a window")
        if not -n <= k < n:
            raise IndexError(f"place {k} of {n} rows")
    if isinstance(key, int):
        df = ds.df.where(place == (key if key >= 0 else n + key))
        return ds._with(df=df, slices=[replace(s, dims=tuple(d for d in s.dims if d != ds.rows)) for s in ds.slices], rows=None)
    key = [k if k >= 0 else n + k for k in key]
    wanted = ds.df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(key)], "__k long, __p long")
    df = ds.df.withColumnRenamed("__pos", "__was").join(F.broadcast(wanted), F.col("__was") == F.col("__p")).drop("__was", "__p")  # a literal list
    new = f"f{ds.rows}"
    return ds._with(df=df.withColumnRenamed("__k", "__pos"), slices=[replace(s, dims=tuple(new if d == ds.rows else d for d in s.dims)) for s in ds.slices], rows=new, order_by=["__pos"])


def indexed(ds: Dataset, key: Any) -> Dataset:
    """ds[condition], ds[place], ds[a:b], ds[[places]], ds[rows, inner, …]: the last axis is applied first."""
    if not isinstance(key, tuple):
        if isinstance(key, (int, slice, list)):
            return filtered(ds, key, ds.rows)
        return filtered(ds, key)
    dims = ds.AllDims
    if Ellipsis in key:
        at = key.index(Ellipsis)
        key = (*key[:at], *[slice(None)] * (len(dims) - len(key) + 1), *key[at + 1 :])
    for dim, k in list(zip(dims, key))[::-1]:
        if k != slice(None):
            ds = filtered(ds, k, dim) if not isinstance(k, Expr) else filtered(ds, k)
    return ds
