"""Grouping. A group keeps its rows as they are until something asks for arrays; reductions become one aggregate.

Missing keys form one group (missing="one"), or a group for each row (missing="each").
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.expr import Expr, Value, fields, lifted
from lattica.functions import ELEMENTS, REDUCTIONS

if TYPE_CHECKING:
    from lattica.dataset import Dataset


class _Aggregates:
    """The reductions in expressions over a group, gathered so that one aggregate makes them all."""

    def __init__(self, ds: Dataset, keys: dict[str, Column]):
        self.ds, self.keys, self.made = ds, keys, []

    def needs_places(self, e: Any) -> bool:
        """Whether the places themselves are asked for; where only their order counts, the columns that order rows do."""
        return isinstance(e, Expr) and (e.kind in REDUCTIONS and REDUCTIONS[e.kind].needs_places and e.kind != "first" or any(map(self.needs_places, e.args)))

    def value(self, e: Any) -> Value:
        """An expression over groups: keys as they are, reductions of rows as references to aggregates."""
        if not isinstance(e, Expr):
            return self.ds.compile(e)
        if e.kind == "ref" and e.args[0] in self.keys:
            v = self.ds.value(self.ds.slice(e.args[0]))
            return replace(v, column=F.col(f"`{e.args[0]}`"), dims=("groups",))
        if e.kind in REDUCTIONS:
            v = self.ds.compile(e.args[0])
            r = REDUCTIONS[e.kind]
            if any(d != self.ds.rows for d in v.dims):
                raise ValueError("reduce inner dims before rows")
            t = r.result(v.type)
            x = v.column.cast("int") if isinstance(v.type, T.BooleanType) and e.kind in ("sum", "prod", "mean", "std", "median", "max", "min") else v.column
            if e.kind == "sum" and isinstance(v.type, (T.ArrayType, T.StringType)):
                column = _joined(x, order_of(self.ds), v.type)
            else:
                column = r.rows(x, order_of(self.ds) if e.kind == "first" else F.col("__pos") if r.needs_places else F.lit(0))
            name = f"__a{len(self.made)}"
            self.made.append(column.cast(t).alias(name))
            return Value(F.col(name), ("groups",), t, e.label or e.kind)
        if e.kind in ELEMENTS:
            n, body = ELEMENTS[e.kind]
            values = [self.value(a) for a in e.args[:n]]
            types: list[T.DataType] = []

            def over(*columns: Column) -> Column:
                column, t = body(*columns, *(v.type for v in values), *e.args[n:], **e.options)
                types.append(t)
                return column

            column, dims = lifted(values, "groups", over)
            return Value(column, dims, types[-1], e.label or "result")
        raise ValueError(f"{e.kind} can't be worked out over a group")


def order_of(ds: Dataset) -> Column:
    """What rows are ordered by, as one value: as good as places where only the order counts, and there without a sort of all rows."""
    if "__pos" in ds.df.columns:
        return F.col("__pos")
    if not ds.order_by:
        raise ValueError("this needs an order of rows: give the dataset an order_by that orders rows totally")
    return F.struct(*(F.col(f"`{c}`") for c in ds.order_by))


def _joined(x: Column, place: Column, t: T.DataType) -> Column:
    """Texts or arrays of a group, one after the other by place."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), x.alias("x")))), lambda s: s["x"])
    return F.flatten(parts) if isinstance(t, T.ArrayType) else F.array_join(parts, "")


def reduced(ds: Dataset, keys: list[str], sel: tuple, named: dict[str, Any], having: Expr | None = None, missing: str = "one") -> Dataset:
    """One aggregate over rows, by keys: slices of keys and of expressions over groups."""
    from lattica.dataset import Dataset, Slice

    key_columns = {k: ds.value(ds.slice(k)).column for k in keys}
    wanted = [(getattr(e, "label", None) or (e if isinstance(e, str) else "result"), Expr("ref", (e,), label=e) if isinstance(e, str) else e) for e in sel] + list(named.items())
    gathered = _Aggregates(ds, key_columns)
    if any(gathered.needs_places(e) for _, e in wanted) or gathered.needs_places(having):
        ds = gathered.ds = ds.placed()
    values = [(n, gathered.value(e)) for n, e in wanted]
    keep = gathered.value(having).column if having is not None else None
    by = [c.alias(k) for k, c in key_columns.items()]
    if missing == "each":  # a row with a missing key is a group of its own
        absent = F.lit(False)
        for c in key_columns.values():
            absent = absent | c.isNull()
        by.append(F.when(absent, F.monotonically_increasing_id()).alias("__own"))
    groups = ds.df.groupBy(*by) if by else ds.df.groupBy()
    df = groups.agg(*(gathered.made or [F.count(F.lit(1)).alias("__n")]))
    if keep is not None:
        df = df.where(keep)
    df = df.select(*(v.column.alias(f"c{k}") for k, (_, v) in enumerate(values)))
    rows = f"g{keys[0]}" if keys else None
    dims = (rows,) if rows else ()
    return Dataset(df, [Slice(n, f"c{k}", dims) for k, (n, _) in enumerate(values)], rows, [f"c{k}" for k, (n, _) in enumerate(values) if n in keys])


@dataclass(frozen=True)
class Grouped:
    """Rows grouped by key slices. flat: slices of which a group keeps its first value."""

    ds: Dataset
    keys: tuple[str, ...]
    flat: tuple[str, ...] = ()
    missing: str = "one"

    def Get(self, *sel: Any, **named: Any) -> Dataset:
        """Keys, and expressions over groups."""
        return reduced(self.ds, list(self.keys), sel, named, None, self.missing)

    def Having(self, condition: Expr) -> Grouped:
        """The groups for which a condition over reductions holds, with their rows: a semi join with the keys."""
        kept = reduced(self.ds, list(self.keys), self.keys, {}, condition)
        right = kept.df.toDF(*(f"__k{i}" for i in range(len(self.keys))))
        on = [self.ds.value(self.ds.slice(k)).column.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
        return replace(self, ds=self.ds._with(df=self.ds.df.join(right, on, "left_semi")))

    __getitem__ = Having

    def Flat(self) -> Dataset:
        """The rows again."""
        return self.ds

    def Arrays(self) -> Dataset:
        """One row a group; other slices become arrays in row order, those of `flat` their first value."""
        from lattica.dataset import Dataset, Slice

        ds = self.ds.placed()
        others = [s for s in ds.slices if s.name not in self.keys]
        packed = F.sort_array(F.collect_list(F.struct(F.col("__pos"), *(F.col(f"`{s.column}`").alias(f"v{k}") for k, s in enumerate(others)))))
        df = ds.df.groupBy(*(ds.value(ds.slice(k)).column.alias(f"k{i}") for i, k in enumerate(self.keys))).agg(packed.alias("__rows"))
        rows, inner = f"g{'_'.join(self.keys)}", f"g{ds.rows}"
        columns = [F.col(f"k{i}") for i in range(len(self.keys))]
        slices = [Slice(k, f"k{i}", (rows,)) for i, k in enumerate(self.keys)]
        for k, s in enumerate(others):
            if s.name in self.flat:
                columns.append(F.get("__rows", F.lit(0))[f"v{k}"].alias(f"a{k}"))
                slices.append(Slice(s.name, f"a{k}", (rows, *(d for d in s.dims if d != ds.rows))))
            else:
                columns.append(fields("__rows", f"v{k}").alias(f"a{k}"))
                slices.append(Slice(s.name, f"a{k}", (rows, inner, *(d for d in s.dims if d != ds.rows))))
        return Dataset(df.select(*columns), slices, rows, [f"k{i}" for i in range(len(self.keys))])

    def Index(self, name: str = "index") -> Dataset:
        """The keys, and for each group the places of its rows."""
        return self.Get(*self.keys, **{name: Expr("places", (Expr("ref", (self.keys[0],)),))})

    def GridArrays(self, flat: dict[Any, str] | None = None) -> Dataset:
        """For two keys the dense grid of their values: other slices as an array of rows for each cell, in row order.

        The first key's values are the rows, the second's a dim of their own. flat: (both keys): slice or slices with one
        value a cell; second key: those with one value for each of its values. Each row holds an array over the second
        key's values, which are one value that goes to every task.
        """
        from lattica.dataset import Dataset, Slice

        first, second = self.keys
        ds = self.ds
        others = [s for s in ds.slices if s.name not in self.keys]
        names = lambda x: [x] if isinstance(x, str) else list(x)
        per_cell, per_second = set(self.flat), set()
        for key, of in (flat or {}).items():
            (per_cell if isinstance(key, tuple) and len(key) > 1 else per_second).update(names(of))
        k1, k2 = (ds.value(ds.slice(k)).column for k in self.keys)
        packed = F.sort_array(F.collect_list(F.struct(order_of(ds).alias("p"), *(F.col(f"`{s.column}`").alias(f"v{k}") for k, s in enumerate(others)))))
        cells = ds.df.groupBy(k1.alias("k1"), k2.alias("k2")).agg(packed.alias("rows"))
        rows = cells.groupBy("k1").agg(F.collect_list(F.struct("k2", "rows")).alias("cells"))
        firsts = [F.min_by(F.col(f"`{s.column}`"), order_of(ds)).alias(f"v{k}") for k, s in enumerate(others) if s.name in per_second]
        along = ds.df.groupBy(k2.alias("k2")).agg(*(firsts or [F.count(F.lit(1)).alias("n")]))
        along = along.agg(F.sort_array(F.collect_list(F.struct(*along.columns))).alias("along"))
        both = rows.crossJoin(F.broadcast(along))  # one row
        cell = lambda a: F.get(F.filter("cells", lambda c: c["k2"].eqNullSafe(a["k2"])), F.lit(0))["rows"]
        both = both.withColumn("grid", F.transform("along", lambda a: F.coalesce(cell(a), F.array().cast(cells.schema["rows"].dataType))))
        dims = (f"g{first}", f"g{second}", f"g{ds.rows}")
        columns = {first: (F.col("k1"), dims[:1]), second: (fields("along", "k2"), dims[1:2])}
        for k, s in enumerate(others):
            rest = s.dims[1:]
            if s.name in per_second:
                columns[s.name] = fields("along", f"v{k}"), dims[1:2] + rest
            elif s.name in per_cell:
                columns[s.name] = F.transform("grid", _first_of(f"v{k}")), dims[:2] + rest
            else:
                columns[s.name] = F.transform("grid", _field_of(f"v{k}")), dims + rest
        ordered = [s.name for s in ds.slices]
        df = both.select("k1", *(columns[n][0].alias(f"c{k}") for k, n in enumerate(ordered)))
        return Dataset(df, [Slice(n, f"c{k}", columns[n][1]) for k, n in enumerate(ordered)], dims[0], ["k1"])

    def Grid(self, *sel: Any, **named: Any) -> Dataset:
        """All combinations of the keys' values, with the reductions of each cell; cells without rows get those of nothing."""
        from lattica.dataset import Dataset, Slice

        found = self.Get(*self.keys, **named)
        names = found.Names
        df = found.toDF()
        grid: DataFrame | None = None
        for k in self.keys:
            own = self.ds.df.select(self.ds.value(self.ds.slice(k)).column.alias(k)).distinct()
            grid = own if grid is None else grid.crossJoin(own)  # as many rows as cells: that is the result
        assert grid is not None
        right = df.withColumnsRenamed({k: f"__{k}" for k in self.keys})
        out = grid.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left")
        zero = {n: F.lit(0) for n, e in named.items() if isinstance(e, Expr) and e.kind in ("count", "sum", "count_distinct")}
        out = out.select(*self.keys, *(F.coalesce(F.col(n), zero[n].cast(df.schema[n].dataType)).alias(n) if n in zero else n for n in names if n not in self.keys))
        return Dataset(out, [Slice(n, n, ("cells",)) for n in names], "cells", list(self.keys))


def _field_of(name: str):
    return lambda rows: fields(rows, name)


def _first_of(name: str):
    return lambda rows: F.get(rows, F.lit(0))[name]


def GroupIndex(self: Dataset, *keys: str) -> Dataset:
    """For each combination of these slices' values (of all slices: none given) the places of its rows."""
    return GroupBy(self, *(keys or self.Names)).Index().Get("index")


def GroupBy(self: Dataset, *keys: str, flat: list[str] | tuple[str, ...] = (), missing: str = "one") -> Grouped:
    """Group rows by one or more slices; Grid() gives the dense product of several keys."""
    return Grouped(self, tuple(keys), tuple(flat), missing)


def Unique(self: Dataset, *names: str) -> Dataset:
    """Of rows with equal values in these slices the first one."""
    keys = [self.slice(n).column for n in names or self.Names]
    columns = [c for c in self.df.columns if c not in keys]
    if not columns:
        return self._with(df=self.df.dropDuplicates(keys))
    first = self.df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order_of(self)).alias("__first"))
    return self._with(df=first.select(*keys, "__first.*"))


METHODS = {"GroupBy": GroupBy, "GroupIndex": GroupIndex, "Unique": Unique}
