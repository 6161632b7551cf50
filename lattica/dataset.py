"""Dataset: named slices with dims over one DataFrame.

A row of the DataFrame is a place on the row dim. Deeper dims of a slice are array levels of its column. A slice
without the row dim holds the same value in every row. Packing and unpacking a dim changes what operators act on, not
the data. Places on the row dim exist only where `order_by` names columns that order rows totally.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.expr import Expr, Value, at_depth, by_position, lifted, swapped_in
from lattica.functions import ELEMENTS, REDUCTIONS, SEQUENCES
from lattica.tables import positions
from lattica.types import common_type, create_type, detect, type_string

PLACE = "__pos"
_numbers = count()


@dataclass(frozen=True)
class Slice:
    """A named column: its DataFrame column, its dims, and labels."""

    name: str
    column: str
    dims: tuple[str, ...]
    marks: frozenset[str] = frozenset()


class Dataset:
    """An immutable, lazy bag of slices over one DataFrame."""

    def __init__(self, df: DataFrame, slices: list[Slice], rows: str | None, order_by: list[str] | None = None):
        self.df, self.slices, self.rows, self.order_by = df, slices, rows, order_by or []

    # --- making -----------------------------------------------------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, rows: str = "rows", order_by: list[str] | None = None, unpack: bool = True) -> Dataset:
        """A table; array columns become inner dims, named after the column."""
        def dims(name: str, t: T.DataType, depth: int = 1) -> tuple[str, ...]:
            if not unpack or not isinstance(t, T.ArrayType):
                return ()
            return (name if depth == 1 else f"{name}{depth}", *dims(name, t.elementType, depth + 1))

        return cls(df, [Slice(f.name, f.name, (rows, *dims(f.name, f.dataType))) for f in df.schema], rows, order_by)

    def _with(self, **changes: Any) -> Dataset:
        own = {"df": self.df, "slices": self.slices, "rows": self.rows, "order_by": self.order_by} | changes
        return Dataset(**own)

    # --- looking ----------------------------------------------------------------------------------------------------

    @property
    def Names(self) -> list[str]:
        return [s.name for s in self.slices]

    @property
    def AllDims(self) -> list[str]:
        """Dims of all slices, each once, outer before inner."""
        return list(dict.fromkeys(d for s in self.slices for d in s.dims))

    @property
    def Dims(self) -> dict[str, tuple[str, ...]]:
        return {s.name: s.dims for s in self.slices}

    @property
    def Depth(self) -> int:
        return max((len(s.dims) for s in self.slices), default=0)

    @property
    def Type(self) -> dict[str, str]:
        return {s.name: type_string(self.value(s).type) for s in self.slices}

    def RepeatedNames(self) -> dict[str, list[int]]:
        """Names that several slices have, and where."""
        at: dict[str, list[int]] = {}
        for k, n in enumerate(self.Names):
            at.setdefault(n, []).append(k)
        return {n: ks for n, ks in at.items() if len(ks) > 1}

    def slice(self, name: str | int) -> Slice:
        """By name or place; else by a label that one slice has."""
        if isinstance(name, int):
            return self.slices[name]
        found = [s for s in self.slices if s.name == name] or [s for s in self.slices if name in s.marks]
        if not found:
            raise KeyError(f"no slice {name}; there are {self.Names}")
        return found[0]

    def value(self, s: Slice) -> Value:
        t = self.df.schema[s.column].dataType
        for _ in range(sum(d != self.rows for d in s.dims)):
            t = t.elementType
        return Value(F.col(f"`{s.column}`"), s.dims, t, s.name)

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_") or all(s.name != name for s in self.slices):
            raise AttributeError(name)
        return Expr("ref", (name,), label=name)

    def toDF(self) -> DataFrame:
        """A DataFrame with the slices' names as columns; a name that occurs again gets a number."""
        seen: dict[str, int] = {}
        out = []
        for s in self.slices:
            seen[s.name] = seen.get(s.name, -1) + 1
            out.append(F.col(f"`{s.column}`").alias(s.name + (str(seen[s.name]) if seen[s.name] else "")))
        return self.df.select(*out)

    def ToPython(self) -> list:
        """All rows as Python values, in row order if there is one: of one slice its values, else dicts. For small results."""
        df = self.df.orderBy(*self.order_by) if self.order_by else self.df
        rows = [r.asDict(True) for r in self._with(df=df).toDF().collect()]
        return [next(iter(r.values())) for r in rows] if len(self.slices) == 1 else rows

    def Show(self, n: int = 10) -> str:
        """Names, types and dims, and the first n rows."""
        head = "  ".join(f"{s.name}:{type_string(self.value(s).type)}[{'<'.join(s.dims)}]" for s in self.slices)
        return "\n".join([head, *(str(tuple(r)) for r in self.toDF().limit(n).collect())])

    def Copy(self) -> Dataset:
        """The same, kept in memory once worked out."""
        return self._with(df=self.df.cache())

    def Len(self) -> int:
        return self.df.count()

    # --- expressions ------------------------------------------------------------------------------------------------

    def placed(self) -> Dataset:
        """With each row's place in a column."""
        if PLACE in self.df.columns:
            return self
        if not self.order_by:
            raise ValueError("this needs row places: give the dataset an order_by that orders rows totally")
        return self._with(df=positions(self.df, self.order_by, PLACE))

    def compile(self, e: Any) -> Value:
        """An expression, slice name or Python value as a column with dims."""
        if isinstance(e, Value):
            return e
        if callable(e) and not isinstance(e, Expr):
            return self.compile(e(self))
        if not isinstance(e, Expr):
            if isinstance(e, (list, tuple)):
                column = F.array(*map(F.lit, e))
                kind = T.LongType() if all(isinstance(x, int) for x in e) else T.DoubleType() if all(isinstance(x, (int, float)) for x in e) else T.StringType()
                return Value(column.cast(T.ArrayType(kind)), (), T.ArrayType(kind))
            kind = T.BooleanType() if isinstance(e, bool) else T.LongType() if isinstance(e, int) else T.DoubleType() if isinstance(e, float) else T.StringType() if isinstance(e, str) else T.NullType()
            return Value(F.lit(e), (), kind)
        if e.kind == "ref":
            return self.value(self.slice(e.args[0]))
        if e.kind == "value":
            return e.args[0]
        return getattr(self, f"_{e.kind}", lambda x: self._function(x))(e)

    def _function(self, e: Expr) -> Value:
        label = e.label or "result"
        if e.kind in ELEMENTS:
            n, body = ELEMENTS[e.kind]
            values = [self.compile(a) for a in e.args[:n]]
            if e.options.get("mode") == "pos":
                values[1] = by_position(values[0], values[1])
            if e.kind in ("in", "contains"):
                k = 1 if e.kind == "in" else 0
                values[k] = self._packed(values[k])
            options = {x: v for x, v in e.options.items() if x != "mode"}
            made: list[T.DataType] = []

            def over(*columns: Column) -> Column:
                column, t = body(*columns, *(v.type for v in values), *e.args[n:], **options)
                made.append(t)
                return column

            column, dims = lifted(values, self.rows, over)
            return Value(column, dims, made[-1], label)
        if e.kind in REDUCTIONS:
            return self._reduced(e, label)
        if e.kind in SEQUENCES:
            return self._sequenced(e, label)
        raise ValueError(f"unknown function {e.kind}")

    def _inner(self, v: Value) -> list[str]:
        return [d for d in v.dims if d != self.rows]

    def _packed(self, v: Value) -> Value:
        """The value with its last array level as part of the element."""
        inner = self._inner(v)
        return replace(v, dims=tuple(d for d in v.dims if d != inner[-1]), type=T.ArrayType(v.type)) if inner else v

    def _pack(self, e: Expr) -> Value:
        return self._packed(self.compile(e.args[0]))

    def _len(self, e: Expr) -> Value:
        return self._reduced(Expr("count", e.args, e.options, e.label), e.label or "result")

    def _reduced(self, e: Expr, label: str) -> Value:
        v = self.compile(e.args[0])
        r = REDUCTIONS[e.kind]
        inner = self._inner(v)
        dim = e.options.get("dim", e.args[1] if len(e.args) > 1 else None) or (v.dims[-1] if v.dims else None)
        if dim is None or dim not in v.dims:
            return v  # slices without the dim pass
        if dim == self.rows:
            raise ValueError("a reduction over rows: use Dataset.Reduce, or GroupBy")
        if inner[-1] != dim:
            v = swapped_in(v, self.rows, dim)
        if e.kind == "sum" and isinstance(v.type, (T.ArrayType, T.StringType)):
            join = F.flatten if isinstance(v.type, T.ArrayType) else lambda a: F.array_join(a, "")
            return Value(at_depth(v, self.rows, dim, join), tuple(d for d in v.dims if d != dim), v.type, label)
        column = at_depth(v, self.rows, dim, lambda a: r.array(a, v.type))
        return Value(column.cast(r.result(v.type)) if len(inner) == 1 else column, tuple(d for d in v.dims if d != dim), r.result(v.type), label)

    def _sequenced(self, e: Expr, label: str) -> Value:
        v = self.compile(e.args[0])
        s = SEQUENCES[e.kind]
        options = {k: x for k, x in e.options.items() if k != "dim"}
        dim = e.options.get("dim") or v.dims[-1]
        if dim != self.rows:
            return Value(at_depth(v, self.rows, dim, lambda a: s.array(a, v.type, **options)), v.dims, s.result(v.type), label)
        if PLACE not in self.df.columns:
            raise ValueError("a sequence function over rows: apply it with Dataset.Along")
        if e.kind == "pos":
            column = F.col(PLACE)
        else:
            raise ValueError(f"{e.kind} over rows: use Dataset.Along, which no task gets all rows for")
        return Value(column.cast(s.result(v.type)), v.dims, s.result(v.type), label)

    def _cast(self, e: Expr) -> Value:
        v = self.compile(e.args[0])
        text = e.args[1]
        t = create_type(text)
        column, dims = lifted([v], self.rows, lambda x: (F.when(x != "", x.try_cast(t)) if isinstance(v.type, T.StringType) else x.try_cast(t)) if text.endswith("?") else x.cast(t))
        return Value(column, dims, t, e.label or v.name)

    def _field(self, e: Expr) -> Value:
        v = self.compile(e.args[0])
        column, dims = lifted([v], self.rows, lambda x: x[e.args[1]])
        return Value(column, dims, v.type[e.args[1]].dataType, e.args[1])

    def _at(self, e: Expr) -> Value:
        """Positions, places or a window of the last array level."""
        v, key = self.compile(e.args[0]), e.args[1]
        dim = self._inner(v)[-1]
        if isinstance(key, slice):
            start, stop = key.start or 0, key.stop

            def window(a: Column) -> Column:
                from_ = F.lit(start) if start >= 0 else F.greatest(F.size(a) + start, F.lit(0))
                to = F.size(a) if stop is None else F.least(F.lit(stop), F.size(a)) if stop >= 0 else F.size(a) + stop
                cut = F.slice(a, from_ + 1, F.greatest(to - from_, F.lit(0)))
                return cut if key.step in (None, 1) else F.filter(cut, lambda x, i: i % key.step == 0)

            return replace(v, column=at_depth(v, self.rows, dim, window))
        if isinstance(key, int):
            pick = lambda a: F.element_at(a, key + 1 if key >= 0 else key)
            return replace(v, column=at_depth(v, self.rows, dim, pick), dims=tuple(d for d in v.dims if d != dim))
        if isinstance(key, (list, tuple)):
            nested = any(isinstance(k, (list, tuple)) for k in key)
            pick = lambda a, i: F.element_at(a, F.when(i >= 0, i + 1).otherwise(i))
            one = lambda a, ks: F.transform(F.array(*map(F.lit, ks)), lambda i: pick(a, i))
            gather = (lambda a: F.array(*(one(a, ks) for ks in key))) if nested else (lambda a: one(a, key))
            return replace(v, column=at_depth(v, self.rows, dim, gather), dims=tuple(x for d in v.dims for x in ([f"g{d}"] * nested + [f"f{d}"] if d == dim else [d])))
        return self._kept(v, self.compile(key))

    def _kept(self, v: Value, condition: Value) -> Value:
        """The elements where a condition along the same last array level holds; missing counts as false."""
        dim = condition.dims[-1]
        if dim not in v.dims or dim == self.rows:
            return v
        pair = lifted([v, condition], self.rows, lambda x, c: F.struct(x.alias("x"), c.alias("c")))
        both = Value(pair[0], pair[1], T.NullType())
        keep = lambda a: F.transform(F.filter(a, lambda s: F.coalesce(s["c"], F.lit(False))), lambda s: s["x"])
        return Value(at_depth(both, self.rows, dim, keep), tuple(f"f{d}" if d == dim else d for d in v.dims), v.type, v.name)

    def _split_on_pattern(self, e: Expr) -> Value:
        v, pattern = self.compile(e.args[0]), e.args[1]
        limit = e.options.get("max_splits", -1)
        pattern = ("(?i)" if e.options.get("ignore_case") else "") + pattern
        column, dims = lifted([v], self.rows, lambda x: F.split(x, pattern, limit + 1 if limit > 0 else -1))
        return Value(column, (*dims, e.options.get("dim", f"s{v.name}")), T.StringType(), e.label or v.name)

    def _each(self, e: Expr) -> Value:
        """A Python function of one or more slices' elements, in Arrow batches; dtype is needed."""
        *values, function = e.args
        if not callable(function):
            values, function = [values[0], *e.args[2:]], e.args[1]
        compiled = [self.compile(a) for a in values]
        t = create_type(e.options["dtype"])
        made = F.udf(function, t, useArrow=True)
        if any(self._inner(v) for v in compiled):
            raise ValueError("Each works on the elements of rows: flatten inner dims first, or pack them")
        dims = compiled[0].dims
        inner: tuple[str, ...] = ()
        element = t
        while isinstance(element, T.ArrayType):
            inner += (e.options.get("dim", "each") + str(len(inner) or ""),)
            element = element.elementType
        return Value(made(*(v.column for v in compiled)), dims + inner, element, e.label or getattr(function, "__name__", "result"))

    # --- projection -------------------------------------------------------------------------------------------------

    def _chosen(self, sel: Any, used: set[str]) -> list[tuple[str, Value, frozenset[str]]]:
        if isinstance(sel, str) and sel in ("*", "~"):
            return [(s.name, self.value(s), s.marks) for s in self.slices if sel == "*" or s.name not in used]
        if isinstance(sel, str) and sel == "#":
            return [(s.name, self.value(s), s.marks) for s in self.slices[:1]]
        if isinstance(sel, (str, int)) and not isinstance(sel, bool):
            s = self.slice(sel)
            return [(s.name, self.value(s), s.marks)]
        if isinstance(sel, tuple):
            values = [v for x in sel for _, v, _ in self._chosen(x, used)]
            return [("result", self._struct(values), frozenset())]
        if isinstance(sel, list):
            values = [v for x in sel for _, v, _ in self._chosen(x, used)]
            t = reduce(common_type, (v.type for v in values))
            column, dims = lifted(values, self.rows, lambda *c: F.array(*(x.cast(t) for x in c)))
            return [("result", Value(column, (*dims, "array"), t), frozenset())]
        v = self.compile(sel)
        return [(getattr(sel, "label", None) or v.name, v, frozenset())]

    def _struct(self, values: list[Value]) -> Value:
        column, dims = lifted(values, self.rows, lambda *c: F.struct(*(x.alias(v.name) for x, v in zip(c, values))))
        return Value(column, dims, T.StructType([T.StructField(v.name, v.type) for v in values]))

    def Get(self, *sel: Any, **named: Any) -> Dataset:
        """Chosen slices: names, places, '*' all, '~' those not used otherwise, '#' one, expressions, tuples (records), lists (arrays)."""
        used = {x for s in [*sel, *named.values()] for x in _names_in(s)}
        chosen = [c for s in sel for c in self._chosen(s, used)]
        chosen += [(n, self._chosen(s, used)[0][1], frozenset()) for n, s in named.items()]
        return self.made(chosen)

    def made(self, chosen: list[tuple[str, Value, frozenset[str]]]) -> Dataset:
        """A dataset of these values; columns that order rows stay behind the scenes."""
        columns, slices = [], []
        for name, v, marks in chosen:
            own = f"c{next(_numbers)}"  # new ones: else a lambda would see an alias of this select for a column below
            columns.append(v.column.alias(own))
            slices.append(Slice(name, own, v.dims, marks))
        hidden = [c for c in self.df.columns if c == PLACE or c in self.order_by]
        keep = [F.col(f"`{c}`").alias(c if c.startswith("__") else f"__o_{c}") for c in hidden]
        order = [c if c.startswith("__") else f"__o_{c}" for c in self.order_by]
        return Dataset(self.df.select(*columns, *keep), slices, self.rows, order)

    def Without(self, *names: Any) -> Dataset:
        gone = {self.slice(n).column for n in names}
        return self._with(slices=[s for s in self.slices if s.column not in gone])

    def To(self, *names: str, Do: Callable | Expr) -> Dataset:
        """Selected slices replaced by what Do makes of each."""
        chosen = []
        for s in self.slices:
            if s.name not in names:
                chosen.append((s.name, self.value(s), s.marks))
                continue
            made = Do(Expr("ref", (s.name,), label=s.name)) if callable(Do) and not isinstance(Do, Expr) else _bound(Do, s.name)
            for m in made if isinstance(made, (list, tuple)) else [made]:
                v = self.compile(m)
                chosen.append((getattr(m, "label", None) or s.name, v, s.marks))
        return self.made(chosen)

    def AddSlice(self, name: str, data: Any) -> Dataset:
        return self.Get("*", **{name: Expr("value", (self.compile(data),), label=name) if isinstance(data, (str, list)) else data})

    def Rename(self, *names: str, **by: str) -> Dataset:
        """By place, or old=new."""
        out = [replace(s, name=names[k]) if k < len(names) else replace(s, name=by.get(s.name, s.name)) for k, s in enumerate(self.slices)]
        return self._with(slices=out)

    def PrefixName(self, text: str) -> Dataset:
        return self._with(slices=[replace(s, name=text + s.name) for s in self.slices])

    def PostfixName(self, text: str) -> Dataset:
        return self._with(slices=[replace(s, name=s.name + text) for s in self.slices])

    def Bookmark(self, *names: str, **by: str) -> Dataset:
        """Labels for all slices, or slice=label."""
        return self._with(slices=[replace(s, marks=s.marks | set(names) | ({by[s.name]} if s.name in by else set())) for s in self.slices])

    def B(self, mark: str) -> Dataset:
        """The slices with a label."""
        return self._with(slices=[s for s in self.slices if mark in s.marks])

    @property
    def L(self) -> Dataset:
        return self.B("!L")

    @property
    def R(self) -> Dataset:
        return self.B("!R")

    def D(self, dim: str) -> Dataset:
        """The slices with a dim."""
        return self._with(slices=[s for s in self.slices if dim in s.dims])

    def Cast(self, *types: str, **by: str) -> Dataset:
        """One type for all, one for each slice, or by name."""
        want = {s.name: by.get(s.name) or (types[0] if len(types) == 1 else types[k] if k < len(types) else None) for k, s in enumerate(self.slices)}
        return self.made([(s.name, self.compile(Expr("cast", (Expr("value", (self.value(s),)), want[s.name]), label=s.name)) if want[s.name] else self.value(s), s.marks) for s in self.slices])

    def Detect(self) -> Dataset:
        """Text slices of numbers as numbers; works all rows over once."""
        return self._with(df=detect(self.df, [s.column for s in self.slices]))

    def Tuple(self, name: str = "data") -> Dataset:
        """All slices as one record."""
        v = self._struct([self.value(s) for s in self.slices])
        return self.made([(name, v, frozenset())])

    def Dict(self, name: str = "data", with_missing: bool = False) -> Dataset:
        """All slices as one dictionary from their names; missing values have no entry, unless with_missing."""
        values = [self.value(s) for s in self.slices]
        t = reduce(common_type, (v.type for v in values))

        def body(*columns: Column) -> Column:
            entries = F.array(*(F.struct(F.lit(n).alias("k"), x.cast(t).alias("v")) for n, x in zip(self.Names, columns)))
            return F.map_from_entries(entries if with_missing else F.filter(entries, lambda e: e["v"].isNotNull()))

        column, dims = lifted(values, self.rows, body)
        return self.made([(name, Value(column, dims, T.MapType(T.StringType(), t)), frozenset())])

    def Each(self, function: Callable, dtype: str, per_slice: bool = False, name: str = "result") -> Dataset:
        """A Python function of all slices' elements at a place, or of each slice's: packed arrays are elements, so after Array() it takes a whole dim."""
        if per_slice:
            return self.made([(s.name, self.compile(Expr("each", (Expr("value", (self.value(s),)), function), {"dtype": dtype})), s.marks) for s in self.slices])
        first, *rest = (Expr("value", (self.value(s),)) for s in self.slices)
        return self.made([(name, self.compile(Expr("each", (first, *rest, function), {"dtype": dtype})), frozenset())])

    def Corr(self, name: str) -> DataFrame:
        """i, j, r: Pearson's correlations over rows of all pairs of places of an array slice."""
        from lattica.operators.correlation import correlations

        return correlations(self.df, self.slice(name).column)

    def Fields(self) -> Dataset:
        """Records as one slice for each field."""
        chosen = []
        for s in self.slices:
            v = self.value(s)
            if isinstance(v.type, T.StructType):
                chosen += [(f.name, self._field(Expr("field", (Expr("value", (v,)), f.name))), s.marks) for f in v.type]
            else:
                chosen.append((s.name, v, s.marks))
        return self.made(chosen)

    def HArray(self, name: str = "data") -> Dataset:
        """All slices as one array along a new dim, and the slices' names along it."""
        values = [self.value(s) for s in self.slices]
        t = reduce(common_type, (v.type for v in values))
        column, dims = lifted(values, self.rows, lambda *c: F.array(*(x.cast(t) for x in c)))
        names = Value(F.array(*map(F.lit, self.Names)), ("slices",), T.StringType())
        return self.made([("names", names, frozenset()), (name, Value(column, (*dims, "slices"), t), frozenset())])

    Harray = HArray

    # --- running something over rows -------------------------------------------------------------------------------

    def Reduce(self, *sel: Any, **named: Any) -> Dataset:
        """Reductions over all rows: one row. Partial sums first, so no task gets all rows."""
        from lattica.operators.groups import reduced

        return reduced(self, [], sel, named)

    def Along(self, **named: Expr) -> Dataset:
        """Pos and CumSum over rows beside all slices, in two passes: within ranges of rows, then from the ranges' totals."""
        from lattica.operators.sequence import along

        return along(self, named)

    # --- the rest of the operators are functions of their modules ---------------------------------------------------

    def Filter(self, condition: Any, dim: str | int | None = None, mode: str | None = None) -> Dataset:
        from lattica.operators.filters import filtered

        return filtered(self, condition, dim, mode)

    def __getitem__(self, key: Any) -> Dataset:
        from lattica.operators.filters import indexed

        return indexed(self, key)


def _names_in(e: Any) -> set[str]:
    if isinstance(e, str):
        return {e}
    if isinstance(e, (list, tuple)):
        return {n for x in e for n in _names_in(x)}
    if isinstance(e, Expr) and e.kind != "here":
        return {e.args[0]} if e.kind == "ref" else {n for x in e.args if isinstance(x, Expr) for n in _names_in(x)}
    return set()


def _bound(e: Any, name: str) -> Any:
    """The expression with the bare context replaced by a slice."""
    if not isinstance(e, Expr):
        return e
    if e.kind == "here":
        return Expr("ref", (name,), label=name)
    return replace(e, args=tuple(_bound(a, name) for a in e.args), label=e.label or name)


def rep(spark: SparkSession, data: Any, dtype: str | None = None, rows: str = "d1") -> Dataset:
    """Python data: a list of values, tuples or dicts, or lists of lists. Rows keep their order."""
    items = data if isinstance(data, list) else [data]
    if items and isinstance(items[0], dict):
        names = list(dict.fromkeys(k for x in items for k in x))
        records = [tuple(x.get(n) for n in names) for x in items]
    elif items and isinstance(items[0], tuple):
        width = max(map(len, items))
        names = list(getattr(items[0], "_fields", [f"f{k}" for k in range(width)]))
        records = [tuple(x) + (None,) * (width - len(x)) for x in items]
    else:
        names, records = ["data"], [(x,) for x in items]
    schema: Any = ["__row", *names]
    if dtype:
        t = create_type(dtype)
        t = t.elementType if isinstance(t, T.ArrayType) else t
        fields = list(t) if isinstance(t, T.StructType) else [T.StructField(names[0], t)]
        schema = T.StructType([T.StructField("__row", T.LongType()), *fields])
        names = [f.name for f in fields]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(records)], schema)
    out = Dataset.of(df, rows, ["__row"])
    return out._with(slices=[s for s in out.slices if s.name != "__row"])


def _methods() -> None:
    """The operators of other modules, as methods."""
    from lattica.operators import groups, joins, lookup, sequence, sets, shape

    for module in (groups, joins, lookup, sequence, sets, shape):
        for name, function in module.METHODS.items():
            setattr(Dataset, name, function)


_methods()
