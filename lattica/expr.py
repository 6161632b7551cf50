"""Recorded expressions over slices, and their compilation to columns.

A value has a path of dims, outermost first. The row dim is the DataFrame's rows; deeper dims are array levels. Values
are aligned by the names of their dims: what lacks a dim is repeated along it, through higher-order functions for array
levels and for free for the row dim.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    """A column, the dims of its array levels and rows, and the type of one element."""

    column: Column
    dims: tuple[str, ...]
    type: T.DataType
    name: str = "result"


@dataclass(frozen=True, eq=False)
class Expr:
    """A node of a recorded expression."""

    kind: str
    args: tuple = ()
    options: dict = field(default_factory=dict)
    label: str | None = None

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        from lattica.functions import METHODS

        if self.kind == "here" and name not in METHODS:
            return Expr("ref", (name,), label=name)
        if name in METHODS:
            return lambda *args, **options: Expr(METHODS[name], (self, *args), options, label_of(self))
        return Expr("field", (self, name), label=name)

    def __getitem__(self, key: Any) -> Expr:
        return Expr("at", (self, key), label=label_of(self))

    def __truediv__(self, other: Any) -> Expr:
        """Division, or a new name where the right side is a string."""
        return replace(self, label=other) if isinstance(other, str) else self._binary("divide", other)

    def _binary(self, kind: str, other: Any) -> Expr:
        mine, its = label_of(self), label_of(other)
        return Expr(kind, (self, other), label=mine if its is None or its == mine else its if mine is None else "result")

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ on recorded expressions, not and, or, not")

    def __hash__(self) -> int:
        return id(self)

    def __neg__(self) -> Expr:
        return Expr("negative", (self,), label=label_of(self))

    def __invert__(self) -> Expr:
        return Expr("invert", (self,), label=label_of(self))

    def __abs__(self) -> Expr:
        return Expr("abs", (self,), label=label_of(self))


def label_of(e: Any) -> str | None:
    """An expression's name, if it has one."""
    return e.label if isinstance(e, Expr) and e.kind != "here" else None


def _operator(kind: str, swapped: bool = False) -> Callable:
    if swapped:
        return lambda self, other: Expr(kind, (other, self), label=label_of(self))
    return lambda self, other: self._binary(kind, other)


for _name, _kind in (("add", "add"), ("sub", "subtract"), ("mul", "multiply"), ("floordiv", "floor_divide"), ("mod", "modulo"), ("pow", "power"), ("and", "and"), ("or", "or"), ("xor", "xor")):
    setattr(Expr, f"__{_name}__", _operator(_kind))
    setattr(Expr, f"__r{_name}__", _operator(_kind, True))
Expr.__rtruediv__ = _operator("divide", True)  # type: ignore[attr-defined]
for _name, _kind in (("eq", "equal"), ("ne", "not_equal"), ("lt", "less"), ("le", "less_equal"), ("gt", "greater"), ("ge", "greater_equal")):
    setattr(Expr, f"__{_name}__", _operator(_kind))



class _Here(Expr):
    """The bare context: every attribute that isn't a function is a slice, whatever its name."""

    def __getattribute__(self, name: str) -> Any:
        if name in ("label", "args", "options"):
            return Expr("ref", (name,), label=name)
        return super().__getattribute__(name)


#: Stands for the dataset that an expression will be applied to.
_ = _Here("here")


def col(name: str) -> Expr:
    """A slice by its name."""
    return Expr("ref", (name,), label=name)


def fields(rows: str, *path: str) -> Column:
    """Of each record in an array the field at a path."""
    return F.transform(rows, lambda x: reduce(lambda r, name: r[name], path, x))


def merged(*paths: tuple[str, ...]) -> tuple[str, ...]:
    """One path that holds each path's dims in their order: dims that nothing orders stay in the order of the arguments."""
    out: list[str] = []
    rest = [list(p) for p in paths]
    while any(rest):
        heads = [p[0] for p in rest if p]
        free = next((h for h in heads if not any(h in p[1:] for p in rest)), None)
        if free is None:
            raise ValueError(f"dims are in conflicting orders: {paths}")
        out.append(free)
        rest = [p[1:] if p and p[0] == free else p for p in rest]
    return tuple(out)


def lifted(values: list[Value], rows: str | None, body: Callable[..., Column]) -> tuple[Column, tuple[str, ...]]:
    """body over the elements of values that are aligned by dims; the result's dims."""
    dims = merged(*(v.dims for v in values))
    inner = [d for d in dims if d != rows]

    def level(k: int, columns: list[Column], rest: list[list[str]]) -> Column:
        if k == len(inner):
            return body(*columns)
        has = [bool(r) and r[0] == inner[k] for r in rest]
        lead = has.index(True)
        deeper = [r[1:] if h else r for r, h in zip(rest, has)]
        return F.transform(columns[lead], lambda x, i: level(k + 1, [x if j == lead else F.get(c, i) if h else c for j, (c, h) in enumerate(zip(columns, has))], deeper))

    return level(0, [v.column for v in values], [[d for d in v.dims if d != rows] for v in values]), dims


def by_position(left: Value, right: Value) -> Value:
    """right with its dims renamed to those of left, from the last one on."""
    n = min(len(left.dims), len(right.dims))
    return replace(right, dims=right.dims[: len(right.dims) - n] + left.dims[len(left.dims) - n :])


def at_depth(value: Value, rows: str | None, dim: str, body: Callable[[Column], Column]) -> Column:
    """body over the arrays of one array level."""
    inner = [d for d in value.dims if d != rows]

    def level(column: Column, k: int) -> Column:
        return body(column) if inner[k] == dim else F.transform(column, lambda x: level(x, k + 1))

    return level(value.column, 0)


def swapped_in(value: Value, rows: str | None, dim: str) -> Value:
    """The value with an array level moved to the innermost place; the levels it passes must not depend on it."""
    inner = [d for d in value.dims if d != rows]
    while inner[-1] != dim:
        k = inner.index(dim)
        flip = lambda a: F.transform(F.sequence(F.lit(0), F.size(F.get(a, F.lit(0))) - 1), lambda j: F.transform(a, lambda r: F.get(r, j)))
        column = at_depth(replace(value, dims=tuple(([rows] if rows in value.dims else []) + inner)), rows, dim, flip)
        inner[k], inner[k + 1] = inner[k + 1], inner[k]
        value = replace(value, column=column, dims=tuple(([rows] if rows in value.dims else []) + inner))
    return value
