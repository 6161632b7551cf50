"""Functions of single elements: arithmetic, comparisons, sets, strings. Each gives a column and the result's type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.types import common_type, is_integer, is_number

Made = tuple[Column, T.DataType]
BOOL, LONG, DOUBLE, TEXT = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


def _wide(column: Column, t: T.DataType, to: T.DataType) -> Column:
    return column if t == to else column.cast(to)


def _numbers(body: Callable[[Column, Column, T.DataType], Column]) -> Callable[..., Made]:
    """A function of two numbers, in their common type; truth values count as integers."""

    def made(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
        t = common_type(ta, tb)
        if not is_number(t):
            raise TypeError(f"no numbers: {ta.simpleString()}, {tb.simpleString()}")
        t = LONG if isinstance(t, T.BooleanType) else t
        return body(_wide(a, ta, t), _wide(b, tb, t), t).cast(t), t

    return made


def _arrays(f: Callable[[Column, Column], Column], other: Callable[..., Made]) -> Callable[..., Made]:
    def made(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
        if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
            t = common_type(ta, tb)
            return f(_wide(a, ta, t), _wide(b, tb, t)), t
        return other(a, b, ta, tb)

    return made


def _divide(a: Column, b: Column, t: T.DataType) -> Column:
    """Integers give the floor; a zero divisor gives null, zero by zero zero."""
    quotient = F.floor(F.try_divide(a, b)) if is_integer(t) else F.try_divide(a, b)
    return F.when((a == 0) & (b == 0), F.lit(0)).otherwise(quotient)


def _modulo(a: Column, b: Column, t: T.DataType) -> Column:
    """The remainder has the divisor's sign."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _bits(name: str) -> Callable[..., Made]:
    truth = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[name]
    whole = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[name]

    def made(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
        if isinstance(ta, T.BooleanType) and isinstance(tb, T.BooleanType):
            return truth(a, b), BOOL
        return _numbers(lambda x, y, t: whole(x, y))(a, b, ta, tb)

    return made


def _add(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
    if isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
        return F.concat(a, b), TEXT
    return _numbers(lambda x, y, t: x + y)(a, b, ta, tb)


def _compare(name: str) -> Callable[..., Made]:
    plain = {"equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b}[name]
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    sets = {
        "equal": lambda a, b: within(a, b) & within(b, a), "not_equal": lambda a, b: ~(within(a, b) & within(b, a)), "less_equal": within, "greater_equal": lambda a, b: within(b, a),
        "less": lambda a, b: within(a, b) & ~within(b, a), "greater": lambda a, b: within(b, a) & ~within(a, b),
    }[name]

    def made(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
        if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
            return sets(a, b), BOOL
        t = common_type(ta, tb)
        return plain(_wide(a, ta, t), _wide(b, tb, t)), BOOL

    return made


def member(element: Column, array: Column) -> Column:
    """Whether an array holds an element; a missing one is held if the array has a missing one. Never null."""
    return F.coalesce(F.when(element.isNull(), F.exists(array, lambda x: x.isNull())).otherwise(F.array_contains(array, element)), F.lit(False))


def _in(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
    return member(a, b), BOOL


def _merge(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Made:
    """The one that isn't missing; two different ones are an error."""
    t = common_type(ta, tb)
    x, y = _wide(a, ta, t), _wide(b, tb, t)
    return F.when(x.isNull() | y.isNull() | x.eqNullSafe(y), F.coalesce(x, y)).otherwise(F.raise_error(F.lit("merge: unequal values")).cast(t)), t


def _real(f: Callable[[Column], Column]) -> Callable[..., Made]:
    return lambda a, t: (f(a.cast("double")), DOUBLE)


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Logarithm of zero is minus infinity, of less not a number."""
    return lambda a: F.when(a == 0, float("-inf")).when(a < 0, float("nan")).otherwise(f(a))


def _same(f: Callable[[Column], Column]) -> Callable[..., Made]:
    return lambda a, t: (f(a.cast("long")), LONG) if isinstance(t, T.BooleanType) else (f(a).cast(t), t)


def _invert(a: Column, t: T.DataType) -> Made:
    return (~a, BOOL) if isinstance(t, T.BooleanType) else (F.bitwise_not(a), t)


def _default(t: T.DataType) -> Column:
    """What replaces a missing value of a type."""
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    return F.lit("") if isinstance(t, T.StringType) else F.lit(False) if isinstance(t, T.BooleanType) else F.lit(0).cast(t)


def _like(a: Column, t: T.DataType, pattern: str, ignore_case: bool = False) -> Made:
    return (a.ilike(pattern) if ignore_case else a.like(pattern)), BOOL


def _has_pattern(a: Column, t: T.DataType, pattern: str, ignore_case: bool = False) -> Made:
    return a.rlike(("(?i)" if ignore_case else "") + pattern), BOOL


#: By name: number of values it takes (further arguments are options), and the function of columns and types.
ELEMENTS: dict[str, tuple[int, Callable[..., Made]]] = {
    "add": (2, _arrays(F.concat, _add)),
    "subtract": (2, _arrays(F.array_except, _numbers(lambda a, b, t: a - b))),
    "multiply": (2, _numbers(lambda a, b, t: a * b)),
    "divide": (2, _numbers(_divide)),
    "floor_divide": (2, _numbers(lambda a, b, t: F.when((a == 0) & (b == 0), F.lit(0)).otherwise(F.floor(F.try_divide(a, b))))),
    "modulo": (2, _numbers(_modulo)),
    "power": (2, _numbers(lambda a, b, t: F.pow(a, b))),
    "and": (2, _arrays(F.array_intersect, _bits("and"))),
    "or": (2, _arrays(F.array_union, _bits("or"))),
    "xor": (2, _arrays(lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a)), _bits("xor"))),
    **{n: (2, _compare(n)) for n in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal")},
    "in": (2, _in),
    "contains": (2, lambda a, b, ta, tb: _in(b, a, tb, ta)),
    "merge": (2, _merge),
    "invert": (1, _invert),
    "negative": (1, _same(lambda a: -a)),
    "abs": (1, _same(F.abs)),
    "log": (1, _real(_log(F.ln))),
    "log2": (1, _real(_log(F.log2))),
    "log10": (1, _real(_log(F.log10))),
    "sqrt": (1, _real(F.sqrt)),
    "upper": (1, lambda a, t: (F.upper(a), TEXT)),
    "lower": (1, lambda a, t: (F.lower(a), TEXT)),
    "like": (1, _like),
    "has_pattern": (1, _has_pattern),
    "is_missing": (1, lambda a, t: (a.isNull(), BOOL)),
    "replace_missing": (1, lambda a, t, value=None: (F.coalesce(a, _default(t) if value is None else F.lit(value).cast(t)), t)),
}
