"""Reductions of one dim: over rows as aggregates, over an array level as higher-order functions.

Missing values are skipped, but for Count. Sums and products of nothing are 0 and 1; other reductions of nothing are
missing, Any false and All true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.types import is_integer

LONG, DOUBLE, BOOL = T.LongType(), T.DoubleType(), T.BooleanType()


@dataclass(frozen=True)
class Reduction:
    """rows: aggregate of a column (and the column of places); array: function of an array; result: type from type."""

    rows: Callable[[Column, Column], Column]
    array: Callable[[Column, T.DataType], Column]
    result: Callable[[T.DataType], T.DataType]
    needs_places: bool = False


def _sum_type(t: T.DataType) -> T.DataType:
    return t if isinstance(t, (T.ArrayType, T.StringType, T.DecimalType)) else LONG if is_integer(t) else DOUBLE


def _known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _total(a: Column, t: T.DataType) -> Column:
    to = _sum_type(t)
    return F.aggregate(_known(a), F.lit(0).cast(to), lambda s, x: (s + x.cast(to)).cast(to))


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(_known(a), F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(_known(a)))


def _median(a: Column) -> Column:
    s = F.array_sort(_known(a))
    n = F.size(s)
    at = lambda k: F.get(s, F.floor(k).cast("int")).cast("double")
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def _std(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(F.try_divide(F.aggregate(_known(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(_known(a))))


def _firsts(pairs: Column) -> Column:
    """Of records (x, i) the least i of each value, in the order of values."""
    ordered = F.array_sort(pairs)
    new = lambda s: F.filter(s, lambda e, k: (k == 0) | (F.get(s, F.greatest(k - 1, F.lit(0)))["x"] != e["x"]))
    once = F.get(F.transform(F.array(ordered), new), F.lit(0))
    return F.transform(once, lambda e: e["i"].cast("long"))


def _numbered(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i).cast("long").alias("i"))), lambda s: s["x"].isNotNull())


REDUCTIONS: dict[str, Reduction] = {
    "sum": Reduction(lambda x, p: F.coalesce(F.sum(x), F.lit(0)), _total, _sum_type),
    "prod": Reduction(lambda x, p: F.coalesce(F.product(x), F.lit(1.0)), lambda a, t: F.aggregate(_known(a), F.lit(1).cast(_sum_type(t)), lambda s, x: (s * x).cast(_sum_type(t))), _sum_type),
    "max": Reduction(lambda x, p: F.max(x), lambda a, t: F.array_max(a), lambda t: t),
    "min": Reduction(lambda x, p: F.min(x), lambda a, t: F.array_min(a), lambda t: t),
    "mean": Reduction(lambda x, p: F.avg(x.cast("double")), lambda a, t: _mean(a), lambda t: DOUBLE),
    "median": Reduction(lambda x, p: F.median(x), lambda a, t: _median(a), lambda t: DOUBLE),
    "std": Reduction(lambda x, p: F.stddev_pop(x), lambda a, t: _std(a), lambda t: DOUBLE),
    "any": Reduction(lambda x, p: F.coalesce(F.bool_or(x), F.lit(False)), lambda a, t: F.coalesce(F.exists(a, lambda x: x), F.lit(False)), lambda t: BOOL),
    "all": Reduction(lambda x, p: F.coalesce(F.bool_and(x), F.lit(True)), lambda a, t: F.coalesce(F.forall(_known(a), lambda x: x), F.lit(True)), lambda t: BOOL),
    "argmax": Reduction(lambda x, p: F.max_by(p, F.struct(x.isNotNull(), x, -p)), lambda a, t: -F.array_max(_numbered(a))["i"], lambda t: LONG, True),
    "argmin": Reduction(lambda x, p: F.min_by(p, F.struct(x.isNull(), x, p)), lambda a, t: F.array_min(F.transform(_numbered(a), lambda s: F.struct(s["x"], (-s["i"]).alias("i"))))["i"], lambda t: LONG, True),
    "first": Reduction(lambda x, p: F.min_by(x, p), lambda a, t: F.get(a, F.lit(0)), lambda t: t, True),
    "argunique": Reduction(lambda x, p: _firsts(F.collect_list(F.when(x.isNotNull(), F.struct(x.alias("x"), p.alias("i"))))), lambda a, t: _firsts(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isNotNull())), lambda t: T.ArrayType(LONG), True),
    "places": Reduction(lambda x, p: F.sort_array(F.collect_list(p)), lambda a, t: F.transform(a, lambda x, i: i.cast("long")), lambda t: T.ArrayType(LONG), True),
    "count": Reduction(lambda x, p: F.count(F.lit(1)), lambda a, t: F.coalesce(F.size(a), F.lit(0)).cast("long"), lambda t: LONG),
    "count_distinct": Reduction(lambda x, p: F.count_distinct(x), lambda a, t: F.size(F.array_distinct(a)).cast("long"), lambda t: LONG),
    "set": Reduction(lambda x, p: F.concat(F.sort_array(F.collect_set(x)), F.when(F.count_if(x.isNull()) > 0, F.array(F.max(F.when(F.lit(False), x)))).otherwise(F.slice(F.sort_array(F.collect_set(x)), 1, 0))), lambda a, t: F.array_distinct(a), T.ArrayType),
}
