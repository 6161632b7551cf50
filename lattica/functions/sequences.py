"""Functions along one dim that keep it: places, running sums, orders and ranks. Ties go by place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = T.LongType()


@dataclass(frozen=True)
class Sequence:
    """array: function of an array; result: type from type. Over rows see operators.sequence."""

    array: Callable[..., Column]
    result: Callable[[T.DataType], T.DataType]


def _order(a: Column, descend: bool) -> Column:
    """Places in the order of the values; descending is the ascending order from behind."""
    pairs = F.transform(a, lambda x, i: F.struct(x.isNull().alias("n"), x.alias("x"), i.cast("long").alias("i")))
    found = F.transform(F.array_sort(pairs), lambda s: s["i"])
    return F.reverse(found) if descend else found


def _ranks(a: Column, descend: bool) -> Column:
    order = F.transform(_order(a, descend), lambda i, k: F.struct(i.alias("i"), k.cast("long").alias("k")))
    return F.transform(F.array_sort(order), lambda s: s["k"])


def _running(a: Column, t: T.DataType) -> Column:
    zero = F.struct(F.lit(0).cast(t).alias("s"), F.array().cast(T.ArrayType(t)).alias("out"))
    step = lambda acc, x: F.struct((acc["s"] + F.coalesce(x, F.lit(0))).cast(t).alias("s"), F.concat(acc["out"], F.array((acc["s"] + F.coalesce(x, F.lit(0))).cast(t))).alias("out"))
    return F.aggregate(a, zero, step, lambda acc: acc["out"])


def _sum_type(t: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(t, (T.FloatType, T.DoubleType)) else LONG


SEQUENCES: dict[str, Sequence] = {
    "pos": Sequence(lambda a, t: F.transform(a, lambda x, i: i.cast("long")), lambda t: LONG),
    "cumsum": Sequence(lambda a, t: _running(a, _sum_type(t)), _sum_type),
    "argsort": Sequence(lambda a, t, descend=False: _order(a, descend), lambda t: LONG),
    "rank": Sequence(lambda a, t, descend=False: _ranks(a, descend), lambda t: LONG),
    "sorted": Sequence(lambda a, t, descend=False: F.transform(_order(a, descend), lambda i: F.get(a, i.cast("int"))), lambda t: t),
}
