"""Joins of datasets: by equal slices, by any condition, by membership. Missing keys match nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.expr import Expr, fields
from lattica.types import common_type

if TYPE_CHECKING:
    from lattica.dataset import Dataset


PLACES = "__pos"


def _sides(left: Dataset, right: Dataset) -> tuple[Dataset, Dataset]:
    """Both with columns of their own and marked !L and !R; row places don't outlive a join."""
    out = []
    for side, ds, mark in (("l", left, "!L"), ("r", right, "!R")):
        columns = [F.col(f"`{s.column}`").alias(f"{side}{k}") for k, s in enumerate(ds.slices)]
        slices = [replace(s, column=f"{side}{k}", marks=(s.marks - {"!L", "!R"}) | {mark}) for k, s in enumerate(ds.slices)]
        out.append(ds._with(df=ds.df.select(*columns), slices=slices, order_by=[]))
    return out[0], out[1]


def _joined(left: Dataset, right: Dataset, df: Any, slices: list) -> Dataset:
    from lattica.dataset import Dataset

    rows = f"{left.rows}_{right.rows}" if left.rows != right.rows else left.rows
    named = [replace(s, dims=tuple(rows if d in (left.rows, right.rows) else d for d in s.dims)) for s in slices]
    return Dataset(df, named, rows)


def _pairs(key: Any, ds: Dataset) -> list[str]:
    keys = key if isinstance(key, (list, tuple)) else [key]
    return [k.args[0] if isinstance(k, Expr) else k for k in keys]


def _one(x: Column, y: Column) -> Column:
    """The value that isn't missing; two different ones are an error."""
    return F.when(x.isNull() | y.isNull() | x.eqNullSafe(y), F.coalesce(x, y)).otherwise(F.raise_error(F.lit("Match: unequal values in slices to merge")))


def Match(self: Dataset, other: Dataset, left: Any = None, right: Any = None, jointype: str = "inner", merge_same: Any = False, mode: str = "dim") -> Dataset:
    """Equi-join. left, right: names, or tuples of names; without them the only shared name.

    Keys along rows join rows. Keys along an inner dim of both sides join the arrays: mode "dim" those of each row with
    those of each other row, "pos" those of rows at the same place.

    jointype inner, left, right, full. An inner join keeps same-named keys once; else both stay unless merge_same is
    "equi" (keys become one) or True or "all" (all same-named slices do; different values are an error), or names.
    """
    if left is None:
        shared = [n for n in self.Names if n in other.Names]
        if len(shared) != 1:
            raise ValueError(f"name the slices to match: shared are {shared}")
        left = shared[0]
    keys_l = _pairs(left, self)
    keys_r = _pairs(right if right is not None else left, other)
    depths = {len(ds.slice(k).dims) for ds, keys in ((self, keys_l), (other, keys_r)) for k in keys}
    if depths != {1}:
        if depths != {2}:
            raise ValueError("Match: keys lie along rows, or along one inner dim of both sides")
        return _matched_arrays(self, other, keys_l, keys_r, jointype, merge_same, mode)
    a, b = _sides(self, other)
    on = [F.col(a.slice(x).column) == F.col(b.slice(y).column) for x, y in zip(keys_l, keys_r)]
    df = a.df.join(b.df, on, {"inner": "inner", "left": "left", "right": "right", "full": "full"}[jointype])
    keys = {a.slice(x).column: b.slice(y).column for x, y in zip(keys_l, keys_r)}
    merge = _merges(a, b, keys, jointype, merge_same)
    made = {}
    for x, y in merge.items():
        t = common_type(df.schema[x].dataType, df.schema[y].dataType)
        own, its = F.col(x).cast(t), F.col(y).cast(t)
        made[x] = own if jointype == "inner" and x in keys else F.coalesce(own, its) if x in keys else _one(own, its)
    df = df.withColumns(made) if made else df
    gone = set(merge.values())
    return _joined(self, other, df.drop(*gone), [*a.slices, *(s for s in b.slices if s.column not in gone)])


def _merges(a: Dataset, b: Dataset, keys: dict[str, str], jointype: str, merge_same: Any) -> dict[str, str]:
    """Which columns of the right side become one with which of the left side."""
    if merge_same in (True, "all"):
        return keys | {a.slice(n).column: b.slice(n).column for n in a.Names if n in b.Names and a.slice(n).column not in keys}
    if merge_same == "equi":
        return keys
    if merge_same:  # names, or pairs of names
        return keys | {a.slice(x).column: b.slice(y).column for x, y in ((n, n) if isinstance(n, str) else n for n in merge_same)}
    return {x: y for x, y in keys.items() if _name(a, x) == _name(b, y)} if jointype == "inner" else {}


def _matched_arrays(self: Dataset, other: Dataset, keys_l: list[str], keys_r: list[str], jointype: str, merge_same: Any, mode: str) -> Dataset:
    """Equi-joins of arrays, for pairs of rows.

    Mode "dim" gives each row of self an array over all rows of other, so those are one value that goes to every task:
    the result holds that many places for each row. Mode "pos" joins rows by their places; different numbers of rows
    are an error.
    """
    from lattica.dataset import Dataset, Slice

    x, y = self.placed() if mode == "pos" else self, other.placed()
    if PLACES in x.df.columns:
        a = x._with(df=x.df.select(PLACES, *(F.col(f"`{s.column}`").alias(f"l{k}") for k, s in enumerate(x.slices))))
    else:
        a = x._with(df=x.df.select(*(F.col(f"`{s.column}`").alias(f"l{k}") for k, s in enumerate(x.slices)), *(F.col(f"`{c}`").alias(f"__o{k}") for k, c in enumerate(x.order_by))))
    a = a._with(slices=[replace(s, column=f"l{k}", marks=(s.marks - {"!L", "!R"}) | {"!L"}) for k, s in enumerate(x.slices)])
    b = y._with(df=y.df.select(PLACES, *(F.col(f"`{s.column}`").alias(f"r{k}") for k, s in enumerate(y.slices))))
    b = b._with(slices=[replace(s, column=f"r{k}", marks=(s.marks - {"!L", "!R"}) | {"!R"}) for k, s in enumerate(y.slices)])
    dim_l, dim_r = a.slice(keys_l[0]).dims[1], b.slice(keys_r[0]).dims[1]
    keys = {a.slice(p).column: b.slice(q).column for p, q in zip(keys_l, keys_r)}
    merge = _merges(a, b, keys, jointype, merge_same)
    in_l, in_r = ([s.column for s in ds.slices if d in s.dims] for ds, d in ((a, dim_l), (b, dim_r)))
    record = lambda columns: F.arrays_zip(*(F.col(c).alias(c) for c in columns))
    row_l, row_r = [s.column for s in a.slices if dim_l not in s.dims], [s.column for s in b.slices if dim_r not in s.dims]
    left = a.df.select(*(c for c in a.df.columns if c not in in_l), record(in_l).alias("__l"))
    right = b.df.select(PLACES, *row_r, record(in_r).alias("__r"))
    type_l, type_r = left.schema["__l"].dataType.elementType, right.schema["__r"].dataType.elementType
    gone = set(merge.values())
    inner = [(s, "l") for s in a.slices if s.column in in_l] + [(s, "r") for s in b.slices if s.column in in_r and s.column not in gone]

    def pairs(ls: Column, rs: Column) -> Column:
        """The records of one pair of arrays that match, left ones in their order."""
        same = lambda p, q: _all(p[c] == q[d] for c, d in keys.items())
        pair = lambda p, q: F.struct(p.alias("l"), q.alias("r"))
        none_l, none_r = F.lit(None).cast(type_l), F.lit(None).cast(type_r)

        def of(p: Column) -> Column:
            found = F.transform(F.filter(rs, lambda q: F.coalesce(same(p, q), F.lit(False))), lambda q: pair(p, q))
            return F.when(F.size(found) > 0, found).otherwise(F.array(pair(p, none_r))) if jointype in ("left", "full") else found

        out = F.flatten(F.transform(ls, of))
        if jointype in ("right", "full"):
            lone = F.filter(rs, lambda q: ~F.exists(ls, lambda p: F.coalesce(same(p, q), F.lit(False))))
            out = F.concat(out, F.transform(lone, lambda q: pair(none_l, q)))
        return out

    def value(s: Slice, side: str) -> Callable[[Column], Column]:
        if side == "l" and s.column in merge:
            both = lambda p: (p["l"][s.column], p["r"][merge[s.column]])
            return lambda p: F.coalesce(*both(p)) if s.column in keys else _one(*both(p))
        return lambda p: p[side][s.column]

    rows, dim = x.rows, f"{dim_l}_{dim_r}"
    slices, columns = [], []
    if mode == "pos":
        df = left.withColumn("__in_l", F.lit(True)).join(right.withColumn("__in_r", F.lit(True)), PLACES, "full")
        both = F.col("__in_l") & F.col("__in_r")
        df = df.withColumn("__m", F.when(both, pairs(F.col("__l"), F.col("__r"))).otherwise(F.raise_error(F.lit("Match: different numbers of rows"))))
        path, at = (rows, dim), lambda body: F.transform("__m", body)
        order = [PLACES]
    else:
        packed = F.sort_array(F.collect_list(F.struct(PLACES, *row_r, "__r")))
        df = left.crossJoin(F.broadcast(right.agg(packed.alias("__rows"))))  # one row
        df = df.withColumn("__m", F.transform("__rows", lambda q: pairs(F.col("__l"), q["__r"])))
        path, at = (rows, f"{y.rows}b", dim), lambda body: F.transform("__m", lambda ps: F.transform(ps, body))
        order = [c for c in left.columns if c == PLACES or c.startswith("__o")]
    for s in [*a.slices, *b.slices]:
        if s.column in gone:
            continue
        side = next((w for t, w in inner if t is s), None)
        if side:
            columns.append(at(value(s, side)))
            slices.append(replace(s, dims=path + s.dims[2:]))
        elif s.column in row_l or mode == "pos":
            columns.append(F.col(s.column))
            slices.append(replace(s, dims=(rows, *s.dims[1:])))
        else:
            columns.append(fields("__rows", s.column))
            slices.append(replace(s, dims=(path[1], *s.dims[1:])))
    df = df.select(*(c.alias(f"m{k}") for k, c in enumerate(columns)), *order)
    return Dataset(df, [replace(s, column=f"m{k}") for k, s in enumerate(slices)], rows, order)


def _all(conditions: Any) -> Column:
    return reduce(lambda p, q: p & q, conditions)


def _name(ds: Dataset, column: str) -> str:
    return next(s.name for s in ds.slices if s.column == column)


def Join(self: Dataset, other: Dataset, condition: Any) -> Dataset:
    """Join by any condition over both sides' slices; a name that both have is _.L.name or _.R.name."""
    from lattica.dataset import Dataset

    a, b = _sides(self, other)
    both = Dataset(a.df.join(b.df, F.lit(True)), [*a.slices, *b.slices], self.rows, [])
    both = both._with(slices=[replace(s, dims=tuple(self.rows if d == other.rows else d for d in s.dims)) for s in both.slices])
    c = both.compile(_sided(condition, a, b))
    return _joined(self, other, a.df.join(b.df, c.column), [*a.slices, *b.slices])


def _sided(e: Any, a: Dataset, b: Dataset) -> Any:
    """_.L.x and _.R.x as values of the sides."""
    if not isinstance(e, Expr):
        return e
    if e.kind == "field" and isinstance(e.args[0], Expr) and e.args[0].kind == "ref" and e.args[0].args[0] in ("L", "R"):
        ds = a if e.args[0].args[0] == "L" else b
        v = ds.value(ds.slice(e.args[1]))
        return Expr("value", (replace(v, dims=tuple(a.rows if d == b.rows else d for d in v.dims)),), label=e.args[1])
    return replace(e, args=tuple(_sided(x, a, b) for x in e.args))


def Cross(self: Dataset, other: Dataset) -> Dataset:
    """Every row with every row: as many rows as the product, which is the result asked for."""
    a, b = _sides(self, other)
    return _joined(self, other, a.df.crossJoin(b.df), [*a.slices, *b.slices])


def _membership(kind: str):
    def among(self: Dataset, key: Any, other: Dataset, other_key: Any = None) -> Dataset:
        keys, theirs = _pairs(key, self), _pairs(other_key if other_key is not None else key, other)
        right = other.df.select(*(F.col(f"`{other.slice(k).column}`").alias(f"__m{i}") for i, k in enumerate(theirs)))
        # A missing key is found where the other side has a missing one.
        on = [F.col(f"`{self.slice(k).column}`").eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(keys)]
        return self._with(df=self.df.join(right, on, kind))

    return among


def Combine(self: Dataset, other: Dataset) -> Dataset:
    """Slices of both side by side, aligned by place on the row dim; marked !L and !R. Different numbers of rows are an error."""
    a, b = self.placed(), other.placed()
    x, y = _sides(a, b)
    left = a.df.select(F.col("__pos"), *(F.col(f"`{s.column}`").alias(t.column) for s, t in zip(a.slices, x.slices)))
    right = b.df.select(F.col("__pos"), *(F.col(f"`{s.column}`").alias(t.column) for s, t in zip(b.slices, y.slices)))
    both = left.withColumn("__in_l", F.lit(True)).join(right.withColumn("__in_r", F.lit(True)), PLACES, "full")
    place = F.when(F.col("__in_l") & F.col("__in_r"), F.col(PLACES)).otherwise(F.raise_error(F.lit("Combine: different numbers of rows")).cast("long"))
    # The check is part of what is kept, so that no plan goes without it.
    both = both.withColumn(PLACES, place).where(F.col(PLACES) >= 0).drop("__in_l", "__in_r")
    out = _joined(self, other, both, [*x.slices, *y.slices])
    return out._with(order_by=[PLACES])


METHODS = {"Match": Match, "Join": Join, "Cross": Cross, "Among": _membership("left_semi"), "NotAmong": _membership("left_anti"), "Combine": Combine}
