"""Orders and running values over rows, without a task that gets them all."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.expr import Expr, Value
from lattica.functions import SEQUENCES
from lattica.tables import positions

if TYPE_CHECKING:
    from lattica.dataset import Dataset

#: Rows of a range within which running sums are made before the ranges' totals are added.
RANGE = 1 << 17


def along(ds: Dataset, named: dict[str, Expr]) -> Dataset:
    """Pos, CumSum, Rank and Argsort over rows beside all slices."""
    ds = ds.placed()
    df, added = ds.df, []
    for k, (name, e) in enumerate(named.items()):
        v = ds.compile(e.args[0])
        out, t = f"__s{k}", SEQUENCES[e.kind].result(v.type)
        descend = e.options.get("descend", False)
        if e.kind == "pos":
            df = df.withColumn(out, F.col("__pos"))
        elif e.kind == "cumsum":
            block = F.floor(F.col("__pos") / RANGE).cast("long")
            # One row for each RANGE rows is all that the window over blocks sorts.
            totals = df.groupBy(block.alias("__b")).agg(F.sum(v.column).alias("__t"))
            before = totals.select("__b", (F.coalesce(F.sum("__t").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
            within = F.sum(v.column).over(W.partitionBy("__b").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0))
            df = df.withColumn("__b", block).join(before, "__b").withColumn(out, (F.coalesce(within, F.lit(0)) + F.col("__before")).cast(t)).drop("__b", "__before")
        elif e.kind in ("rank", "argsort"):
            # Missing values come last; descending is ascending from behind. A rank's row goes along through the sort.
            n = df.count() if descend else 0
            keyed = df.withColumns({"__n": v.column.isNull(), "__v": v.column}) if e.kind == "rank" else df.select("__pos", v.column.isNull().alias("__n"), v.column.alias("__v"))
            ranked = positions(keyed, ["__n", "__v", "__pos"], "__rank").drop("__n", "__v")
            if descend:
                ranked = ranked.withColumn("__rank", F.lit(n - 1) - F.col("__rank"))
            if e.kind == "rank":
                df = ranked.withColumnRenamed("__rank", out)
            else:
                df = df.join(ranked.select(F.col("__rank").alias("__pos"), F.col("__pos").alias(out)), "__pos")
        else:
            raise ValueError(f"{e.kind} over rows")
        added.append((name, out, t))
    new = ds._with(df=df)
    return new.made([*((s.name, new.value(s), s.marks) for s in new.slices), *((n, Value(F.col(c), (ds.rows,), t), frozenset()) for n, c, t in added)])


def Sort(self: Dataset, *names: str, descend: bool = False) -> Dataset:
    """Rows in the order of slices, ties by their order so far; takes effect where places matter. Descending: that order from behind."""
    order = [self.slice(n).column for n in names] + [c for c in self.order_by if c not in {self.slice(n).column for n in names}]
    if not descend:
        return self._with(df=self.df.drop("__pos"), order_by=order)
    df = self.df.drop("__pos")
    turned = {}
    for k, c in enumerate(order):
        t = df.schema[c].dataType.simpleString()
        if t in ("bigint", "int", "double", "float", "smallint", "tinyint") or t.startswith("decimal"):
            turned[f"__d{k}"] = -F.col(c)
        elif t == "boolean":
            turned[f"__d{k}"] = ~F.col(c)
        elif t == "timestamp":
            turned[f"__d{k}"] = -F.unix_micros(c)
        else:
            return self._with(df=_reversed(df, order), order_by=["__reverse"])
    return self._with(df=df.withColumns(turned), order_by=list(turned))


def _reversed(df, order: list[str]):
    placed = positions(df, order, "__reverse")
    return placed.withColumn("__reverse", -F.col("__reverse"))


def Top(self: Dataset, k: int, *names: str, descend: bool = True) -> Dataset:
    """The k first rows by slices, ties by the row order: each task keeps k rows."""
    order = [F.col(self.slice(n).column).desc() if descend else F.col(self.slice(n).column).asc() for n in names]
    return self._with(df=self.df.orderBy(*order, *self.order_by).limit(k))


METHODS = {"Sort": Sort, "Top": Top}
