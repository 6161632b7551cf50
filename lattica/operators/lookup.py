"""Lookups in a two-column table: dictionaries, replacement, merging."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.expr import Value
from lattica.operators.groups import order_of

if TYPE_CHECKING:
    from lattica.dataset import Dataset


def _table(source: Dataset, key: str | int, *values: str | int) -> DataFrame:
    """__key and __v0 …, each key once: of equal keys the last row by place, or the greatest where rows have no order."""
    columns = [F.col(f"`{source.slice(v).column}`").alias(f"__v{k}") for k, v in enumerate(values)]
    if source.order_by:
        last = F.max_by(F.struct(*columns), order_of(source))
    else:
        last = F.max(F.struct(*columns))
    return source.df.groupBy(F.col(f"`{source.slice(key).column}`").alias("__key")).agg(last.alias("__found")).select("__key", "__found.*")


def TakeFrom(self: Dataset, name: str, source: Dataset, allow_missing: bool = False, keep_missing: bool = False) -> Dataset:
    """A slice's values looked up in source's first slice, replaced by what its other slices hold there.

    A value that isn't there is an error; allow_missing: missing; keep_missing: the value itself.
    """
    others = source.Names[1:]
    s = self.slice(name)
    own = F.col(f"`{s.column}`")
    table = _table(source, 0, *range(1, len(source.slices))).withColumn("__there", F.lit(True))
    df = self.df.join(table, own == F.col("__key"), "left").drop("__key")
    kinds = [source.df.schema[x.column].dataType for x in source.slices[1:]]

    def found(k: int):
        there = F.col(f"__v{k}")
        if keep_missing:
            return F.when(F.col("__there"), there).otherwise(own.cast(kinds[k]))
        if allow_missing:
            return there
        return F.when(F.col("__there") | own.isNull(), there).otherwise(F.raise_error(F.concat(F.lit("TakeFrom: no entry "), own.cast("string"))).cast(kinds[k]))

    with_found = self._with(df=df)
    chosen = []
    for x in self.slices:
        if x is s:
            chosen += [(name if len(others) == 1 else n, Value(found(k), s.dims, kinds[k]), s.marks) for k, n in enumerate(others)]
        else:
            chosen.append((x.name, with_found.value(x), x.marks))
    return with_found.made(chosen)


def Replace(self: Dataset, name: str, translator: Dataset, from_: str, to: str) -> Dataset:
    """A slice's values translated by an inner join; rows without a translation go, several translations give several rows."""
    s = self.slice(name)
    pairs = translator.df.select(F.col(f"`{translator.slice(from_).column}`").alias("__key"), F.col(f"`{translator.slice(to).column}`").alias("__to"))
    df = self.df.join(pairs, F.col(f"`{s.column}`") == F.col("__key")).drop("__key", s.column).withColumnRenamed("__to", s.column)
    return self._with(df=df)


def IndexDict(self: Dataset, name: str = "data") -> Dataset:
    """The first two slices as a dictionary along their last shared dim; of equal keys the last wins. Along rows: one dictionary of all."""
    from pyspark.sql import types as T

    key, value = (self.value(s) for s in self.slices[:2])
    if key.dims == (self.rows,):
        from lattica.dataset import Dataset, Slice

        last = _table(self, 0, 1).where(F.col("__key").isNotNull())
        one = last.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__key", "__v0")))).alias("c0"))
        return Dataset(one, [Slice(name, "c0", ())], None)

    def latest(entries: Any) -> Any:
        """Sorted by key and place, the last of each key: no entry is held against all others."""
        ordered = F.array_sort(F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))), lambda e: e["k"].isNotNull()))
        ends = lambda s: F.filter(s, lambda e, j: F.coalesce(F.get(s, j + 1)["k"] != e["k"], F.lit(True)))
        return F.transform(F.get(F.transform(F.array(ordered), ends), F.lit(0)), lambda e: F.struct(e["k"], e["v"]))

    made = F.map_from_entries(latest(F.zip_with(key.column, value.column, lambda k, v: F.struct(k.alias("k"), v.alias("v")))))
    return self.made([(name, Value(made, key.dims[:-1], T.MapType(key.type, value.type)), frozenset())])


def MergeWith(self: Dataset, name: str, other: str, as_: str | None = None) -> Dataset:
    """Two slices as one: the value that isn't missing; two different ones are an error."""
    from lattica.expr import col

    return self.Get(*(n for n in self.Names if n not in (name, other)), **{as_ or name: col(name).Merge(col(other))})


METHODS: dict[str, Any] = {"TakeFrom": TakeFrom, "Replace": Replace, "IndexDict": IndexDict, "MergeWith": MergeWith}
