"""Sequence functions over rows; windows over the events table as a stream's would be."""

from lattica.expr import _
from lattica.plans.tables import Registry
from lattica.streaming import windowed_counts

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


@_r.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS c FROM orders")
def pos_cumsum(t):
    return t("orders").Get("o_orderkey", "o_custkey").Along(p=_.o_orderkey.Pos(), c=_.o_custkey.CumSum()).Get("o_orderkey", "p", "c")


@_r.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS r FROM orders")
def rank_rows(t):
    return t("orders").Get("o_orderkey", "o_custkey").Along(r=_.o_custkey.Rank()).Get("o_orderkey", "r")


@_r.add("""SELECT a.o_orderkey, b.p AS s FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) a
  JOIN (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS k, p FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)) b ON a.p = b.k""")
def argsort_rows(t):
    return t("orders").Get("o_orderkey", "o_custkey").Along(s=_.o_custkey.Argsort()).Get("o_orderkey", "s")


@_r.add("""SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag)) / stddev_pop(l_quantity) OVER (PARTITION BY l_returnflag) AS z FROM lineitem""")
def whiten(t):
    items = t("lineitem").Get("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    stats = items.GroupBy("l_returnflag").Get("l_returnflag", m=_.l_quantity.Mean(), sd=_.l_quantity.Std())
    return items.Match(stats, "l_returnflag").Get("l_orderkey", "l_linenumber", z=(_.l_quantity - _.m) / _.sd)


@_r.add("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""")
def event_windows(t):
    return windowed_counts(t("events").df)
