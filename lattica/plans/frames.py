"""Reductions and groups."""

from lattica.expr import _
from lattica.plans.tables import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


@_r.add("SELECT o_custkey, count(*) AS out_degree FROM orders GROUP BY 1")
def group_single(t):
    return t("orders").GroupBy("o_custkey").Get("o_custkey", _.o_orderkey.Count() / "out_degree")


@_r.add("""SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, sum(l_quantity) AS q, max(l_extendedprice) AS mx, min(l_extendedprice) AS mn, avg(l_quantity) AS av, median(l_quantity) AS md,
  stddev_pop(l_quantity) AS sd, bool_or(l_discount > 0.09) AS an, bool_and(l_quantity > 0) AS al, count(*) AS n FROM lineitem GROUP BY 1""")
def agg_all(t):
    q, p = _.l_quantity, _.l_extendedprice
    return t("lineitem").GroupBy("l_returnflag").Get("l_returnflag", s=_.l_linenumber.Sum(), q=q.Sum(), mx=p.Max(), mn=p.Min(), av=q.Mean(), md=q.Median(), sd=q.Std(), an=(_.l_discount > 0.09).Any(), al=(q > 0).All(), n=q.Count())


@_r.add("""SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n, avg(l_linenumber) AS m, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM lineitem""")
def agg_whole(t):
    return t("lineitem").Reduce(s=_.l_linenumber.Sum(), n=_.l_orderkey.Count(), m=_.l_linenumber.Mean(), big=(_.l_quantity > 25).Sum())


@_r.add("SELECT n_regionkey, CAST(product(n_nationkey % 3 + 1) AS BIGINT) AS p FROM nation GROUP BY 1")
def agg_prod(t):
    return t("nation").GroupBy("n_regionkey").Get("n_regionkey", p=(_.n_nationkey % 3 + 1).Prod())


@_r.add("""SELECT o_orderpriority, CAST(arg_max(p, (o_totalprice, -p)) AS BIGINT) AS hi, CAST(arg_min(p, (o_totalprice, p)) AS BIGINT) AS lo
  FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1""")
def agg_argmax_argmin(t):
    return t("orders").GroupBy("o_orderpriority").Get("o_orderpriority", hi=_.o_totalprice.Argmax(), lo=_.o_totalprice.Argmin())


@_r.add("SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def agg_string_concat(t):
    return t("nation").GroupBy("n_regionkey").Get("n_regionkey", names=_.n_name.Sum())


@_r.add("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segs FROM customer GROUP BY 1")
def agg_set(t):
    return t("customer").GroupBy("c_nationkey").Get("c_nationkey", segs=_.c_mktsegment.Set())


@_r.add("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1, 2")
def group_composite(t):
    return t("lineitem").GroupBy("l_returnflag", "l_linestatus").Get("l_returnflag", "l_linestatus", n=_.l_orderkey.Count(), revenue=(_.l_extendedprice * (1 - _.l_discount)).Sum())


@_r.add("""SELECT a.c_nationkey, b.c_mktsegment, CAST(coalesce(n, 0) AS BIGINT) AS n, s FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9500) a
  CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 9500) b
  LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n, max(c_acctbal) AS s FROM customer WHERE c_acctbal > 9500 GROUP BY 1, 2) USING (c_nationkey, c_mktsegment)""")
def group_dense2d(t):
    return t("customer").Filter(_.c_acctbal > 9500).GroupBy("c_nationkey", "c_mktsegment").Grid(n=_.c_custkey.Count(), s=_.c_acctbal.Max())


@_r.add("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def group_flat(t):
    return t("orders").Get("o_custkey", "o_orderpriority", "o_orderkey").GroupBy("o_custkey", flat=["o_orderpriority"]).Arrays()


@_r.add("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1 HAVING count(*) > 12")
def group_having(t):
    return t("orders").GroupBy("o_custkey").Get("o_custkey", n=_.o_orderkey.Count(), s=_.o_totalprice.Sum()).Filter(_.n > 12)


@_r.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def group_having_rows(t):
    return t("orders").GroupBy("o_custkey")[_.o_orderkey.Count() > 12].Flat().Get("o_orderkey", "o_custkey")


@_r.add("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, sum(l_quantity) / count(*) AS per FROM lineitem GROUP BY 1")
def group_distinct_count(t):
    return t("lineitem").GroupBy("l_suppkey").Get("l_suppkey", parts=_.l_partkey.CountDistinct(), per=_.l_quantity.Sum() / _.l_quantity.Count())


@_r.add("SELECT degree, count(*) AS n FROM (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1) GROUP BY 1")
def degree_distribution(t):
    return t("orders").GroupBy("o_custkey").Get(degree=_.o_orderkey.Count()).GroupBy("degree").Get("degree", n=_.degree.Count())


@_r.add("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def unique_rep(t):
    return t("orders").Get("o_custkey", "o_orderkey", "o_orderpriority").Unique("o_custkey", "o_orderpriority")


@_r.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(t):
    return t("orders").Get("o_orderkey", "o_totalprice").Top(25, "o_totalprice")


@_r.add("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10 OFFSET 5")
def sort_then_slice(t):
    return t("orders").Get("o_custkey", "o_orderkey").Sort("o_custkey")[5:15]
