"""Filters, joins, lookups, set operations."""

from lattica.expr import _
from lattica.plans.tables import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


@_r.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def filter_bool(t):
    return t("orders").Filter((_.o_totalprice > 100000) & (_.o_orderstatus == "O")).Get("o_orderkey", "o_totalprice")


@_r.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def filter_slice(t):
    return t("orders").Get("o_orderkey", "o_custkey")[10:30]


@_r.add("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p >= 5 AND (p - 5) % 7 = 0")
def filter_step(t):
    return t("orders").Get("o_orderkey")[5::7]


@_r.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 17")
def filter_int(t):
    return t("orders").Get("o_orderkey", "o_custkey")[17]


@_r.add("""SELECT o_orderkey FROM (VALUES (0, 3), (1, 0), (2, 3), (3, 12)) v(k, p)
  JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) o USING (p)""")
def filter_index_array(t):
    return t("orders").Get("o_orderkey")[[3, 0, 3, 12]]


@_r.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def in_semi(t):
    return t("customer").Get("c_custkey", "c_name").Among("c_custkey", t("orders"), "o_custkey")


@_r.add("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_in_anti(t):
    return t("customer").Get("c_custkey", "c_name").NotAmong("c_custkey", t("orders"), "o_custkey")


@_r.add("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS steel, p_size IN (1, 5, 9) AS few FROM part")
def contains(t):
    return t("part").Get("p_partkey", steel=_.p_type.SplitOnPattern(" ").Contains("STEEL"), few=_.p_size.In([1, 5, 9]))


@_r.add("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def match_inner(t):
    return t("nation").Match(t("region"), "n_regionkey", "r_regionkey").Get("n_nationkey", "n_name", "r_regionkey", "r_name")


def _by_flag(t, jointype, **options):
    left = t("orders").Filter(_.o_orderstatus == "O").Get("o_custkey", "o_orderkey")
    right = t("customer").Filter(_.c_acctbal > 0).Get("c_custkey", "c_acctbal")
    return left.Match(right, "o_custkey", "c_custkey", jointype=jointype, **options)


_SIDES = "(SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O') {} JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"


@_r.add("SELECT o_custkey, o_orderkey, c_custkey, c_acctbal FROM " + _SIDES.format("LEFT"))
def match_left(t):
    return _by_flag(t, "left")


@_r.add("SELECT o_custkey, o_orderkey, c_custkey, c_acctbal FROM " + _SIDES.format("RIGHT"))
def match_right(t):
    return _by_flag(t, "right")


@_r.add("SELECT o_custkey, o_orderkey, c_custkey, c_acctbal FROM " + _SIDES.format("FULL"))
def match_full(t):
    return _by_flag(t, "full")


@_r.add("SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_acctbal FROM " + _SIDES.format("FULL"))
def match_full_equi(t):
    return _by_flag(t, "full", merge_same="equi")


@_r.add("SELECT l_orderkey, l_linenumber, n FROM lineitem JOIN (SELECT l_orderkey AS k, l_linenumber AS m, count(*) AS n FROM lineitem GROUP BY 1, 2) ON l_orderkey = k AND l_linenumber = m")
def match_composite(t):
    items = t("lineitem").Get("l_orderkey", "l_linenumber")
    counted = items.GroupBy("l_orderkey", "l_linenumber").Get("l_orderkey", "l_linenumber", n=_.l_orderkey.Sum() * 0 + _.l_linenumber.Count())
    return items.Match(counted, ("l_orderkey", "l_linenumber")).Get("l_orderkey", "l_linenumber", "n")


@_r.add("""SELECT r_name, n_name, c_custkey, o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 48""")
def match_chain5(t):
    out = t("lineitem").Filter(_.l_quantity > 48).Match(t("orders"), "l_orderkey", "o_orderkey").Match(t("customer"), "o_custkey", "c_custkey")
    return out.Match(t("nation"), "c_nationkey", "n_nationkey").Match(t("region"), "n_regionkey", "r_regionkey").Get("r_name", "n_name", "c_custkey", "o_orderkey", "l_linenumber", "l_quantity")


@_r.add("""SELECT r_name, n_name, c_custkey, o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def match_chain5_whole(t):
    out = t("lineitem").Match(t("orders"), "l_orderkey", "o_orderkey").Match(t("customer"), "o_custkey", "c_custkey")
    return out.Match(t("nation"), "c_nationkey", "n_nationkey").Match(t("region"), "n_regionkey", "r_regionkey").Get("r_name", "n_name", "c_custkey", "o_orderkey", "l_linenumber", "l_quantity")


@_r.add("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def match_self(t):
    return t("nation").Get("n_name", "n_regionkey").Match(t("nation").Get("n_name", "n_regionkey").Rename("other", "n_regionkey"), "n_regionkey").Get(a=_.n_name, b=_.other)


@_r.add("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey > n_nationkey AND s_acctbal > n_nationkey * 300")
def join_theta(t):
    return t("supplier").Join(t("nation"), (_.s_nationkey > _.n_nationkey) & (_.s_acctbal > _.n_nationkey * 300)).Get("s_suppkey", "n_name")


@_r.add("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey >= b.n_nationkey")
def join_theta_sides(t):
    joined = t("nation").Get("n_nationkey").Join(t("nation").Get("n_nationkey"), _.L.n_nationkey >= _.R.n_nationkey)
    return joined.Rename("x", "y")


@_r.add("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_product(t):
    return t("region").Get("r_name").Cross(t("nation").Get("n_name"))


@_r.add("SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS c_nationkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON c_nationkey = n_nationkey")
def takefrom_keep(t):
    return t("customer").Get("c_custkey", "c_nationkey").TakeFrom("c_nationkey", t("nation").Filter(_.n_nationkey < 12).Get("n_nationkey", "n_name"), keep_missing=True)


@_r.add("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON c_nationkey = n_nationkey")
def takefrom_missing(t):
    return t("customer").Get("c_custkey", "c_nationkey").TakeFrom("c_nationkey", t("nation").Filter(_.n_nationkey < 12).Get("n_nationkey", "n_name", "n_regionkey"), allow_missing=True)


@_r.add("SELECT s_suppkey, n_name AS s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def replace_slice(t):
    return t("supplier").Get("s_suppkey", "s_nationkey").Replace("s_nationkey", t("nation"), "n_nationkey", "n_name")


@_r.add("SELECT o_custkey, o_orderkey, coalesce(o_custkey, c_custkey) AS either FROM " + _SIDES.format("FULL"))
def merge_slices(t):
    return _by_flag(t, "full").Get("o_custkey", "o_orderkey", either=_.o_custkey.Merge(_.c_custkey))


@_r.add("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t("customer").Get(k=_.c_nationkey).Union(t("supplier").Get("s_nationkey"))


@_r.add("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(t):
    return t("customer").Get(k=_.c_nationkey).Intersect(t("supplier").Filter(_.s_acctbal > 5000).Get("s_nationkey"))


@_r.add("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(t):
    return t("customer").Get(k=_.c_nationkey).Except(t("supplier").Filter(_.s_acctbal > 5000).Get("s_nationkey"))


@_r.add("""(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
  UNION (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def set_difference(t):
    return t("customer").Filter(_.c_acctbal > 9000).Get(k=_.c_nationkey).Difference(t("supplier").Filter(_.s_acctbal > 5000).Get("s_nationkey"))


@_r.add("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def stack_pos(t):
    return t("customer").Get(id=_.c_custkey, bal=_.c_acctbal).Stack(t("supplier").Get("s_suppkey", "s_acctbal"))


@_r.add("SELECT c_acctbal AS bal, c_custkey AS id FROM customer UNION ALL SELECT s_acctbal, s_suppkey FROM supplier")
def stack_name(t):
    return t("customer").Get(id=_.c_custkey, bal=_.c_acctbal).Stack(t("supplier").Get(bal=_.s_acctbal, id=_.s_suppkey), by="name")


@_r.add("SELECT c_custkey AS id, c_mktsegment AS seg, NULL::BIGINT AS n FROM customer UNION ALL SELECT s_suppkey, NULL, CAST(s_nationkey AS BIGINT) FROM supplier")
def stack_missing(t):
    return t("customer").Get(id=_.c_custkey, seg=_.c_mktsegment).Stack(t("supplier").Get(id=_.s_suppkey, n=_.s_nationkey.Cast("int64")), by="name", stack_missing=True)


@_r.add("SELECT n_name, n_regionkey, other FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) JOIN (SELECT n_name AS other, row_number() OVER (ORDER BY n_name DESC) AS p FROM nation) USING (p)")
def combine_by_place(t):
    return t("nation").Get("n_name", "n_regionkey").Combine(t("nation").Get(other="n_name").Sort("other", descend=True))
