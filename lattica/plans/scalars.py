"""Projection and functions of elements."""

from lattica.expr import _
from lattica.plans.tables import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


@_r.add("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price, l_quantity + l_tax AS x, -l_quantity AS neg FROM lineitem")
def proj_arith(t):
    return t("lineitem").Get("l_orderkey", "l_linenumber", price=_.l_extendedprice * (1 - _.l_discount), x=_.l_quantity + _.l_tax, neg=-_.l_quantity)


@_r.add("""SELECT p_partkey, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS div, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS fdiv,
  CAST((p_size - 25) - floor((p_size - 25) / 7.0) * 7 AS BIGINT) AS rest, CAST((p_size - 25) - floor((p_size - 25) / -7.0) * -7 AS BIGINT) AS nrest, CAST(pow(p_size, 2) AS BIGINT) AS sq FROM part""")
def div_floor_mod(t):
    x = _.p_size - 25
    return t("part").Get("p_partkey", div=x / 7, fdiv=x // 7, rest=x % 7, nrest=x % -7, sq=_.p_size**2)


@_r.add("""SELECT l_orderkey, l_linenumber, l_quantity > 25 AND l_discount < 0.05 AS a, l_quantity > 25 OR l_discount < 0.05 AS o,
  (l_quantity > 25) != (l_discount < 0.05) AS x, NOT (l_quantity <= 10) AS n, l_returnflag = 'R' AS e, l_returnflag <> 'R' AS d, l_linenumber >= 3 AS g FROM lineitem""")
def compare_bool_ops(t):
    big, cheap = _.l_quantity > 25, _.l_discount < 0.05
    return t("lineitem").Get("l_orderkey", "l_linenumber", a=big & cheap, o=big | cheap, x=big ^ cheap, n=~(_.l_quantity <= 10), e=_.l_returnflag == "R", d=_.l_returnflag != "R", g=_.l_linenumber >= 3)


@_r.add("SELECT l_orderkey, l_linenumber, CAST(l_linenumber & 5 AS BIGINT) AS a, CAST(l_linenumber | 8 AS BIGINT) AS o, CAST(xor(l_linenumber, 3) AS BIGINT) AS x, ~l_linenumber AS n FROM lineitem")
def bit_ops(t):
    return t("lineitem").Get("l_orderkey", "l_linenumber", a=_.l_linenumber & 5, o=_.l_linenumber | 8, x=_.l_linenumber ^ 3, n=~_.l_linenumber)


@_r.add("SELECT p_partkey, ln(p_retailprice) AS l, log2(p_retailprice) AS l2, log10(p_retailprice) AS l10, sqrt(p_retailprice) AS s, CAST(abs(p_size - 25) AS BIGINT) AS a FROM part")
def log_sqrt_abs_neg(t):
    x = _.p_retailprice
    return t("part").Get("p_partkey", l=x.Log(), l2=x.Log2(), l10=x.Log10(), s=x.Sqrt(), a=(_.p_size - 25).Abs().Cast("int64"))



@_r.add("""SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, p_type LIKE '%BRASS' AS k, p_name ILIKE '%A_%' AS ik, regexp_matches(p_type, '^[A-M]') AS h,
  regexp_matches(p_type, '(?i)^[a-m]') AS ih, p_brand || '/' || p_type AS c FROM part""")
def upper_lower_like_pattern(t):
    return t("part").Get(
        "p_partkey", u=_.p_name.Upper(), l=_.p_brand.Lower(), k=_.p_type.Like("%BRASS"), ik=_.p_name.Like("%A_%", ignore_case=True), h=_.p_type.HasPattern("^[A-M]"),
        ih=_.p_type.HasPattern("^[a-m]", ignore_case=True), c=_.p_brand + "/" + _.p_type,
    )


@_r.add("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS p_type FROM part")
def split_pattern_flat(t):
    return t("part").Get("p_partkey", _.p_type.SplitOnPattern(r"\s+")).Flat()


@_r.add("SELECT p_partkey, len(string_split(p_type, ' ')[1]) AS n, string_split(p_type, ' ')[1] AS first FROM part")
def split_pattern_max(t):
    parts = _.p_type.SplitOnPattern(" ", max_splits=1)
    return t("part").Get("p_partkey", first=parts[0]).Get("p_partkey", "first", n=_.first.SplitOnPattern("").Count())


@_r.add("SELECT unnest(string_split(p_brand, '')) AS p_brand FROM part")
def text_elems(t):
    return t("part").Get("p_partkey", brand=_.p_brand).Get("brand", "p_partkey").Rename("p_brand", "p_partkey").Without("p_partkey").Elems().Flat()


@_r.add("""SELECT c_custkey, o_orderkey IS NULL AS missing, coalesce(o_orderkey, 0) AS o, coalesce(o_orderpriority, '') AS p, coalesce(o_totalprice, -1) AS q
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def missing_isnull_replace(t):
    both = t("customer").Match(t("orders"), "c_custkey", "o_custkey", jointype="left")
    return both.Get("c_custkey", missing=_.o_orderkey.IsMissing(), o=_.o_orderkey.ReplaceMissing(), p=_.o_orderpriority.ReplaceMissing(), q=_.o_totalprice.ReplaceMissing(value=-1.0))


@_r.add("""SELECT c_custkey, (o_totalprice > 0) AND (c_acctbal < 0) AS a, (o_totalprice > 0) OR (c_acctbal < 0) AS o, o_totalprice + 1 AS p
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def missing_logic(t):
    both = t("customer").Match(t("orders"), "c_custkey", "o_custkey", jointype="left")
    return both.Get("c_custkey", a=(_.o_totalprice > 0) & (_.c_acctbal < 0), o=(_.o_totalprice > 0) | (_.c_acctbal < 0), p=_.o_totalprice + 1)


@_r.add("SELECT o_orderkey AS key, o_totalprice AS price, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS bad FROM orders")
def get_rename_cast(t):
    return t("orders").Get("o_orderkey", "o_totalprice").Rename("key", "price").Get("*", text=_.key.Cast("string"), whole=(_.price // 1).Cast("int64")).Get("key", "price", "whole", "text", bad=("x" + _.text).Cast("int64?"))



@_r.add("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey + 1 AS n_regionkey, 'x' AS tag FROM nation")
def to_add_without(t):
    return t("nation").Get("*", gone=_.n_nationkey).Without("gone").To("n_name", Do=_.Upper()).To("n_regionkey", Do=lambda x: (x + 1).Cast("int32")).AddSlice("tag", "x")


@_r.add("SELECT s_suppkey AS a_s_suppkey_b, s_name AS a_s_name_b FROM supplier")
def prefix_postfix(t):
    return t("supplier").Get("s_suppkey", "s_name").PrefixName("a_").PostfixName("_b")


@_r.add("SELECT n_name, n_regionkey, n_nationkey + n_regionkey AS s FROM nation")
def tuple_fields(t):
    return t("nation").Get("n_name", "n_regionkey", s=(_.n_nationkey + _.n_regionkey)).Tuple("rec").Get(n_name=_.rec.Field("n_name"), n_regionkey=_.rec.Field("n_regionkey"), s=_.rec.Field("s"))


@_r.add("SELECT r_regionkey, r_name FROM region")
def bookmarks(t):
    return t("region").Bookmark(r_name="label", r_regionkey="label").Get("*", other=_.r_name).B("label")


@_r.add("SELECT doc_id, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS e FROM documents")
def each_udf(t):
    return t("documents").Get("doc_id", n=_.text.Each(lambda x: len(x), dtype="int64"), e=_.text.Each(lambda x: x.count("e"), dtype="int64"))


@_r.add("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
def each_table(t):
    return t("part").Get("p_partkey", w=_.p_type.Each(lambda x: x.split(" "), dtype="[x:~]<string")).Flat()
