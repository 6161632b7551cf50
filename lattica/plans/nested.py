"""Inner dims: arrays, matrices, broadcasting, shape."""

from lattica.expr import _
from lattica.operators.correlation import correlations
from lattica.plans.tables import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql


@_r.add("SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2 + label) AS y FROM embeddings")
def array_elem_ops(t):
    return t("embeddings").Get("vec_id", y=_.embedding.Cast("real64") * 2.0 + _.label)


@_r.add("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s, CAST(len(embedding) AS BIGINT) AS n, list_max(embedding) AS mx, list_min(embedding) AS mn FROM embeddings")
def nested_sum(t):
    e = _.embedding
    return t("embeddings").Get("vec_id", s=e.Sum(), n=e.Count(), mx=e.Max(), mn=e.Min())


@_r.add("SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings")
def vec_norm(t):
    x = _.embedding.Cast("real64")
    return t("embeddings").Get("vec_id", norm=(x * x).Sum().Sqrt())


@_r.add("SELECT vec_id, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m, list_median(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS md, list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS sd FROM embeddings")
def nested_stats(t):
    e = _.embedding
    return t("embeddings").Get("vec_id", m=e.Mean(), md=e.Median(), sd=e.Std())


@_r.add("SELECT vec_id, list_filter(embedding, lambda x: x > 0) AS embedding FROM embeddings")
def nested_filter(t):
    return t("embeddings").Get("vec_id", "embedding").Filter(_.embedding > 0)


@_r.add("SELECT vec_id, embedding[3] AS third, embedding[len(embedding)] AS last, embedding[2:4] AS part FROM embeddings")
def nested_index(t):
    e = _.embedding
    return t("embeddings").Get("vec_id", third=e[2], last=e[-1], part=e[1:4])


@_r.add("SELECT vec_id, unnest(embedding) AS embedding, unnest(range(len(embedding))) AS p, label FROM embeddings")
def flat_arrays(t):
    return t("embeddings").Get("vec_id", "embedding", "label", p=_.embedding.Pos()).Flat()


@_r.add("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS hi, CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS lo FROM embeddings")
def nested_argmax(t):
    e = _.embedding
    return t("embeddings").Get("vec_id", hi=e.Argmax(), lo=e.Argmin())



@_r.add("SELECT vec_id, list_sort(embedding) AS s FROM embeddings")
def nested_sort(t):
    return t("embeddings").Get("vec_id", s=_.embedding.Sorted())


@_r.add("SELECT unnest(['n_nationkey', 'n_regionkey']) AS names, unnest([n_nationkey, n_regionkey]) AS data FROM nation")
def harray_unpivot(t):
    both = t("nation").Get("n_nationkey", "n_regionkey").HArray()
    return both.Flat()



@_r.add("SELECT j AS p, list(v ORDER BY vec_id) AS embedding FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS j FROM embeddings) GROUP BY j")
def transpose(t):
    turned = t("embeddings").Get("embedding").Transpose()
    return turned.Along(p=_.embedding.Pos()).Get("p", "embedding")


@_r.add("SELECT list(n_name ORDER BY n_nationkey) AS n_name FROM nation GROUP BY n_nationkey // 5")
def splitdim(t):
    return t("nation").Get("n_name").SplitDim(5, 5)


@_r.add("SELECT p_partkey, len(string_split(p_type, ' ')) AS x, list_transform(string_split(p_type, ' '), lambda w: w || p_brand) AS y FROM part")
def ragged_broadcast(t):
    words = t("part").Get("p_partkey", "p_brand", w=_.p_type.SplitOnPattern(" "))
    return words.Get("p_partkey", x=_.w.Count(), y=_.w + _.p_brand)


@_r.add("SELECT p_partkey, list_aggregate(list_transform(string_split(p_type, ' '), lambda w: w), 'string_agg', '') AS joined FROM part")
def nested_string_sum(t):
    return t("part").Get("p_partkey", joined=_.p_type.SplitOnPattern(" ").Sum())


@_r.add("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, p_size FROM part")
def flatall(t):
    return t("part").Get("p_partkey", "p_size", w=_.p_type.SplitOnPattern(" ")).FlatAll()


@_r.add("SELECT (SELECT count(*) FROM part) AS part, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS sw FROM part")
def shape_lengths(t):
    return t("part").Get(w=_.p_type.SplitOnPattern(" ", dim="sw")).Shape()


_NATIONS = "a AS (SELECT n_regionkey AS k, list(n_nationkey ORDER BY n_nationkey) AS v FROM nation GROUP BY 1), b AS (SELECT s_suppkey % 7 AS k, list(DISTINCT s_nationkey ORDER BY s_nationkey) AS v FROM supplier GROUP BY 1)"


def _two(t):
    """Nations by region, and suppliers' nations by a remainder: two tables with arrays."""
    a = t("nation").GroupBy("n_regionkey").Arrays().Get("n_regionkey", v=_.n_nationkey)
    b = t("supplier").Get(k=_.s_suppkey % 7, v=_.s_nationkey).Unique("k", "v").Sort("k", "v").GroupBy("k").Arrays()
    return a, b


@_r.add(f"WITH {_NATIONS} SELECT x.n_regionkey, y.k, z.v FROM (SELECT k AS n_regionkey, v FROM a) x CROSS JOIN b y CROSS JOIN LATERAL (SELECT unnest(x.v) AS v) z WHERE list_contains(y.v, z.v)")
def match_arrays_dim(t):
    a, b = _two(t)
    return a.Match(b, "v").FlatAll()


@_r.add(f"WITH {_NATIONS} SELECT x.n_regionkey, y.k, z.v FROM (SELECT k AS n_regionkey, v, row_number() OVER (ORDER BY k) AS p FROM a) x JOIN (SELECT *, row_number() OVER (ORDER BY k) AS p FROM b WHERE k < 5) y USING (p) CROSS JOIN LATERAL (SELECT unnest(x.v) AS v) z WHERE list_contains(y.v, z.v)")
def match_arrays_pos(t):
    a, b = _two(t)
    return a.Match(b.Filter(_.k < 5), "v", mode="pos").FlatAll()


@_r.add("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey)[[1, 3, 2, 5, 4][n_regionkey + 1]] AS n_nationkey FROM nation GROUP BY 1")
def filter_each_place(t):
    return t("nation").GroupBy("n_regionkey").Arrays().Get("n_regionkey", "n_nationkey").Filter([0, 2, 1, 4, -2], dim="gnation")


@_r.add("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey)[1] AS a, list(n_nationkey ORDER BY n_nationkey)[5] AS b FROM nation GROUP BY 1")
def filter_places_dim(t):
    picked = t("nation").GroupBy("n_regionkey").Arrays().Get("n_regionkey", "n_nationkey").Filter([0, -1], dim="gnation", mode="dim")
    return picked.Get("n_regionkey", a=_.n_nationkey[0], b=_.n_nationkey[1])


@_r.add("""WITH k AS (SELECT DISTINCT o_orderstatus FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_orderkey) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(s, 0) AS BIGINT) AS s FROM k CROSS JOIN p LEFT JOIN c USING (o_orderstatus, o_orderpriority)""")
def grid_arrays(t):
    cells = t("orders").Get("o_orderpriority", "o_orderstatus", "o_orderkey").GroupBy("o_orderpriority", "o_orderstatus").GridArrays()
    return cells.Get("o_orderpriority", "o_orderstatus", n=_.o_orderkey.Count(), s=_.o_orderkey.Sum()).FlatAll()


@_r.add("SELECT list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS index FROM nation GROUP BY n_regionkey")
def group_index(t):
    return t("nation").GroupIndex("n_regionkey")


@_r.add("SELECT p_partkey, list_transform(list_sort(list_distinct(w)), lambda x: CAST(list_position(w, x) - 1 AS BIGINT)) AS at FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS w FROM part)")
def nested_argunique(t):
    words = t("part").Get("p_partkey", w=(_.p_type + " " + _.p_name).SplitOnPattern(" "))
    return words.Get("p_partkey", at=_.w.Argunique())


@_r.add("SELECT n_regionkey, list(CAST(p AS BIGINT) ORDER BY x) AS at FROM (SELECT n_regionkey, substr(n_name, 1, 1) AS x, min(n_nationkey) AS p FROM nation GROUP BY 1, 2) GROUP BY 1")
def group_argunique(t):
    named = t("nation").Get("n_regionkey", "n_name", x=_.n_name.SplitOnPattern("")[0])
    return named.GroupBy("n_regionkey").Get("n_regionkey", at=_.x.Argunique())


@_r.add("SELECT vec_id, list_transform(range(8), lambda j: list_transform(range(8), lambda k: embedding[k * 8 + j + 1])) AS m FROM embeddings")
def transpose_inner(t):
    cut = t("embeddings").Get("vec_id", m=_.embedding).SplitDim(8, 8, "a", "b", dim="embedding")
    return cut.SwapInner("a")


@_r.add("SELECT list(list_transform(range(8), lambda k: embedding[k * 8 + j + 1]) ORDER BY vec_id) AS m FROM (SELECT vec_id, embedding, unnest(range(8)) AS j FROM embeddings) GROUP BY j")
def transpose_order(t):
    return t("embeddings").Get(m=_.embedding).SplitDim(8, 8, "a", "b", dim="embedding").Transpose([2, 0, 1])


@_r.add("SELECT n_regionkey, CAST(len(list(n_name)) AS BIGINT) AS n, max(n_nationkey) AS top FROM nation GROUP BY 1")
def array_each(t):
    packed = t("nation").GroupBy("n_regionkey").Arrays().Array(1)
    return packed.Get("n_regionkey", n=_.n_name.Each(len, dtype="int64"), top=_.n_nationkey.Each(max, dtype="int32"))


@_r.add("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def dict_of_slices(t):
    from pyspark.sql import functions as F

    both = t("nation").Get(name="n_name", region=_.n_regionkey.Cast("string")).Dict()
    keys = t("nation").Get("n_nationkey")
    df = both.Combine(keys).toDF()
    return df.select("n_nationkey", F.col("data")["name"].alias("name"), F.col("data")["region"].alias("region"))


@_r.add("SELECT p_partkey, p_size AS last FROM part")
def index_dict(t):
    from pyspark.sql import functions as F

    pairs = t("part").Get("p_partkey", k=(_.p_type + " x x").SplitOnPattern(" "), v=_.p_size)
    pairs = pairs.Promote("v", "k").Get("k", "v", "p_partkey")
    made = pairs.Get("k", "v").IndexDict("d")
    df = made.Combine(pairs.Get("p_partkey")).toDF()
    return df.select("p_partkey", F.col("d")["x"].alias("last"))


@_r.add("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, p_size, 1 AS n FROM part")
def promote_redim_newdim(t):
    words = t("part").Get("p_partkey", "p_size", w=_.p_type.SplitOnPattern(" "), u=_.p_type.SplitOnPattern(" "))
    one = words.Redim("word", w=words.slice("w").dims[1], u=words.slice("u").dims[1]).Promote("p_size", "w")
    longer = one.Get("p_partkey", "p_size", "w").InsertDim("new").Level(3)
    return longer.FlatAll().Get("p_partkey", "w", "p_size", n=_.p_size * 0 + 1)


@_r.add("SELECT p_partkey, list_sort(list_distinct(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')))) AS u, list_sort(list_intersect(string_split(p_type, ' '), string_split(p_name, ' '))) AS i FROM part")
def set_algebra(t):
    sets = t("part").Get("p_partkey", a=_.p_type.SplitOnPattern(" ").Pack(), b=_.p_name.SplitOnPattern(" ").Pack())
    return sets.Get("p_partkey", u=(_.a | _.b), i=(_.a & _.b)).Elems().Get("p_partkey", u=_.u.Sorted(), i=_.i.Sorted())


@_r.add("""WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT a.j AS i, b.j AS j, corr(a.v, b.v) AS r FROM f a JOIN f b USING (vec_id) WHERE a.j < 8 AND b.j < 8 GROUP BY 1, 2""")
def corr_matrix(t):
    return correlations(t("embeddings").df, "embedding", 8)


@_r.add("""WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT a.j AS i, b.j AS j, corr(a.v, b.v) AS r FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2""")
def corr_matrix_whole(t):
    return correlations(t("embeddings").df, "embedding")
