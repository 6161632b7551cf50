"""Small tables with known results."""

import pytest

from lattica.dataset import Dataset, rep
from lattica.expr import _


@pytest.fixture
def x(spark):
    return rep(spark, [[1, 2, 3], [4, 5, 6]], rows="d1")


@pytest.fixture
def g(spark):
    return rep(spark, list(zip([1, 1, 2, 2, 3, 3, 4, 4], [1, 2, 1, 2, 1, 2, 1, 2], [1, 2, 3, 4, 1, 2, 3, 4])))


def test_filters_along_dims(x):
    assert x.Filter(0).ToPython() == [1, 4]
    assert x.Filter(0, dim="d1").ToPython() == [[1, 2, 3]]
    assert x.Filter(_.data > 2).ToPython() == [[3], [4, 5, 6]]
    assert x.Filter(slice(0, 2)).ToPython() == [[1, 2], [4, 5]]
    assert x.Filter([0, 1]).ToPython() == [1, 5]
    assert x.Filter([0, 1], mode="dim").ToPython() == [[1, 2], [4, 5]]
    assert x.Filter([[0, 1], [0, 2]]).ToPython() == [[1, 5], [1, 6]]
    assert x.Filter([[0, 1], [0, 2, 1]], mode="dim").ToPython() == [[[1, 2], [1, 3, 2]], [[4, 5], [4, 6, 5]]]
    assert x.Filter([-1, 0], mode="dim").ToPython() == [[3, 1], [6, 4]]
    assert x.Filter(0, dim=0).ToPython() == [[1, 2, 3]]
    assert x[1:].ToPython() == [[4, 5, 6]]
    assert x[..., 1].ToPython() == [2, 5]
    assert x[0].ToPython() == [[1, 2, 3]]
    assert x[-1].ToPython() == [[4, 5, 6]]


def test_out_of_range_is_an_error(x):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|out of bounds"):
        x.Filter(7).ToPython()


def test_rows_that_are_not_there(x, spark):
    y = rep(spark, [1, 2, 3])
    assert y[[0, -1]].ToPython() == [1, 3]
    for key in ([0, 3], [-4], 7, -4):
        with pytest.raises(IndexError):
            y[key]
    with pytest.raises(ValueError, match="places for 2 rows"):
        x.Filter([0, 1, 2])


def test_combine_checks_numbers_of_rows(spark):
    two, three = rep(spark, [1, 2]).Rename("a"), rep(spark, [1, 2, 3]).Rename("b")
    assert [tuple(r.values()) for r in two.Combine(rep(spark, [5, 6]).Rename("b")).ToPython()] == [(1, 5), (2, 6)]
    for left, right in ((two, three), (three, two)):
        with pytest.raises(Exception, match="different numbers of rows"):
            left.Combine(right).ToPython()


def test_match_of_arrays(spark):
    x, y = rep(spark, [[1, 2], [1, 2, 3]]), rep(spark, [[2, 3, 4], [1, 3, 4]])
    assert x.Match(y, "data").ToPython() == [[[2], [1]], [[2, 3], [1, 3]]]
    assert x.Match(y, "data").Dims == {"data": ("d1", "d1b", "data_data")}
    assert x.Match(y, "data", mode="pos").ToPython() == [[2], [1, 3]]
    full = x.Match(y, "data", jointype="full", mode="pos")
    assert [list(r.values()) for r in full.ToPython()] == [[[1, 2, None, None], [None, 2, 3, 4]], [[1, 2, 3, None], [1, None, 3, 4]]]
    assert x.Match(y, "data", jointype="left", mode="pos", merge_same="equi").ToPython() == [[1, 2], [1, 2, 3]]
    assert x.Match(y, "data", jointype="right", mode="pos", merge_same="equi").ToPython() == [[2, 3, 4], [1, 3, 4]]
    with pytest.raises(Exception, match="different numbers of rows"):
        x.Match(rep(spark, [[1]]), "data", mode="pos").ToPython()
    with pytest.raises(ValueError, match="inner dim of both"):
        x.Match(rep(spark, [1, 2]), "data")
    p, q = rep(spark, [([1, 2], ["a", "b"], "p"), ([3], ["c"], "q")]), rep(spark, [([2, 3], [20, 30], 7)]).Rename("f0", "g", "h")
    both = p._with(slices=[s if k != 1 else s.__class__(s.name, s.column, ("d1", "f0")) for k, s in enumerate(p.slices)]).Match(q._with(slices=[s if k != 1 else s.__class__(s.name, s.column, ("d1", "f0")) for k, s in enumerate(q.slices)]), "f0")
    assert both.ToPython() == [{"f0": [[2]], "f1": [["b"]], "f2": "p", "g": [[20]], "h": [7]}, {"f0": [[3]], "f1": [["c"]], "f2": "q", "g": [[30]], "h": [7]}]


def test_flat_split_transpose(x, spark):
    assert x.Flat().ToPython() == [1, 2, 3, 4, 5, 6]
    both = x.AddSlice("s", "a").FlatAll()
    assert [tuple(r.values()) for r in both.ToPython()] == [(k, "a") for k in range(1, 7)]
    assert rep(spark, [1, 2, 3, 4, 5, 6]).SplitDim(3, 2).ToPython() == [[1, 2], [3, 4], [5, 6]]
    assert sorted(x.Transpose().ToPython()) == [[1, 4], [2, 5], [3, 6]]
    assert sorted(x.Transpose().Transpose().ToPython()) == [[1, 2, 3], [4, 5, 6]]


def test_splitdim_checks_sizes(spark):
    with pytest.raises(Exception, match="SplitDim"):
        rep(spark, [1, 2, 3]).SplitDim(2, 2).ToPython()


def test_harray_and_shape(spark, x):
    h = rep(spark, [(1, 2), (3, 4), (5, 6)]).HArray()
    assert [r["data"] for r in h.ToPython()] == [[1, 2], [3, 4], [5, 6]]
    assert h.ToPython()[0]["names"] == ["f0", "f1"]
    assert x.Shape().ToPython() == [{"d1": 2, "data": 3}, {"d1": 2, "data": 3}]


def test_groups(g):
    one = sorted((r["f0"], r["f1"], r["f2"]) for r in g.GroupBy("f0").Arrays().ToPython())
    assert one == [(1, [1, 2], [1, 2]), (2, [1, 2], [3, 4]), (3, [1, 2], [1, 2]), (4, [1, 2], [3, 4])]
    two = sorted((r["f1"], r["f2"], r["f0"]) for r in g.GroupBy("f1", "f2").Arrays().ToPython())
    assert two == [(1, 1, [1, 3]), (1, 3, [2, 4]), (2, 2, [1, 3]), (2, 4, [2, 4])]
    grid = g.GroupBy("f0", "f1").Grid(n=_.f2.Count(), s=_.f2.Sum()).ToPython()
    assert len(grid) == 8 and all(r["n"] == 1 for r in grid)


def test_grid_of_arrays(g):
    grid = g.GroupBy("f0", "f1").GridArrays()
    assert grid.Dims == {"f0": ("gf0",), "f1": ("gf1",), "f2": ("gf0", "gf1", "gd1")}
    assert [tuple(r.values()) for r in grid.ToPython()] == [(1, [1, 2], [[1], [2]]), (2, [1, 2], [[3], [4]]), (3, [1, 2], [[1], [2]]), (4, [1, 2], [[3], [4]])]
    copied = g.Get("f0", "f1", "f2", f3=_.f1).GroupBy("f0", "f1").GridArrays({("f0", "f1"): "f2", "f1": "f3"})
    assert copied.Dims == {"f0": ("gf0",), "f1": ("gf1",), "f2": ("gf0", "gf1"), "f3": ("gf1",)}
    assert [tuple(r.values()) for r in copied.ToPython()] == [(k, [1, 2], v, [1, 2]) for k, v in ((1, [1, 2]), (2, [3, 4]), (3, [1, 2]), (4, [3, 4]))]
    assert g.GroupBy("f1").Index().ToPython() == [{"f1": 1, "index": [0, 2, 4, 6]}, {"f1": 2, "index": [1, 3, 5, 7]}]
    assert sorted(g.Get("f1").GroupIndex().ToPython()) == [[0, 2, 4, 6], [1, 3, 5, 7]]
    assert sorted(g.GroupBy("f0").Get(u=_.f2.Argunique()).ToPython()) == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_arrays_dicts_and_each(spark, x):
    assert rep(spark, [[3, 1, 3, None, 1]]).Get(u=_.data.Argunique()).ToPython() == [[1, 0]]
    assert x.Array(1).Each(sum, dtype="int64").ToPython() == [6, 15]
    assert rep(spark, [4, 5, 6]).Array().Each(sum, dtype="int64").ToPython() == [15]
    two = rep(spark, [(1, 2), (3, None)])
    assert two.Each(lambda a, b: (a or 0) + (b or 0), dtype="int64").ToPython() == [3, 3]
    assert two.Each(lambda a: (a or 0) * 2, dtype="int64", per_slice=True).ToPython() == [{"f0": 2, "f1": 4}, {"f0": 6, "f1": 0}]
    assert two.Dict().ToPython() == [{"f0": 1, "f1": 2}, {"f0": 3}]
    assert two.Dict(with_missing=True).ToPython() == [{"f0": 1, "f1": 2}, {"f0": 3, "f1": None}]
    assert rep(spark, [("a", 1), ("b", 2), ("a", 3)]).IndexDict().ToPython() == [{"a": 3, "b": 2}]
    cube = rep(spark, [[[1, 2], [3, 4]], [[5, 6], [7, 8]]])
    assert cube.Transpose([0, 2, 1]).ToPython() == [[[1, 3], [2, 4]], [[5, 7], [6, 8]]]
    assert cube.Transpose([2, 0, 1]).ToPython() == [[[1, 3], [5, 7]], [[2, 4], [6, 8]]]
    assert cube.Transpose([2, 0, 1]).Transpose([1, 2, 0]).ToPython() == cube.ToPython()
    assert rep(spark, [[1, 2, 3, 4, 5, 6]]).SplitDim(2, 3, dim="data").ToPython() == [[[1, 2, 3], [4, 5, 6]]]
    with pytest.raises(Exception, match="SplitDim"):
        rep(spark, [[1, 2, 3]]).SplitDim(2, 2, dim="data").ToPython()
    a, b = rep(spark, [(1, "x"), (2, "y")]), rep(spark, [("y", 2), ("z", 3)])
    assert sorted(a.Intersect(b, slices=("f0", "f1")).ToPython()) == [2]
    assert sorted(a.Union(b, slices=(("f1", "f0"), ("f0", "f1"))).ToPython(), key=str) == [{"f1": "x", "f0": 1}, {"f1": "y", "f0": 2}, {"f1": "z", "f0": 3}]


def test_no_sort_of_all_rows_where_only_the_order_counts(g):
    text = lambda ds: ds.df._jdf.queryExecution().executedPlan().toString()
    for ds in (g.Unique("f0"), g.GroupBy("f0").Get("f0", a=_.f2.First())):
        assert "rangepartitioning" not in text(ds) and "__pos" not in text(ds)


def test_grid_has_empty_cells(spark):
    d = rep(spark, [(1, "a", 5), (2, "b", 6)])
    cells = {(r["f0"], r["f1"]): (r["n"], r["m"]) for r in d.GroupBy("f0", "f1").Grid(n=_.f2.Count(), m=_.f2.Max()).ToPython()}
    assert cells == {(1, "a"): (1, 5), (1, "b"): (0, None), (2, "a"): (0, None), (2, "b"): (1, 6)}


def test_group_aggregates_are_plain_aggregates(g):
    plan = g.GroupBy("f0").Get("f0", s=_.f2.Sum(), n=_.f1.Count()).df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan


def test_missing_keys(spark):
    d = rep(spark, [(None, 1), (None, 2), (1, 3)], dtype="[d]<(k=int64?, v=int64)")
    assert d.GroupBy("k").Get("k", n=_.v.Count()).Len() == 2
    assert d.GroupBy("k", missing="each").Get("k", n=_.v.Count()).Len() == 3


def test_theta_join(spark):
    a, b = rep(spark, [1, 2, 3, 4, 5]).Rename("x"), rep(spark, [3, 4, 5, 6, 7, 8]).Rename("y")
    assert sorted((r["x"], r["y"]) for r in a.Join(b, _.x >= _.y).ToPython()) == [(3, 3), (4, 3), (4, 4), (5, 3), (5, 4), (5, 5)]


@pytest.fixture
def sides(spark):
    return rep(spark, [("a", 1), ("b", 2), ("c", 3), ("c", 4)]), rep(spark, [("a", "test1"), ("d", "test2"), ("c", "test3")])


def _rows(ds: Dataset):
    return sorted((tuple(r) for r in ds.toDF().collect()), key=repr)


def test_match(sides):
    a, b = sides
    assert _rows(a.Match(b, "f0")) == [("a", 1, "test1"), ("c", 3, "test3"), ("c", 4, "test3")]
    assert ("b", 2, None, None) in _rows(a.Match(b, "f0", jointype="left"))
    assert (None, None, "d", "test2") in _rows(a.Match(b, "f0", jointype="full"))
    assert [r[0] for r in _rows(a.Match(b, "f0", jointype="full", merge_same="equi"))] == ["a", "b", "c", "c", "d"]
    with pytest.raises(Exception, match="unequal"):
        a.Match(b.Rename("f0", "f1"), "f0", jointype="full", merge_same=True).toDF().withColumn("z", _col("f1")).collect()


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_arithmetic_broadcasts_over_dims(spark):
    r = rep(spark, [([1, 2], 0.5), ([3, 4, 5], 0.3), ([6, 7, 8, 9], 0.8)])
    sums = r.Get(s=_.f0 + _.f1).ToPython()
    assert [[round(v, 6) for v in row] for row in sums] == [[1.5, 2.5], [3.3, 4.3, 5.3], [6.8, 7.8, 8.8, 9.8]]
    assert r.Get(s=_.f0.Sum()).ToPython() == [3, 12, 30]
    assert round(r.Reduce(t=_.f1.Sum()).ToPython()[0], 6) == 1.6


def test_numbers_like_integers_divide(spark):
    d = rep(spark, [(-7, 3), (7, -3), (7, 2), (0, 0), (5, 0)])
    assert d.Get(q=_.f0 / _.f1).ToPython() == [-3, -3, 3, 0, None]
    assert d.Get(m=_.f0 % _.f1).ToPython() == [2, -2, 1, None, None]


def test_in_and_contains_never_null(spark):
    d = rep(spark, [([1, None], 2), ([1, None], None), ([1], None)], dtype="[d]<(a=[x]<int64, b=int64?)")
    assert d.Get(m=_.b.In(_.a)).ToPython() == [False, True, False]


def test_lookup(spark):
    d, t = rep(spark, [1, 2, 3]).Rename("k"), rep(spark, [(1, "x"), (1, "y"), (2, "z")])
    assert sorted(d.TakeFrom("k", t, allow_missing=True).ToPython(), key=repr) == sorted(["y", "z", None], key=repr)
    with pytest.raises(Exception, match="no entry"):
        d.TakeFrom("k", t).ToPython()


def test_sets_and_stack(spark):
    a, b = rep(spark, [1, 2, 2, 3]), rep(spark, [2, 3, 4])
    assert sorted(a.Union(b).ToPython()) == [1, 2, 3, 4]
    assert sorted(a.Intersect(b).ToPython()) == [2, 3]
    assert a.Except(b).ToPython() == [1]
    assert sorted(a.Difference(b).ToPython()) == [1, 4]
    assert len(a.Stack(b).ToPython()) == 7


def test_sequence_functions_of_arrays(spark):
    d = rep(spark, [[3, 1, 2], [5, 5]])
    got = d.Get(p=_.data.Pos(), c=_.data.CumSum(), s=_.data.Argsort(), r=_.data.Rank(), t=_.data.Sorted()).ToPython()
    assert got[0] == {"p": [0, 1, 2], "c": [3, 4, 6], "s": [1, 2, 0], "r": [2, 0, 1], "t": [1, 2, 3]}
    assert got[1]["s"] == [0, 1] and got[1]["r"] == [0, 1]


def test_reductions_of_nothing(spark):
    d = rep(spark, [[]], dtype="[d]<[x]<int64")
    got = d.Get(s=_.data.Sum(), p=_.data.Prod(), m=_.data.Max(), n=_.data.Count(), a=(_.data > 0).Any(), b=(_.data > 0).All()).ToPython()[0]
    assert got == {"s": 0, "p": 1, "m": None, "n": 0, "a": False, "b": True}


def test_middle_dim_reduction(spark):
    d = rep(spark, [[[1, 2], [3, 4]], [[5, 6]]])
    dims = d.slices[0].dims
    assert d.Get(s=_.data.Sum(dim=dims[1])).ToPython() == [[4, 6], [5, 6]]


def test_unique_and_sort(spark):
    d = rep(spark, [(2, "a"), (1, "b"), (2, "c")])
    assert _rows(d.Unique("f0")) == [(1, "b"), (2, "a")]
    assert [r["f1"] for r in d.Sort("f0")[0:3].ToPython()] == ["b", "a", "c"]
    assert [r["f1"] for r in d.Sort("f0", descend=True)[0:2].ToPython()] == ["c", "a"]


def test_correlations_take_all_places(spark):
    import numpy as np

    from lattica.operators.correlation import correlations

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 20)) + 1e6
    x[:, 7] += 0.5 * x[:, 3]
    x[:, 9] = 4.1
    rows = [[float(v) for v in r] for r in x]
    rows[5][4] = None
    rows[6] = rows[6][:15]
    rows[7] = None
    has = np.array([[r is not None and k < len(r) and r[k] is not None for k in range(20)] for r in rows])
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(3)
    got = {(r.i, r.j): r.r for r in correlations(df, "v").collect()}
    assert set(got) == {(i, j) for i in range(20) for j in range(20)}
    for (i, j), r in got.items():
        both = has[:, i] & has[:, j]
        assert r is None if 9 in (i, j) else abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert {(r.i, r.j): r.r for r in correlations(df, "v", 8).collect()}.keys() == {(i, j) for i in range(8) for j in range(8)}
    assert correlations(spark.createDataFrame([], "v array<float>"), "v").collect() == []
