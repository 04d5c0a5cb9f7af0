"""Selections against NumPy's own indexing."""

import itertools

import numpy as np
import pandas as pd
import pytest

from lattispark.operators import cells as C
from lattispark.plans.selection import DiscontiguousArrayError, Gather, Points, Range, UnsupportedVIndexingError, normalise, result_shape

AXIS = [slice(None), slice(1, 7), slice(None, None, 3), slice(8, 2, -2), slice(5, 5), 3, -1, [1, 2, 3], [6, 0, 3, 3], np.array([4])]


def picked(selection, x):
    """The selection, applied with NumPy."""
    axes = [np.arange(n) for n in x.shape]
    out = np.empty(selection.result_shape, x.dtype)
    for place in np.ndindex(*selection.result_shape):
        where = [0] * x.ndim
        at = dict(zip(selection.out, place, strict=True))
        for k, s in enumerate(selection.axes):
            if s is None:
                p = selection.points
                flat = int(np.ravel_multi_index([at["points", d] for d in range(len(p.shape))], p.shape)) if p.shape else 0
                where[k] = p.at[p.axes.index(k)][flat]
            elif isinstance(s, Range):
                where[k] = s.start + s.step * at[k]
            elif isinstance(s, Gather):
                where[k] = s.at[at[k]]
            else:
                where[k] = s.at
        out[place] = x[tuple(axes[k][w] for k, w in enumerate(where))]
    return out


def wanted(x, index, mode):
    if mode == "plain":
        return x[index]
    index = index if isinstance(index, tuple) else (index,)
    lists = [np.atleast_1d(np.arange(n)[i]) for n, i in zip(x.shape, index, strict=True)]
    drop = tuple(k for k, i in enumerate(index) if isinstance(i, (int, np.integer)))
    return x[np.ix_(*lists)].squeeze(axis=drop)


@pytest.mark.parametrize("mode", ["plain", "outer"])
@pytest.mark.parametrize("rank", [1, 2, 3])
def test_all_combinations(mode, rank):
    x = np.arange(10**rank).reshape((10,) * rank)
    choices = AXIS if rank < 3 else AXIS[::2]
    for index in itertools.product(choices, repeat=rank):
        try:
            want = wanted(x, index, mode)
        except IndexError:
            with pytest.raises(IndexError):
                normalise(index, x.shape, mode)
            continue
        selection = normalise(index, x.shape, mode)
        assert selection.result_shape == want.shape, index
        assert (picked(selection, x) == want).all(), index


@pytest.mark.parametrize("index", [([1, 7], slice(None), [4, 7]), (slice(None), [1, 7], [4, 7]), ([[1], [2]], [3, 4]), (2, slice(1, 3), [5, 6]), (Ellipsis, 0), (2, Ellipsis, slice(0, 5)), ([True] * 3 + [False] * 7,)])
def test_numpy_placement_of_arrays(index):
    x = np.arange(1000).reshape(10, 10, 10)
    selection = normalise(index, x.shape)
    want = x[tuple(np.array(i) if isinstance(i, list) else i for i in index)]
    assert selection.result_shape == want.shape == result_shape(index, x.shape)
    assert (picked(selection, x) == want).all()


@pytest.mark.parametrize("index", [10, -11, (0, 0, 0, 0), (Ellipsis, Ellipsis), ([10],), ([1.5],), ([True],), True])
def test_bad_indices(index):
    with pytest.raises(IndexError):
        normalise(index, (10, 10, 10))


def test_unknown_selector_and_mode():
    with pytest.raises(ValueError):
        normalise("x", (10,))
    with pytest.raises(ValueError):
        normalise(0, (10,), "other")
    with pytest.raises(IndexError):
        normalise(([1], slice(None)), (10, 10), "pointwise")


def test_strict_refusals():
    for index in (slice(None, None, 2), ([0, 5],), ([2, 1],)):
        with pytest.raises(DiscontiguousArrayError):
            normalise(index, (10, 10), strict=True)
    with pytest.raises(UnsupportedVIndexingError):
        normalise(([1, 2], [3, 4]), (10, 10), strict=True)
    with pytest.raises(UnsupportedVIndexingError):
        normalise(([3, 3],), (10, 10), strict=True)
    for index in (slice(2, 5), 3, ([1, 2, 3], 4), Ellipsis):
        normalise(index, (10, 10), strict=True)


def test_contiguous_list_becomes_range_and_points_stay_points():
    assert normalise(([1, 2, 3],), (10,)).axes[0] == Range(1, 3)
    assert isinstance(normalise(([1, 2], [3, 5]), (10, 10)).points, Points)


@pytest.mark.parametrize("index,mode", [((slice(1, 7), 3), "plain"), (([6, 0, 3, 3], slice(8, 2, -2)), "plain"), (([6, 0, 3], [1, 1, 4]), "plain"), (([6, 0], [1, 4]), "outer"), ((slice(5, 5),), "plain"), ((3, 4), "plain")])
def test_cells_match_numpy(spark, index, mode):
    x = np.arange(100).reshape(10, 10)
    places = np.indices(x.shape).reshape(2, -1)
    cells = spark.createDataFrame(pd.DataFrame({"i0": places[0], "i1": places[1], "value": x.ravel()}))
    want = wanted(x, index, mode)
    got = C.select(cells, index, x.shape, mode).collect()
    assert len(got) == want.size
    for row in got:
        assert want[tuple(row[:-1])] == row[-1]


def test_later_values_win_where_places_repeat(spark):
    cells = spark.createDataFrame([(k, 0) for k in range(4)], "i0 long, value long")
    values = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "i0 long, value long")
    out = dict(map(tuple, C.assign(cells, ([1, 2, 1],), (4,), values).collect()))
    x = np.zeros(4, int)
    x[[1, 2, 1]] = [10, 11, 12]
    assert [out[k] for k in range(4)] == x.tolist()


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(100).selectExpr("id as i0", "id div 7 as c0", "id as value", "id as other").write.partitionBy("c0").parquet(path)
    plan = C.select(spark.read.parquet(path), slice(5, 23), (100,), chunks=(7,))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(i0), GreaterThanOrEqual(i0,5), LessThanOrEqual(i0,22)]" in plan
    assert "PartitionFilters: [isnotnull(c0" in plan and "other" not in plan.split("ReadSchema")[-1]
