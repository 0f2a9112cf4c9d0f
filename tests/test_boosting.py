"""Boosted trees against trees grown one split at a time over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodos.operators import boosting
from hodos.operators.boosting import BoostSettings


def data(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    hour, road, load = rng.integers(0, 24, n), rng.integers(0, 9, n), np.round(rng.normal(size=n), 3)
    y = 40 + 10 * np.cos(hour / 24 * 6.283) + 7 * ((road * 5) % 9 > 4) + 3 * load * (hour > 12) + rng.normal(size=n)
    return hour, load, road, np.round(y, 6)


def frame(spark, columns):
    rows = [(int(h), float(x), int(r), float(v)) for h, x, r, v in zip(*columns)]
    return spark.createDataFrame(rows, "hour int, load double, road int, y double").repartition(5)


def one_by_one(bins, y, is_category, settings, width):
    """A tree grown by the plain rule: always the leaf of the largest gain, rows looked at anew."""
    slope = y.mean() - y
    leaves = {0: np.arange(len(y))}
    depth, splits, next_id = {0: 0}, [], 1

    def split_of(rows):
        histogram = np.zeros((bins.shape[1], width, 2))
        for j in range(bins.shape[1]):
            histogram[j, :, 0] = np.bincount(bins[rows, j], minlength=width)
            histogram[j, :, 1] = np.bincount(bins[rows, j], slope[rows], width)
        return boosting.best_split(histogram, is_category, settings.least_rows)

    while len(leaves) < settings.leaves:
        found = {i: split_of(r) for i, r in leaves.items() if depth[i] < settings.depth}
        found = {i: s for i, s in found.items() if s}
        if not found:
            break
        i = max(found, key=lambda k: found[k][0])
        gain, j, at, sides = found[i]
        own = bins[leaves[i], j]
        left = sides[own] if sides is not None else own <= at
        rows = leaves.pop(i)
        leaves[next_id], leaves[next_id + 1] = rows[left], rows[~left]
        depth[next_id] = depth[next_id + 1] = depth[i] + 1
        next_id += 2
        splits.append((round(gain, 6), j, int(left.sum())))
    return splits, {tuple(sorted(r)): -slope[r].mean() for r in leaves.values()}


@pytest.mark.parametrize("leaves, depth", [(2, 15), (7, 15), (31, 15), (31, 3)])
def test_one_tree_is_the_one_grown_split_by_split(spark, leaves, depth):
    columns = data()
    settings = BoostSettings(trees=1, leaves=leaves, depth=depth, rate=1.0, least_rows=40, bins=16)
    model = boosting.fit(frame(spark, columns), "y", ["hour", "load"], {"road": 9}, settings)
    hour, load, road, y = columns
    bins = model.binning.matrix([hour, load, road])
    splits, want = one_by_one(bins, y, [False, False, True], settings, model.binning.width)
    tree = model.trees[0]
    inner = [i for i in range(len(tree.feature)) if tree.feature[i] >= 0]
    assert sorted((round(tree.gain[i], 6), int(tree.feature[i]), int(tree.rows[tree.left[i]])) for i in inner) == sorted(splits)
    at = tree.leaves_of(bins)
    assert len(set(at)) == len(want) <= leaves
    for rows, value in want.items():
        assert len(set(at[list(rows)])) == 1 and tree.value[at[rows[0]]] == pytest.approx(value)


def test_boosting_learns_and_cuts_its_rows(spark, folder):
    rows = frame(spark, data())
    fitted = [boosting.fit(rows, "y", ["hour", "load"], {"road": 9}, BoostSettings(12, 15, 6, 0.3, 20, 32, cut)) for cut in (4, 100)]
    scores = [m.predict(rows).select(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("e"), F.avg(F.abs(F.col("y") - m.base)).alias("plain")).first() for m in fitted]
    assert scores[0].e == pytest.approx(scores[1].e, rel=1e-9) and scores[0].e < 0.3 * scores[0].plain
    boosting.save(fitted[0], spark, folder)
    again = boosting.load(spark, folder)
    key = lambda m: sorted(r.prediction for r in m.predict(rows).collect())
    assert key(again) == pytest.approx(key(fitted[0]), abs=1e-12)


def test_odd_rows_and_nothing_to_learn(spark):
    schema = "hour int, load double, road int, y double"
    none = boosting.fit(spark.createDataFrame([], schema), "y", ["hour", "load"], {"road": 9}, BoostSettings(3))
    same = boosting.fit(spark.createDataFrame([(1, 0.5, 2, 7.0)] * 30, schema), "y", ["hour", "load"], {"road": 9}, BoostSettings(3, least_rows=1))
    probe = spark.createDataFrame([(None, None, None, None), (5, float("nan"), 99, 1.0), (-1, 1e300, -3, 1.0)], schema).withColumn("_0", F.lit("x"))
    assert [r.prediction for r in none.predict(probe).collect()] == [0.0] * 3
    assert [r.prediction for r in same.predict(probe).collect()] == [7.0] * 3 and same.predict(probe).columns == [*probe.columns, "prediction"]


def test_few_jobs_a_tree(spark):
    """As many passes over the rows as the tree is deep, not as it has splits."""
    passes = []
    histograms = boosting._histograms
    try:
        boosting._histograms = lambda *a: (passes.append(len(a[3])), histograms(*a))[1]
        boosting.fit(frame(spark, data()), "y", ["hour", "load"], {"road": 9}, BoostSettings(1, 40, 15, 1.0, 10, 32))
    finally:
        boosting._histograms = histograms
    assert len(passes) <= 15 and sum(passes) >= 40


def test_large_trees_take_few_jobs_too(spark):
    """While few splits are left, no job is spent on one node after the other (F8, F18, F19)."""
    passes = []
    histograms = boosting._histograms
    try:
        boosting._histograms = lambda *a: (passes.append(len(a[3])), histograms(*a))[1]
        model = boosting.fit(frame(spark, data()), "y", ["hour", "load"], {"road": 9}, BoostSettings(1, 255, 15, 1.0, 2, 255))
    finally:
        boosting._histograms = histograms
    reached = boosting.nodes(model, spark)
    assert reached.where("feature < 0").count() == 255 and len(passes) <= 16


def test_rows_of_equal_bins_are_one(spark):
    """The passes are over the different rows, however often each comes."""
    rows = frame(spark, data(300)).select("hour", F.lit(1.0).alias("load"), "road", "y")
    often = rows.crossJoin(spark.range(7)).drop("id")
    binning = boosting.fit_bins(often, ["hour", "load"], {"road": 9}, 255)
    once = boosting._binned(often, "y", binning)
    assert once.count() == rows.select("hour", "road").distinct().count()
    sums = once.agg(F.sum("n"), F.sum("total")).first()
    assert sums[0] == 2100 and sums[1] == pytest.approx(often.agg(F.sum("y")).first()[0])
