import pytest
from pyspark.sql import functions as F

from solweave.model import Solutions
from solweave.operators import cells
from solweave.operators.selection import select, set_axis_values, set_values


@pytest.fixture(scope="module")
def grid(spark):
    """4 x 10 x 100 cells, value and weight counting up; the first cell is flagged."""
    df = spark.range(4000).select(
        F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.floor(F.col("id") / 1000) + 1).cast("int")).alias("axis1"),
        (F.floor(F.col("id") / 100) % 10).cast("double").alias("axis2"), (F.col("id") % 100).cast("double").alias("axis3"), F.col("id").cast("double").alias("val"), F.col("id").cast("double").alias("weight"),
    )
    t = Solutions.of(df, ["axis1", "axis2", "axis3"])
    return set_axis_values(t, "axis1", dict(zip("abcd", "efgh", strict=True)))


def shape(t):
    return tuple(t.df.select(a).distinct().count() for a in t.axes)


def test_documented_shapes(grid):
    one = select(grid, axis1=["f", "e", "h"], axis2=1.0, axis3={"min": 1, "max": 10})
    assert shape(one) == (3, 1, 10)
    two = select(grid, axis1=["e", "h"], axis2={"min": 2, "max": 5}, axis3={"min": 90, "max": 1e6})
    assert shape(two) == (2, 4, 10)
    assert {r["count"] for r in two.df.groupBy("axis1", "axis2").count().collect()} == {10}
    assert two.df.groupBy("axis1").count().count() == 2
    assert shape(select(grid, axis1=["f", "e", "h"], axis2=1.0, axis3=[1, 10])) == (3, 1, 2)


def test_kinds_of_selection(grid):
    assert shape(select(grid, axis1="[ef]")) == (2, 10, 100)
    assert shape(select(grid, axis2=slice(1, None, 4))) == (4, 3, 100)
    assert shape(select(grid, axis3=slice(-5, None))) == (4, 10, 5)
    assert shape(select(grid, axis3={"min": 10, "step": 30})) == (4, 10, 3)
    assert shape(select(grid, axis2=None, axis1=[], nothing=3)) == (4, 10, 100)
    assert shape(select(grid, axis1="zzz", axis2=99.0)) == (4, 10, 100)


def test_flags_and_updates(grid):
    assert cells.flagged_share(grid).first().flagged == pytest.approx(100 / 4000)
    new = grid.df.filter("axis3 = 0").select("axis1", "axis2", "axis3", F.lit(-1.0).alias("val"))
    out = set_values(grid, new)
    assert out.df.filter("val = -1").count() == 40 and out.df.count() == 4000


def test_nan_becomes_null_and_missing_weight_zero(spark):
    t = Solutions.of(spark.createDataFrame([(1, float("nan"), None, "x"), (2, 3.0, 0.5, "y")], "time int, val double, weight double, kind string"), ["time"])
    assert [(r.val, r.weight) for r in t.df.orderBy("time").collect()] == [(None, 0.0), (3.0, 0.5)]
    with pytest.raises(ValueError):
        Solutions.of(t.df, ["freq"])
    with pytest.raises(ValueError):
        Solutions.of(t.df, ["time"], "colour")


def test_group_operators_on_nulls_and_flags(spark):
    rows = [("a", i, 1.0 + i % 3, 1.0) for i in range(20)] + [("a", 50, 100.0, 1.0), ("a", 51, None, 1.0), ("b", 1, 5.0, 0.0), ("b", 2, None, 0.0)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, time int, val double, weight double"), ["ant", "time"])
    clipped = {(r.ant, r.time): r.weight for r in cells.clip(t, ["time"], 3).df.collect()}
    assert clipped[("a", 50)] == 0 and clipped[("a", 51)] == 1 and clipped[("a", 3)] == 1 and len(clipped) == 24
    everything = cells.clip(t, None, 3)
    assert everything.df.filter("weight = 0").count() == 3
    normed = cells.norm(t, ["time"], 2.0).df
    assert normed.filter("weight <> 0").agg(F.avg("val")).first()[0] == pytest.approx(2.0)
    assert normed.filter("ant = 'b' AND time = 1").first().val == 5.0
    empty = t.put(t.df.filter("false"))
    for out in (cells.clip(empty, ["time"], 3), cells.norm(empty, ["time"]), cells.absolute(empty), cells.reset(empty), cells.flag_defaults(empty)):
        assert out.df.count() == 0
