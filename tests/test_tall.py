"""Grids of few and long columns: operators that look along columns are linear in their length."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe import queries as core
from strataframe.operators import focal, rivers
from strataframe.operators.distance import distance

HEIGHT = 40_000


def _tall(spark):
    """Two columns with a seed in every 1,000th row of the first."""
    return spark.range(2 * HEIGHT).select((F.col("id") / 2).cast("int").alias("r"), (F.col("id") % 2).cast("int").alias("c")).withColumn("seed", F.expr("c = 0 and r % 1000 = 500"))


def _within(seconds, df):
    """df's rows by (r, c); a column of HEIGHT rows takes a second or two, and half a minute where work is its square."""
    df.sparkSession.range(1).count()
    began = time.perf_counter()
    rows = df.toPandas().sort_values(["r", "c"])
    assert time.perf_counter() - began < seconds
    return rows


def test_step_distance_of_long_columns(spark):
    got = _within(12, focal.step_distance(_tall(spark), F.col("seed")))
    r = np.arange(HEIGHT)
    up = np.abs(r[:, None] - np.arange(500, HEIGHT, 1000)).min(axis=1)
    assert got["steps"].tolist() == np.stack([up, up + 1], axis=1).ravel().tolist()


def test_distance_of_long_columns(spark):
    got = _within(12, distance(_tall(spark), F.col("seed")))
    r = np.arange(HEIGHT)
    up = np.abs(r[:, None] - np.arange(500, HEIGHT, 1000)).min(axis=1)
    assert np.allclose(got["d"], np.stack([up, np.hypot(up, 1)], axis=1).ravel())
    assert (np.abs(got["seed_r"] - got["r"]) == np.repeat(up, 2)).all()
    assert (got["seed_c"] == 0).all()


#: Queries whose plans may hold no frame from the current row to the end.
LINEAR = ["active_mask", "closing_fill", "erode_l1_sink", "edt", "sdf", "coastal_taper", "ramp", "feature_mask", "roughen_mask", "fractal_mask", "smooth_mask"]


@pytest.mark.parametrize("name", LINEAR)
def test_no_frame_to_the_end(name, spark, sf):
    plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().toString().lower()
    assert "unboundedfollowing" not in plan


def test_water_of_many_small_boxes(spark):
    """40,000 boxes within one square of 64 cells and 100,000 edges: as many pairs would take a minute."""
    rng = np.random.default_rng(3)
    low, ends = rng.random((40_000, 2)) * 63, rng.random((100_000, 4)) * 64
    boxes = spark.createDataFrame([(x, y, x + 0.05, y + 0.05) for x, y in low.tolist()], "c0 double, r0 double, c1 double, r1 double").cache()
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(ends.tolist())], "edge_id long, x0 double, y0 double, x1 double, y1 double").cache()
    assert boxes.count() + edges.count() == 140_000
    began = time.perf_counter()
    got = {r[0] for r in rivers.touching_water(edges, boxes).select("edge_id").collect()}
    assert time.perf_counter() - began < 10
    within = lambda p: ((p >= low) & (p <= low + 0.05)).all(axis=1).any()
    assert {i for i in got if i < 300} == {i for i in range(300) if within(ends[i, :2]) or within(ends[i, 2:])}


def test_cells_are_joined_by_shuffle_and_not_sent_to_the_driver(spark, sf, monkeypatch):
    """Tables of cells under the planner's limit for broadcasts as files may be many times that in a driver's memory."""
    from strataframe import views
    from strataframe.operators import components
    from strataframe.sources import store

    plans, whole = [], store.cut
    for module in (store, components):
        monkeypatch.setattr(module, "cut", lambda df: [plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df)][1])
    for few in (components.FEW_LINKS, 0):
        monkeypatch.setattr(components, "FEW_LINKS", few)
        components.level_lakes(views.both(spark, sf), "elev", F.col("m") == 0)
    assert sum("SortMergeJoin" in x for x in plans) >= 8
    assert not any("BroadcastHashJoin" in x for x in plans)
