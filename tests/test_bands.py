"""Masks and distances made in one shuffle: results across the borders of bands and blocks, and what their plans hold."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe import queries as core
from strataframe.functions import noise
from strataframe.operators import blocks, distance, focal, lines


def _cells(spark, values, top=0):
    rows = [(r + top, c, bool(v), f"{r},{c}") for (r, c), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "r int, c int, m boolean, name string")


def _table(df, column, shape):
    out = np.full(shape, None, object)
    for x in df.collect():
        out[x["r"], x["c"]] = x[column]
        assert "name" not in df.columns or x["name"] == f"{x['r']},{x['c']}"
    return out


@pytest.mark.parametrize("share", [0.03, 0.5])
def test_distances_across_bands(spark, monkeypatch, share):
    monkeypatch.setattr(blocks, "BAND_ROWS", 3)
    seeds = np.random.default_rng(7).random((20, 9)) < share
    seeds[4, 2] = True
    got = distance.with_distances(_cells(spark, seeds), d=F.col("m"), none=F.lit(False)).cache()
    for (r, c), d in np.ndenumerate(_table(got, "d", seeds.shape)):
        assert math.isclose(d, min(math.hypot(r - a, c - b) for a, b in np.argwhere(seeds)))
    seed_r, seed_c = _table(got, "d_r", seeds.shape), _table(got, "d_c", seeds.shape)
    assert all(seeds[a, b] for a, b in zip(seed_r.ravel(), seed_c.ravel(), strict=True))
    assert got.where("none is not null or none_r is not null or none_c is not null").count() == 0


@pytest.mark.parametrize("steps", [1, 3])
def test_closing_across_blocks(spark, monkeypatch, steps):
    mask = np.random.default_rng(8).random((23, 17)) < 0.1

    def near(seeds):
        at = np.argwhere(seeds)
        return np.array([[min(abs(r - a) + abs(c - b) for a, b in at) <= steps for c in range(17)] for r in range(23)])

    def far(a):
        r, c = np.indices(a.shape)
        return a & ~near(~a) & (np.minimum(np.minimum(r + 1, 23 - r), np.minimum(c + 1, 17 - c)) > steps)

    whole = blocks.mask_over_blocks
    monkeypatch.setattr(focal, "mask_over_blocks", lambda *a: whole(*a, size=4))
    cells = _cells(spark, mask)
    assert (_table(focal.dilated(cells, F.col("m"), steps), "dilated", mask.shape) == near(mask)).all()
    assert (_table(focal.eroded(cells, ~F.col("m"), steps), "eroded", mask.shape) == far(~mask)).all()
    assert (_table(focal.closed(cells, F.col("m"), steps), "closed", mask.shape) == (mask | far(near(mask)))).all()


def test_bridges_across_blocks(spark, monkeypatch):
    mask = np.random.default_rng(9).random((19, 14)) < 0.2

    def far(seeds):
        return np.array([[min((math.hypot(r - a, c - b) for a, b in np.argwhere(seeds)), default=math.inf) for c in range(14)] for r in range(19)])

    whole = blocks.mask_over_blocks
    monkeypatch.setattr(lines, "mask_over_blocks", lambda *a: whole(*a, size=4))
    wide = far(mask) <= 1.5
    want = mask | (wide & (far(~wide) > 1.5))
    assert (_table(lines.bridged(_cells(spark, mask), F.col("m"), 1.5), "bridged", mask.shape) == want).all()


#: Joins in the plans of queries: those of their views only, once for the summary and once for the cells.
JOINS = {"sdf": 0, "coastal_taper": 0, "ramp": 2, "roughen_mask": 0, "fractal_mask": 0, "smooth_mask": 0, "closing_fill": 0, "erode_l1_sink": 0}


@pytest.mark.parametrize("name", JOINS)
def test_cells_are_not_joined_or_sorted_along_columns(name, spark, sf):
    plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == JOINS[name]
    assert "windowspecdefinition(c#" not in plan or "__seed" in plan  # windows see a band's summary at most
    if name in ("closing_fill", "erode_l1_sink"):
        assert "Window" not in plan


def test_noise_is_compiled(spark):
    """Interpreted, a million cells took over ten seconds."""
    cells = spark.range(1_000_000).selectExpr("cast(id div 100 as int) r", "cast(id % 100 as int) c")
    at = noise.add(cells, "n", noise.fractal(noise.perlin), F.col("c") * 0.125, F.col("r") * 0.125, 42)
    began = time.perf_counter()
    at.agg(F.sum("n")).collect()
    assert time.perf_counter() - began < 8


def test_only_the_mask_is_thinned(spark, monkeypatch):
    mask = np.zeros((30, 30), bool)
    mask[3:8, 2:28] = True
    seen, whole = [], lines.over_blocks
    monkeypatch.setattr(lines, "over_blocks", lambda cells, *a: seen.append(cells.count()) or whole(cells, *a))
    got = lines.skeleton(_cells(spark, mask), F.col("m"))
    want = {tuple(map(int, x)) for x in np.argwhere(lines.thinned(mask, 100))}
    assert {(x["r"], x["c"]) for x in got.collect()} == want
    assert max(seen) == mask.sum()


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_links_of_one_task_and_of_rounds(spark, monkeypatch, few):
    from strataframe.operators import components

    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = np.random.default_rng(10)
    links = [*((int(a), int(b)) for a, b in rng.integers(0, 400, (180, 2))), *((i + 1, i) for i in range(1000, 1060)), (7, 7)]
    least = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.contracted(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted((x["id"], x["root"]) for x in got) == sorted(least.items())


def test_lakes_take_one_join_of_their_cells(spark, monkeypatch):
    """Links in one task need no rounds, and cells are joined with their level only."""
    from strataframe.operators import components
    from strataframe.sources import store

    lake = np.random.default_rng(11).random((25, 20)) < 0.4
    cells = spark.createDataFrame([(r, c, bool(v), float((r * 7 + c * 13) % 31), "x") for (r, c), v in np.ndenumerate(lake)], "r int, c int, m boolean, elev double, name string")
    plans, whole = [], store.cut
    seen = lambda df: [plans.append(df._jdf.queryExecution().optimizedPlan().toString()), whole(df)][1]
    monkeypatch.setattr(components, "cut", seen)
    monkeypatch.setattr(store, "cut", seen)
    got = {(x["r"], x["c"]): x["level"] for x in components.level_lakes(cells, "elev", F.col("m")).collect()}
    assert plans[-1].count("Join ") == 3 and len(plans) <= 6  # with the ring's and the levels' own
    elev = {(r, c): float((r * 7 + c * 13) % 31) for r, c in np.ndindex(lake.shape)}
    near = lambda x, corners: [(x[0] + i, x[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not i or not j) and (x[0] + i, x[1] + j) in elev]
    want, left = dict(elev), {x for x in elev if lake[x]}
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            fresh = [y for y in near(x, False) if y in left]
            left.difference_update(fresh)
            todo += fresh
        ring = [elev[y] for x in part for y in near(x, True) if not lake[y]]
        want |= dict.fromkeys(part, min(ring)) if ring else {}
    assert got == want


#: Columns that queries don't need, and so needn't carry through Python.
UNREAD = {
    "coastal_taper": ["o_orderpriority", "o_orderstatus"],
    "erode_l1_sink": ["o_totalprice", "o_orderstatus"],
    "ramp": ["o_totalprice", "o_orderstatus", "value"],
    "roughen_mask": ["event_type", "river"],
    "smooth_mask": ["event_type", "river", "v"],
}


@pytest.mark.parametrize("name", UNREAD)
def test_only_needed_columns_are_carried(name, spark, sf):
    plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("FileScan parquet ")[1].split("]")[0] for x in plan.splitlines() if "FileScan parquet " in x]
    read = {x.split("#")[0].strip("[ ") for scan in scans for x in scan.split(",")}
    assert scans and not read & set(UNREAD[name])


def test_recipes_write_their_cells_before_distances(spark):
    from strataframe.plans import recipes

    left = spark.range(40).selectExpr("cast(id div 8 as int) r", "cast(id % 8 as int) c", "id * 1.0D elev")
    right = spark.range(40).selectExpr("cast(id div 8 as int) r", "cast(id % 8 as int) c", "id % 9 = 0 sea")
    out = recipes.Recipe([recipes.CoastLayer("coast")]).build(left.join(right, ["r", "c"]))
    assert "Join " not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40 and out.columns == ["r", "c", "elev", "sea"]
