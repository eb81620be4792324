"""Results worked out by hand, and invariants on small grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import algebra as A
from strataframe.functions import noise as N
from strataframe.operators import components, distance, focal, lines, raster, rivers, zonal
from strataframe.plans import recipes
from strataframe.sources import scans, store
from strataframe.streaming import ingest


def grid(spark, rows, name="v"):
    return spark.createDataFrame([(r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], f"r int, c int, {name} double")


def table(df, name):
    out = {(x["r"], x["c"]): x[name] for x in df.collect()}
    h, w = max(r for r, _ in out) + 1, max(c for _, c in out) + 1
    return [[out[r, c] for c in range(w)] for r in range(h)]


def test_erosion_step(spark):
    cells = grid(spark, [[7.0, 5.0, 7.0], [None, 10.0, 0.0], [7.0, 9.0, 7.0]])
    for out in (focal.erosion_step(cells, "v", 4.0, 0.1, "e"), focal.erosion(cells, "v", 1, 4.0, 0.1, "e", size=2)):
        got = table(out, "e")
        assert got[1][1] == pytest.approx(9.3)
        assert got[0] == [7.0, 5.0, 7.0] and got[1][0] is None and got[1][2] == 0.0


def test_erosion_many_steps_by_blocks(spark):
    rng = np.random.RandomState(0)
    cells = grid(spark, (rng.rand(9, 11) * 50).tolist())
    at = cells
    for _ in range(4):
        at = focal.erosion_step(at.select("r", "c", "v"), "v", 4.0, 0.1, "e").select("r", "c", F.col("e").alias("v"))
    got = focal.erosion(cells, "v", 4, 4.0, 0.1, "e", per_shuffle=3, size=4)
    assert np.allclose(table(at, "v"), table(got, "e"))
    assert (np.array(table(got, "e")) <= np.array(table(cells, "v"))).all()


def test_flow_order_width(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "e"), ("d", "e")], "source string, target string")
    nodes = rivers.flow(edges)
    assert {x["node"]: (x["flow"], x["strahler"]) for x in nodes.collect()} == {"a": (1, 1), "b": (1, 1), "c": (3, 2), "d": (1, 1), "e": (5, 2)}
    width = rivers.widths(rivers.edge_flow(edges, nodes), 20.0, 1000.0, 100.0)
    assert {x["source"]: x["width"] for x in width.collect()}["c"] == pytest.approx(129.861229)


def test_carve(spark):
    rows = spark.createDataFrame([(100,), (10,), (-32768,)], "u int").select(A.carved(F.col("u"), F.lit(1.0), F.lit(1.5)).alias("x"))
    assert [x["x"] for x in rows.collect()] == [79, 0, 0]


def test_destep(spark):
    cells = grid(spark, [[10.0, None, 10.0]])
    at = focal.box_mean(cells.withColumn("w", F.col("v").isNotNull().cast("double")), "w", 1)
    assert table(at, "mean")[0] == pytest.approx([1 / 9, 2 / 9, 1 / 9])
    assert table(focal.destep(cells, "v", 1, 1), "smooth") == [[20, None, 20]]
    assert table(focal.destep(cells, "v", 1, 2), "smooth") == [[40, None, 40]]


def test_warp(spark):
    cells = grid(spark, [[0.0] * 3 + [1.0]])
    got = distance.warp_field(cells, F.col("v") == 1, F.lit(1.0), F.lit(2.0), 6.0).where("c = 0").first()
    assert (got["influence"], got["warp_x"], got["warp_y"]) == (0.5, 1.0, 0.0)


def test_box_count(spark):
    border = spark.createDataFrame([(1, 1), (1, 2), (5, 5)], "r int, c int")
    counts = {x["scale"]: x["n"] for x in zonal.box_counts(border, [4, 2]).collect()}
    assert counts[4] == 2 and counts[2] == len({(r // 2, c // 2) for r, c in ((1, 1), (1, 2), (5, 5))})


def test_numbers(spark):
    assert A.persistence_of(1.3) == pytest.approx(0.615572, abs=1e-6)
    one = spark.range(1)
    get = lambda x: one.select(x.alias("x")).first()["x"]
    assert get(A.altitude_weight(F.lit(600.0), 500, 200)) == 0.5
    assert [get(A.shift_zone(F.lit(0), F.lit(1), 1, m)) for m in (1.3, -1.3, 0.4)] == [2, -2, 0]
    assert [get(A.to_sentinel(F.lit(x))) for x in (2.5, 3.5, -2.5, None)] == [2, 4, -2, -32768]
    assert get(A.add_ramp(F.lit(0), F.lit(0.25), F.lit(True), 10.0)) == 5
    assert get(A.lithology(F.lit(True), F.lit(True))) == 99
    assert (get(A.attenuated(F.lit(8.0), F.lit(0.5))), get(A.attenuated(F.lit(8.0), F.lit(0.5), False))) == (2.0, 4.0)


def test_taper(spark):
    cells = grid(spark, [[0.0] + [1.0] * 10])
    w = table(distance.taper(cells, F.col("v") == 0, 10.0), "taper")[0]
    assert w[5] == 0.25 and w[0] == 0.0 and w[10] == 1.0
    assert round(99 * w[5]) == 25


def test_ramp(spark):
    cells = grid(spark, [[0.0, 1.0, 1.0, 1.0, 2.0]])
    got = table(distance.between_ramp(cells, F.col("v") == 1, F.col("v") == 0, F.col("v") == 2), "ramp")[0]
    assert got == [0.0, 0.25, 0.5, 0.75, 0.0]


def test_sink_strip(spark):
    cells = grid(spark, [[1.0] * 25] * 25)
    got = np.array(table(focal.sink_strip(cells, F.col("v") == 1, 10), "active_mask"))
    assert (got[10:15, 10:15] == 1).all() and (got == 1).sum() == 25 and (got == 2).sum() == 600


def test_prune(spark):
    edges = spark.createDataFrame([("A", "B", 10.0), ("B", "C", 10.0), ("C", "D", 1.0)], "u string, v string, len double")
    assert {(x["u"], x["v"]) for x in rivers.pruned(edges, 5.0).collect()} == {("A", "B"), ("B", "C")}


def test_envelopes_of_many_rows_against_all_pairs():
    from strataframe.operators.distance import lower_envelopes

    chance = np.random.default_rng(1)
    for _ in range(200):
        m, n = chance.integers(1, 6), chance.integers(1, 30)
        f = chance.integers(0, 40, (m, n)).astype(float) ** 2
        f[chance.random((m, n)) < 0.6] = np.inf
        i = np.arange(n)
        whole = f[:, None, :] + (i[:, None] - i[None, :]) ** 2
        least, at = lower_envelopes(f)
        assert (least == whole.min(2)).all() and (at == np.where(np.isfinite(whole.min(2)), whole.argmin(2), -1)).all()


def test_greatest_cut_and_units(spark):
    cells = spark.createDataFrame([(0, 0, 10, 4), (0, 1, 7, 7), (1, 0, None, 3)], "r int, c int, a int, b int")
    assert tuple(zonal.greatest_cut(cells, "a", "b").first()) == (6, 3.0)


def test_points_along_ends_and_short_lines(spark):
    rows = [(1, [(0.0, 0.0), (3.0, 4.0)], 2.5), (2, [(0.0, 0.0), (3.0, 4.0)], 99.0), (3, [(0.0, 0.0), (3.0, 4.0)], -1.0), (4, [(7.0, 8.0)], 1.0), (5, [], 1.0)]
    at = spark.createDataFrame(rows, "id int, geom array<struct<x:double,y:double>>, so double")
    got = {r["id"]: r["p"] and tuple(r["p"]) for r in lines.points_along(at, F.col("so")).collect()}
    assert got == {1: (1.5, 2.0), 2: (3.0, 4.0), 3: (0.0, 0.0), 4: (7.0, 8.0), 5: None}


def test_distance_is_exact(spark):
    rng = np.random.RandomState(1)
    seeds = rng.rand(13, 17) < 0.06
    seeds[0, 0] = True
    got = np.array(table(distance.distance(grid(spark, seeds.astype(float).tolist()), F.col("v") == 1), "d"))
    at = np.argwhere(seeds)
    want = [[min(math.hypot(r - a, c - b) for a, b in at) for c in range(17)] for r in range(13)]
    assert np.allclose(got, want)
    none = distance.distance(grid(spark, [[0.0, 0.0]]), F.col("v") == 1)
    assert table(none, "d") == [[None, None]]


def test_components_against_flood_fill(spark):
    rng = np.random.RandomState(2)
    mask = rng.rand(12, 15) < 0.5
    for corners in (False, True):
        got = {(x["r"], x["c"]): x["label"] for x in components.components(grid(spark, mask.astype(float).tolist()), F.col("v") == 1, corners).collect()}
        want = {}
        steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
        for r, c in sorted(map(tuple, np.argwhere(mask).tolist())):
            if (r, c) in want:
                continue
            todo = [(r, c)]
            want[r, c] = (r << 32) + c
            while todo:
                a, b = todo.pop()
                for i, j in steps:
                    n = (a + i, b + j)
                    if 0 <= n[0] < 12 and 0 <= n[1] < 15 and mask[n] and n not in want:
                        want[n] = (r << 32) + c
                        todo.append(n)
        assert got == want


def test_oriented_through_lake_and_loop(spark):
    edges = spark.createDataFrame([(1, "b", "a"), (2, "b", "c"), (3, "d", "c"), (4, "d", "a"), (5, "e", "d")], "edge_id int, u string, v string")
    sea = spark.createDataFrame([("a",)], "node string")
    got = {(x["edge_id"], x["source"], x["target"]) for x in rivers.oriented(edges, None, sea).collect()}
    assert got == {(1, "b", "a"), (4, "d", "a"), (2, "c", "b"), (5, "e", "d")}  # edge 3 would close a loop
    lakes = spark.createDataFrame([("d",)], "node string")
    got = {(x["source"], x["target"]) for x in rivers.oriented(edges, None, sea, lakes).collect()}
    assert ("e", "d") in got and ("d", "a") in got


def test_line_cells_and_skeleton(spark):
    geom = spark.createDataFrame([(1, [(0.5, 0.5), (3.5, 0.5)]), (2, [(0.5, 0.5), (0.5, 2.5)])], "id int, geom array<struct<x:double,y:double>>")
    got = {(x["id"], x["r"], x["c"]) for x in raster.line_cells(geom, ["id"]).collect()}
    assert got == {(1, 0, c) for c in range(4)} | {(2, r, 0) for r in range(3)}
    bar = grid(spark, [[0.0] * 12] + [[0.0] + [1.0] * 10 + [0.0]] * 3 + [[0.0] * 12])
    thin = {(x["r"], x["c"]) for x in lines.skeleton(bar, F.col("v") == 1, size=4, per_shuffle=2).collect()}
    image = lines.thinned(np.pad(np.ones((3, 10)), 1), 50)
    assert thin == set(map(tuple, np.argwhere(image).tolist())) and thin


def test_skeleton_of_a_wide_area(spark):
    area = np.ones((150, 150))
    cells = spark.range(150 * 150).select(F.expr("cast(id div 150 as int) r"), F.expr("cast(id % 150 as int) c"))
    thin = {(x["r"], x["c"]) for x in lines.skeleton(cells, F.lit(True), size=256).collect()}
    assert thin == set(map(tuple, np.argwhere(lines.thinned(area, 1000)).tolist())) and thin != set(map(tuple, np.argwhere(lines.thinned(area, 64)).tolist()))


def test_midpoint_ends_where_the_deflection_outgrows_the_line():
    from strataframe.operators.lines import midpoint_line

    for seed in range(200):
        line = midpoint_line(np.array([[0.0, 0.0], [1.0, 0.0]]), 0.5, 0.5, 1000.0, seed)
        assert 3 <= len(line) < 1 << 13 and (np.hypot(*np.diff(line, axis=0).T) < 0.5).all()


def test_midpoint_is_repeatable():
    a = lines.midpoint_line(np.array([[0.0, 0.0], [10.0, 0.0]]), 1.0, 0.5, 4.0, 7)
    b = lines.midpoint_line(np.array([[0.0, 0.0], [10.0, 0.0]]), 1.0, 0.5, 4.0, 7)
    assert (a == b).all() and len(a) > 10 and (a[0] == [0, 0]).all() and (a[-1] == [10, 0]).all()


def test_world_checkpoint_and_missing(spark, tmp_path):
    world = scans.World.blank(spark, scans.Grid(3, 4)).with_layer("extra", "int", 5)
    store.save_world(world.cells, {"h": 3}, f"file://{tmp_path}/w")
    cells, meta = store.load_world(spark, f"file://{tmp_path}/w")
    assert cells.count() == 12 and meta == {"h": 3} and cells.where("extra = 5 and lithology_id = 10").count() == 12
    with pytest.raises(FileNotFoundError):
        store.load_world(spark, f"file://{tmp_path}/none")
    made = []
    for _ in range(2):
        store.load_or_run(spark, f"file://{tmp_path}/t", lambda: made.append(1) or spark.range(3))
    assert len(made) == 1
    assert scans.load_vectors(spark, {"x": f"file://{tmp_path}/no.parquet"}, scans.Grid(1, 1)) == {}


def test_contracts(spark):
    with pytest.raises(ValueError):
        recipes.TectonicLayer("t", mode="FBM")
    with pytest.raises(ValueError):
        scans.projected(spark.range(1), geographic=True)
    with pytest.raises(ValueError):
        recipes.activated(spark.range(1), None)
    with pytest.raises(ValueError):
        scans.read_layer(spark.range(1), None, "x", "v", 0)
    axes = scans.ingest_axes(spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0)],)], "geom array<struct<x:double,y:double>>")).first()
    assert (axes["epoch"], axes["base_amplitude"], axes["width_limit"], axes["generation"]) == (1, 1000.0, 10.0, 0)


def test_stream(spark, tmp_path):
    cells = grid(spark, [[1.0, 2.0], [3.0, 4.0]])
    cells.write.parquet(f"{tmp_path}/in")
    source = ingest.arriving(spark, f"{tmp_path}/in", cells.schema)
    ingest.keep_applied(source, lambda df: df.withColumn("v", A.flatten(F.col("v"), F.col("v") > 2)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(x["v"] for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [0.0, 0.0, 1.0, 2.0]


def test_walk_past_many_levels_and_stops(spark):
    """A chain longer than the tables that are united at once, with a lake that later levels meet again."""
    n = 45
    chain = [(i, i, i + 1) for i in range(n)] + [(100, 3, 90), (101, 10, 90)]
    edges = spark.createDataFrame(chain, "edge_id long, u long, v long")
    seeds, lake = spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(90,)], "node long")
    got = {r["node"]: (r["level"], r["down"]) for r in rivers.upstream(edges, seeds, lake).collect()}
    assert got == {0: (0, None), 90: (4, 3)} | {i: (i, i - 1) for i in range(1, n + 1)}
    free = {r["node"]: r["level"] for r in rivers.upstream(edges, seeds).collect()}
    assert free[90] == 4 and free[10] == 5 and free[n] == n - 5


def test_water_over_several_squares(spark):
    """Boxes that span squares of the join: corners, borders, and an edge that lies in two boxes at once."""
    boxes = spark.createDataFrame([(10, 10, 200, 140), (0, 150, 64, 160)], "c0 int, r0 int, c1 int, r1 int")
    edges = spark.createDataFrame([(1, 10.0, 10.0, 200.0, 140.0), (2, 9.0, 10.0, 50.0, 50.0), (3, 64.0, 160.0, 300.0, 300.0), (4, 300.0, 300.0, 130.0, 70.0), (5, 400.0, 0.0, 500.0, 0.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(rivers.outside_water(edges, boxes)) == [2, 3, 4, 5]
    assert ids(rivers.touching_water(edges, boxes)) == [1, 2, 3, 4]


def test_distance_mode_is_the_nearest_distance():
    assert N.MODES["Distance"] is N.cellular and N.MODES["Distance2Sub"] is N.ridge_distance


def test_tidied_leaves_one_table_also_after_a_fault(spark):
    from pathlib import Path

    folder = Path(store.shared_folder(spark).removeprefix("file://"))
    there = lambda: {x.name for x in folder.glob("cut-*")}
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 4, 3)], "u long, v long, edge_id int")
    before = there()
    walk = rivers.upstream(edges, spark.createDataFrame([(4,)], "node long"))
    assert len(there() - before) == 1 and walk.count() == 4

    @store.tidied
    def faulty(df):
        store.cut(df)
        raise ValueError("fault")

    before = there()
    with pytest.raises(ValueError):
        faulty(edges)
    assert there() == before and walk.count() == 4
