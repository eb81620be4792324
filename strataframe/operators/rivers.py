"""Directed river networks: orientation from the sea, flow, stream order, width, checks and pruning.

Edges are (edge_id, u, v, ...); graphs are never collected. Loops run on the driver over tables that
shrink or grow by one level; each level is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..sources.store import cut, tidied
from .raster import BAND, banded, first_by, inside


def _square(name: str, at: Column) -> Column:
    return (F.floor(at / F.lit(BAND)) == F.col(name))


def in_water(points: DataFrame, water: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of points that lie in a polygon of water (geom)."""
    xs, ys = F.transform("geom", lambda p: p["x"]), F.transform("geom", lambda p: p["y"])
    boxes = water.select(F.col("geom").alias("__g"), F.array_min(xs).alias("wx0"), F.array_max(xs).alias("wx1"), F.array_min(ys).alias("wy0"), F.array_max(ys).alias("wy1"))
    boxes = banded(boxes, F.col("wx0"), F.col("wx1"), F.col("wy0"), F.col("wy1"))
    met = _square("bx", F.col(x)) & _square("by", F.col(y)) & F.col(x).between(F.col("wx0"), F.col("wx1")) & F.col(y).between(F.col("wy0"), F.col("wy1"))
    return points.join(boxes, met & inside("__g", F.col(x), F.col(y)), "left_semi")


def all_water(sea: DataFrame, lakes: DataFrame) -> DataFrame:
    """(geom) of the sea and the lakes, as one water."""
    return sea.select("geom").unionByName(lakes.select("geom"))


def _boxes(boxes: DataFrame) -> DataFrame:
    b = boxes.select(F.col("c0").alias("bw"), F.col("r0").alias("bn"), F.col("c1").alias("be"), F.col("r1").alias("bs"))
    return banded(b, F.col("bw"), F.col("be"), F.col("bn"), F.col("bs"))


def outside_water(edges: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """edges (x0, y0, x1, y1) less those that lie within one box (c0, r0, c1, r1) of water; one that spans two stays."""
    x, y = F.least("x0", "x1"), F.least("y0", "y1")
    within = (x >= F.col("bw")) & (F.greatest("x0", "x1") <= F.col("be")) & (y >= F.col("bn")) & (F.greatest("y0", "y1") <= F.col("bs"))
    return edges.join(_boxes(boxes), _square("bx", x) & _square("by", y) & within, "left_anti")


def touching_water(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Edges of which one end at least lies in a box of water.

    Each point is tested once, however many edges end there, and each box once, however many copies it has: on
    the squares, two by two at most, of the least power of two that is no shorter than the box.
    """
    b = boxes.select(F.col("c0").alias("bw"), F.col("r0").alias("bn"), F.col("c1").alias("be"), F.col("r1").alias("bs")).where("bw <= be and bn <= bs").distinct()
    side = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("be") - F.col("bw"), F.col("bs") - F.col("bn"), F.lit(1.0)))))
    at = lambda x: F.floor(F.col(x) / F.col("side"))
    b = b.withColumn("side", side).withColumn("bx", F.explode(F.sequence(at("bw"), at("be")))).withColumn("by", F.explode(F.sequence(at("bn"), at("bs"))))
    ends = F.explode(F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in "01")))
    points = edges.select(ends.alias("p")).select("p.x", "p.y").distinct()
    placed = points.crossJoin(F.broadcast(b.select("side").distinct())).withColumns({"px": at("x"), "py": at("y")}).withColumnRenamed("side", "scale")
    met = (F.col("scale") == F.col("side")) & (F.col("px") == F.col("bx")) & (F.col("py") == F.col("by"))
    wet = placed.join(b, met & F.col("x").between(F.col("bw"), F.col("be")) & F.col("y").between(F.col("bn"), F.col("bs")), "left_semi").select("x", "y").distinct()
    end = lambda i: (F.col(f"x{i}") == F.col("x")) & (F.col(f"y{i}") == F.col("y"))
    return edges.join(wet, end(0), "left_semi").unionByName(edges.join(wet, end(0), "left_anti").join(wet, end(1), "left_semi"))


def graph_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines (edge_id, geom): nodes are end points, named by their coordinates; of parallel edges the first stays."""
    name = lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit(")"))
    edges = lines.withColumns({"u": name(F.element_at("geom", 1)), "v": name(F.element_at("geom", -1))})
    edges = first_by(edges.withColumns({"__a": F.least("u", "v"), "__b": F.greatest("u", "v")}), ["__a", "__b"], ["edge_id"]).drop("__a", "__b")
    ends = edges.select(F.col("u").alias("node"), F.element_at("geom", 1).alias("p")).unionByName(edges.select(F.col("v").alias("node"), F.element_at("geom", -1).alias("p")))
    return ends.groupBy("node").agg(F.min("p").alias("p")).select("node", "p.x", "p.y"), edges


def anchors(edges: DataFrame, wet: DataFrame) -> DataFrame:
    """(edge_id, land, water) of edges of which exactly one end is a wet node."""
    w = wet.select("node", F.lit(True).alias("wet"))
    at = edges.join(w.withColumnsRenamed({"node": "u", "wet": "wu"}), "u", "left").join(w.withColumnsRenamed({"node": "v", "wet": "wv"}), "v", "left")
    one = at.withColumns({"wu": F.coalesce("wu", F.lit(False)), "wv": F.coalesce("wv", F.lit(False))}).where("wu <> wv")
    return one.select("edge_id", F.when(F.col("wu"), F.col("v")).otherwise(F.col("u")).alias("land"), F.when(F.col("wu"), F.col("u")).otherwise(F.col("v")).alias("water"))


@tidied
def upstream(edges: DataFrame, seeds: DataFrame, stops: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """(node, level, down, edge_id): for each node reached from the seeds (node), its way down.

    Breadth first, until a level reaches nothing new; a node that is reached twice in a level flows to the
    least node. Edges that would close a loop are left out. Nodes of stops get their edge but are not passed.
    Nodes of visited are taken. In a level only the two last ones have to be looked up: an edge leads one
    level up or down at most, or within the level.
    """
    both = cut(edges.select("edge_id", F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select("edge_id", F.col("v").alias("a"), F.col("u").alias("b"))).where("a <> b"))
    kind = dict(edges.dtypes)["u"]
    found = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("level"), F.lit(None).cast(kind).alias("down"), F.lit(None).cast(dict(edges.dtypes)["edge_id"]).alias("edge_id")))
    held = [] if stops is None else [cut(found.select("node").join(stops.select("node"), "node", "left_semi"))]
    levels, last, front, level = [found], None, found, 0
    while True:
        level += 1
        known = front.select("node") if last is None else front.select("node").unionByName(last.select("node"))
        start = front if stops is None or level == 1 else front.join(stops.select("node"), "node", "left_anti")
        step = start.select(F.col("node").alias("a")).join(both, "a").join(known.select(F.col("node").alias("b")), "b", "left_anti")
        if visited is not None:
            step = step.join(visited.select(F.col("node").alias("b")), "b", "left_anti")
        if stops is not None and level > 1:  # a stop that was reached earlier may be met again from any later level
            step = step.join(_all(held).withColumnRenamed("node", "b"), "b", "left_anti")
        last, front = front, cut(first_by(step, ["b"], ["a", "edge_id"]).select(F.col("b").alias("node"), F.lit(level).alias("level"), F.col("a").alias("down"), "edge_id"))
        if not front.take(1):
            break
        levels.append(front)
        if stops is not None:
            held.append(cut(front.select("node").join(stops.select("node"), "node", "left_semi")))
            held = [cut(_all(held))] if len(held) > 32 else held
        if len(levels) > 32:  # fewer tables to union
            levels = [cut(_all(levels[:-1])), front]
    return _all(levels)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


@tidied
def oriented(edges: DataFrame, nodes: DataFrame, sea: DataFrame, lakes: DataFrame | None = None) -> DataFrame:
    """(edge_id, source, target): edges as water flows. First up from the sea, lakes not passed; then once up from lakes that were reached."""
    legs = anchors(edges, sea)
    seed = legs.select(F.col("water").alias("node")).distinct()
    first = cut(upstream(edges, seed, lakes))
    out = first
    if lakes is not None:
        reached = first.join(lakes.select("node"), "node", "left_semi").where("level > 0").select("node")
        second = upstream(edges, cut(reached), None, first.join(reached, "node", "left_anti"))
        out = first.unionByName(second.where("level > 0"))
    return out.where("down is not null").select("edge_id", F.col("node").alias("source"), F.col("down").alias("target"))


def reoriented(edges: DataFrame, direction: DataFrame) -> DataFrame:
    """edges (edge_id, x0, y0, x1, y1) with direction's source point (sx, sy): flipped if the source is not strictly nearer to the first end."""
    at = edges.join(direction, "edge_id")
    d = lambda x, y: (F.col(x) - F.col("sx")) * (F.col(x) - F.col("sx")) + (F.col(y) - F.col("sy")) * (F.col(y) - F.col("sy"))
    return at.withColumn("flipped", ~(d("x0", "y0") < d("x1", "y1")))


@tidied
def flow(edges: DataFrame) -> DataFrame:
    """(node, flow, strahler, level) of a directed acyclic network (source, target).

    In topological levels: a node's flow is 1 and what flows in; its order is the highest that comes in, one more
    where two or more of them have it, and 1 without inflow. Nodes on or below a cycle are left out.
    """
    e = cut(edges.select("source", "target"))
    nodes = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    waits = cut(nodes.join(e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("k")), "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k")))
    ready = waits.where("k = 0").select("node", F.lit(1).cast("long").alias("flow"), F.lit(1).alias("strahler"), F.lit(0).alias("level"))
    done, level, rest = [ready], 0, None
    while True:
        level += 1
        # what came in so far: the highest order, how many have it, all flow and edges
        came = ready.join(e, ready["node"] == e["source"]).select(F.col("target").alias("node"), F.col("strahler").alias("s"), F.lit(1).cast("long").alias("c"), F.col("flow").alias("f"), F.lit(1).cast("long").alias("n"))
        if rest is not None:
            came = came.unionByName(rest)
        by_order = came.groupBy("node", "s").agg(F.sum("c").alias("c"), F.sum("f").alias("f"), F.sum("n").alias("n"))
        total = by_order.groupBy("node").agg(F.max(F.struct("s", "c")).alias("top"), F.sum("f").alias("f"), F.sum("n").alias("n"))
        state = cut(total.join(waits, "node").select("node", "top.s", "top.c", "f", "n", "k"))
        ready = state.where("n = k").select("node", (F.col("f") + 1).cast("long").alias("flow"), F.expr("cast(s + if(c >= 2, 1, 0) as int)").alias("strahler"), F.lit(level).alias("level"))
        if not ready.take(1):
            break
        rest = state.where("n < k").select("node", "s", "c", "f", "n")
        done.append(ready)
        if len(done) > 32:  # fewer tables to union
            done = [cut(_all(done))]
    return _all(done)


@tidied
def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges (source, target) that are on a cycle or lie between cycles: what is left when sources and sinks are peeled off."""
    e = cut(edges.select("source", "target"))
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


@tidied
def without_cycles(edges: DataFrame) -> DataFrame:
    """edges (source, target) with one edge of each cycle removed, the largest of what peeling leaves, until none is left."""
    out = edges
    while True:
        rest = cyclic_edges(out)
        worst = rest.agg(F.max(F.struct("source", "target")).alias("e")).first()["e"]
        if worst is None:
            return out
        out = cut(out.where(~((F.col("source") == F.lit(worst[0])) & (F.col("target") == F.lit(worst[1])))))


def edge_flow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with magnitude and strahler of their source node."""
    return edges.join(nodes.select(F.col("node").alias("source"), F.col("flow").alias("magnitude"), "strahler"), "source")


def widths(edges: DataFrame, least: float = 10.0, most: float = 500.0, scale: float = 1.5) -> DataFrame:
    return edges.withColumn("width", A.river_width(F.col("magnitude"), least, most, scale))


def width_range(edges: DataFrame) -> DataFrame:
    """One row: how many edges, the narrowest and the widest."""
    return edges.agg(F.count("*").alias("n"), F.min("width").alias("narrowest"), F.max("width").alias("widest"))


def point_of(node: Column) -> tuple[Column, Column]:
    """Coordinates of a node named "(x, y)"."""
    number = r"(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    return tuple(F.regexp_extract(node, rf"\({number}, {number}\)", k).cast("double") for k in (1, 2))


def misplaced(edges: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Edges (source, x0, y0) whose first point lies further than tolerance from their named source."""
    x, y = point_of(F.col("source"))
    return edges.where(F.hypot(F.col("x0") - x, F.col("y0") - y) > tolerance)


def gaps(edges: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(a, b, gap): edges and those that go on from their target, where one's end and the other's beginning are apart. All pairs, no sample."""
    a = edges.select(F.col("edge_id").alias("a"), F.col("target").alias("node"), "x1", "y1")
    b = edges.select(F.col("edge_id").alias("b"), F.col("source").alias("node"), "x0", "y0")
    return a.join(b, "node").withColumn("gap", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where(F.col("gap") > tolerance).select("a", "b", "gap")


@tidied
def pruned(edges: DataFrame, least: float, passes: int = 100) -> DataFrame:
    """edges (u, v, len) without short dead ends: edges with an end of degree 1 and a length under least go, again and again."""
    out = edges
    for _ in range(passes):
        ends = out.select(F.col("u").alias("n")).unionByName(out.select(F.col("v").alias("n")))
        single = ends.groupBy("n").agg(F.count("*").alias("k")).where("k = 1").select("n")
        short = out.where(F.col("len") < least)
        leaves = short.join(single.withColumnRenamed("n", "u"), "u", "left_semi").select("u", "v").unionByName(short.join(single.withColumnRenamed("n", "v"), "v", "left_semi").select("u", "v")).distinct()
        gone = cut(leaves)
        if not gone.take(1):
            break
        out = cut(out.join(gone, ["u", "v"], "left_anti"))
    return out


def directions(edges: DataFrame, every: int = 10) -> DataFrame:
    """(edge_id, dx, dy): unit vectors of every so many edges (x0, y0, x1, y1), for arrows."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.hypot(dx, dy)
    return edges.where((F.col("edge_id") % every == 0) & (n > 0)).select("edge_id", (dx / n).alias("dx"), (dy / n).alias("dy"))
