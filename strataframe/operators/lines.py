"""Lines: simplification, fractal detail, ridge growth, and centre lines of wet areas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import M
from ..sources.store import cut, tidied
from .blocks import SIZE, mask_over_blocks, over_blocks
from .components import components
from .distance import distances


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's choice of points, with a stack in place of recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, between = points[a], points[b], points[a + 1 : b]
        d = q - p
        n = math.hypot(*d)
        off = np.abs(d[0] * (between[:, 1] - p[1]) - d[1] * (between[:, 0] - p[0])) / n if n else np.hypot(*(between - p).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def _over_lines(lines: DataFrame, change) -> DataFrame:
    """lines with geom replaced by change(points, row)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            geoms = []
            for row in batch.itertuples():
                p = np.array([(q["x"], q["y"]) for q in row.geom], float).reshape(-1, 2)
                geoms.append([{"x": float(x), "y": float(y)} for x, y in (change(p, row) if len(p) > 1 else p)])
            yield batch.assign(geom=geoms)

    return lines.mapInPandas(run, lines.schema)


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """lines (geom, ...) with as few of their points as stay within tolerance."""
    return _over_lines(lines, lambda p, row: simplified(p, tolerance))


def _hash(*keys: int) -> float:
    """0..1 from integers."""
    h = 12345
    for k in keys:
        h = (h * 48271 + k * 69621 + 977) % M
        h = (h * h + 613) % M
    return h / M


#: Greatest sideways move of a middle point, as a share of the length of the part that is halved.
MOST = 0.8


def midpoint_line(points: np.ndarray, resolution: float, rough: float, deflection: float, seed: int) -> np.ndarray:
    """Each segment halved and its middle moved sideways until parts are shorter than resolution; parts move less the shorter they are.

    A middle moves by at most MOST of its part's length: halves are then always shorter than the whole, and the
    work ends however large the deflection is beside the line.
    """
    total = float(np.hypot(*np.diff(points, axis=0).T).sum())
    out = [points[0]]
    for i in range(len(points) - 1):
        todo = [(points[i], points[i + 1], 1)]
        while todo:
            p, q, at = todo.pop()
            d = q - p
            n = math.hypot(*d)
            if n < resolution or n == 0:
                out.append(q)
                continue
            move = (2 * _hash(seed, i, at) - 1) * rough * deflection * (n / total) ** 0.6
            move = max(-MOST * n, min(MOST * n, move))
            mid = (p + q) / 2 + np.array([-d[1], d[0]]) / n * move
            todo += [(mid, q, 2 * at + 1), (p, mid, 2 * at)]
    return np.array(out)


def midpoint(lines: DataFrame, resolution: float = 2.0, rough: float = 0.5, deflection: float = 40.0) -> DataFrame:
    """lines (id, geom, ...) with fractal detail; chance comes from the id, so that a rerun gives the same lines."""
    return _over_lines(lines, lambda p, row: midpoint_line(p, resolution, rough, deflection, int(row.id)))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(M)) / F.lit(float(M))


@tidied
def grown_ridges(axes: DataFrame, generations: int = 3, spur_interval: float = 20.0, spur_length: float = 50.0, lookahead: float = 5.0) -> DataFrame:
    """(id, geom, epoch, base_amplitude, width_limit, generation): ridge axes and spurs of spurs.

    Along each line longer than the interval, spurs start every interval or so, turn off by 60 degrees and
    up to 30 more to a random side, and are 0.6 as long each generation; amplitude falls by 0.7, width by half.
    """
    out = front = axes.select("id", "geom", "epoch", "base_amplitude", "width_limit", F.lit(0).alias("generation"))
    for g in range(1, generations):
        step = F.expr("transform(sequence(1, size(geom) - 1), i -> sqrt(power(geom[i].x - geom[i - 1].x, 2) + power(geom[i].y - geom[i - 1].y, 2)))")
        measured = front.where(F.size("geom") > 1).withColumn("step", step).withColumn("total", F.aggregate("step", F.lit(0.0), lambda s, x: s + x)).where(F.col("total") >= 2 * spur_interval)
        n = F.floor(F.col("total") / spur_interval).cast("int")
        spots = measured.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        spots = spots.withColumn("at", F.lit(spur_interval) + (F.col("total") - 2 * spur_interval) * F.col("k") / F.greatest(F.col("n") - 1, F.lit(1)))
        here, there = _along(F.col("at")), _along(F.least(F.col("at") + lookahead, F.col("total")))
        placed = spots.withColumns({"p": here, "q": there})
        side = F.when(_uniform(F.col("id"), F.col("k"), F.lit(g), F.lit(1)) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
        turn = side * (F.lit(math.pi / 3) + _uniform(F.col("id"), F.col("k"), F.lit(g), F.lit(2)) * F.lit(math.pi / 6))
        angle = F.atan2(F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")) + turn
        length = F.lit(spur_length * 0.6**g) * (F.lit(0.5) + _uniform(F.col("id"), F.col("k"), F.lit(g), F.lit(3)) * F.lit(0.5))
        end = F.struct((F.col("p.x") + F.cos(angle) * length).alias("x"), (F.col("p.y") + F.sin(angle) * length).alias("y"))
        child = F.abs(F.xxhash64("id", "k", F.lit(g)) % F.lit(1 << 52))
        front = cut(placed.select(child.alias("id"), F.array(F.col("p"), end).alias("geom"), "epoch", (F.col("base_amplitude") * 0.7).alias("base_amplitude"), (F.col("width_limit") * 0.5).alias("width_limit"), F.lit(g).alias("generation")))
        out = out.unionByName(front)
    return out


def points_along(lines: DataFrame, at: Column, name: str = "p") -> DataFrame:
    """lines (geom) and the point so far along each: its first point before it, its last one beyond it; null without points."""
    step = F.expr("transform(sequence(1, greatest(size(geom) - 1, 1)), i -> coalesce(sqrt(power(get(geom, i).x - get(geom, i - 1).x, 2) + power(get(geom, i).y - get(geom, i - 1).y, 2)), 0D))")
    far = F.aggregate("step", F.lit(0.0), lambda s, x: s + x)
    so = F.greatest(F.lit(0.0), F.least(F.col("__at"), far))
    point = F.when(F.size("geom") > 1, _along(so)).otherwise(F.expr("get(geom, 0)"))
    return lines.withColumn("__at", at).withColumn("step", step).withColumn(name, point).drop("__at", "step")


def _along(at: Column) -> Column:
    """The point of geom so far along it, from columns geom and step."""
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("struct<x:double,y:double>").alias("p"))

    def add(s: Column, i: Column) -> Column:
        n = F.col("step")[i]
        t = F.when(n > 0, (at - s["before"]) / n).otherwise(F.lit(0.0))
        a, b = F.col("geom")[i], F.col("geom")[i + 1]
        here = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
        last = i == F.size("step") - 1
        found = F.when(s["p"].isNull() & ((at <= s["before"] + n) | last), here).otherwise(s["p"])
        return F.struct((s["before"] + n).alias("before"), found.alias("p"))

    return F.aggregate(F.sequence(F.lit(0), F.size("step") - 1), start, add, lambda s: s["p"])


def bridged(cells: DataFrame, mask: Column, gap: float, name: str = "bridged") -> DataFrame:
    """cells and a mask whose gaps up to twice so many cells are closed: grown by gap, then shrunk by it. Blocks have a margin for both."""

    def rule(a: np.ndarray, there: np.ndarray, r0: int, c0: int) -> np.ndarray:
        wide = a | (there & (distances(a) <= gap))
        return a | (wide & (distances(there & ~wide) > gap))

    return mask_over_blocks(cells, mask, rule, 2 * math.ceil(gap), name)


def thinned(image: np.ndarray, passes: int) -> np.ndarray:
    """Zhang and Suen's parallel thinning, so many passes of its two steps."""
    a = image.astype(bool)
    for _ in range(passes):
        before = a
        for step in (0, 1):
            p = np.pad(a, 1)
            n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
            count = sum(x.astype(int) for x in n)
            turns = sum((~n[k] & n[(k + 1) % 8]).astype(int) for k in range(8))
            first = n[0] & n[2] & n[4] if step == 0 else n[0] & n[2] & n[6]
            second = n[2] & n[4] & n[6] if step == 0 else n[0] & n[4] & n[6]
            a = a & ~((count >= 2) & (count <= 6) & (turns == 1) & ~first & ~second)
        if (a == before).all():
            break
    return a


@tidied
def skeleton(cells: DataFrame, mask: Column, per_shuffle: int = 16, size: int = SIZE) -> DataFrame:
    """(r, c) of the mask's centre lines, one cell wide: thinned until a pass changes nothing. Each pass looks two cells far; blocks have that margin for each pass taken at once.

    Only the mask's cells go into the blocks: a cell that is not there and one outside the mask are the same to a pass.
    """
    out = cut(cells.where(mask).select("r", "c", F.lit(1.0).alias("m")))
    while True:
        after = over_blocks(out, ["m"], "n", lambda a, r0, c0: thinned(np.nan_to_num(a) > 0, per_shuffle).astype(float), 2 * per_shuffle, size)
        after = cut(after.where("n > 0").withColumnRenamed("n", "m"))
        same = after.count() == out.count()
        out = after
        if same:
            break
    return out.select("r", "c")


def skeleton_edges(thin: DataFrame) -> DataFrame:
    """(u, v, len) between cells of a skeleton that touch; cells are named r * 2^32 + c. A corner step where sides lead too is left out."""
    name = lambda r, c: r.cast("long") * F.lit(1 << 32) + c
    at = thin.select("r", "c")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)))))
    to = at.select("r", "c", steps.alias("s")).select(F.col("r").alias("r0"), F.col("c").alias("c0"), (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    met = to.join(at, ["r", "c"]).withColumn("corner", (F.col("r") != F.col("r0")) & (F.col("c") != F.col("c0")))
    a = at.select(F.col("r").alias("r0"), F.col("c"))
    b = at.select(F.col("r"), F.col("c").alias("c0"))
    straight = met.where("not corner")
    diagonal = met.where("corner").join(a, ["r0", "c"], "left_anti").join(b, ["r", "c0"], "left_anti")
    both = straight.select("r0", "c0", "r", "c", F.lit(1.0).alias("len")).unionByName(diagonal.select("r0", "c0", "r", "c", F.lit(math.sqrt(2)).alias("len")))
    return both.select(name(F.col("r0"), F.col("c0")).alias("u"), name(F.col("r"), F.col("c")).alias("v"), "len")


@tidied
def centre_lines(cells: DataFrame, mask: Column, gap: float = 1.0, prune: float = 5.0, passes: int = 100) -> DataFrame:
    """(u, v, len) of a wet area's network: gaps bridged, thinned, short dead ends pruned."""
    from .rivers import pruned

    closed = cut(bridged(cells, mask, gap))
    return pruned(cut(skeleton_edges(skeleton(closed, F.col("bridged")))), prune, passes)


__all__ = ["bridged", "centre_lines", "components", "grown_ridges", "midpoint", "simplify", "skeleton", "skeleton_edges"]
