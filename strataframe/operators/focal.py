"""Neighbourhood operators: shifts, morphology, box and Gaussian filters, slope-driven erosion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .blocks import SIZE, extent, mask_over_blocks, over_blocks


def _down() -> WindowSpec:
    return Window.partitionBy("c").orderBy("r")


def _along() -> WindowSpec:
    return Window.partitionBy("r").orderBy("c")


def _so_far(w: WindowSpec) -> WindowSpec:
    """Rows up to the current one: linear, which frames from the current row to the end are not (Spark sums each anew)."""
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _up() -> WindowSpec:
    return Window.partitionBy("c").orderBy(F.desc("r"))


def _back() -> WindowSpec:
    return Window.partitionBy("r").orderBy(F.desc("c"))


def neighbours(cells: DataFrame, column: str) -> DataFrame:
    """cells of a dense grid and the column of the four cells around: north, south, west, east (null beyond the grid)."""
    at = lambda f, w: f(column).over(w)
    return cells.withColumns({"north": at(F.lag, _down()), "south": at(F.lead, _down())}).withColumns({"west": at(F.lag, _along()), "east": at(F.lead, _along())})


def edges(cells: DataFrame, mask: str) -> DataFrame:
    """(r, c) of cells on either side of a mask's border: dilation and erosion by one step differ. Beyond the grid is unset."""
    near = neighbours(cells.select("r", "c", F.coalesce(mask, F.lit(False)).alias("m")), "m")
    sides = [F.coalesce(x, F.lit(False)) for x in ("north", "south", "west", "east")]
    any_, all_ = F.col("m"), F.col("m")
    for s in sides:
        any_, all_ = any_ | s, all_ & s
    return near.where(any_ & ~all_).select("r", "c")


def contact(cells: DataFrame, a: Column, b: Column) -> DataFrame:
    """(r, c) of cells of a that touch one of b along a side."""
    near = neighbours(cells.select("r", "c", a.alias("a"), b.alias("b")), "b")
    touch = F.lit(False)
    for x in ("north", "south", "west", "east"):
        touch = touch | F.coalesce(x, F.lit(False))
    return near.where(F.col("a") & touch).select("r", "c")


def shore(cells: DataFrame, label: str) -> DataFrame:
    """(r, c, label) of cells without a label that touch a labelled one along a side or corner; once for each label."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
    ring = cells.where(F.col(label).isNotNull()).select("r", "c", label, steps.alias("s")).select((F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), label).distinct()
    return ring.join(cells.where(F.col(label).isNull()).select("r", "c"), ["r", "c"])


def step_distance(cells: DataFrame, seed: Column, border: bool = False) -> DataFrame:
    """cells and steps: city-block distance to the nearest seed, null without one; border: beyond the grid are seeds too.

    Two passes of windows: along columns to the nearest seed above and below, then along rows.
    """
    first = cells.withColumn("__at", F.when(seed, F.col("r")))
    above, below = (F.last("__at", True).over(_so_far(w)) for w in (_down(), _up()))
    far = 1 << 30
    dv = F.least(F.coalesce(F.col("r") - above, F.lit(far)), F.coalesce(below - F.col("r"), F.lit(far)))
    if border:
        h, w = extent(cells)
        dv = F.least(dv, F.col("r") + 1, F.lit(h) - F.col("r"))
    second = first.withColumn("__dv", dv)
    left = F.min(F.col("__dv") - F.col("c")).over(_so_far(_along())) + F.col("c")
    right = F.min(F.col("__dv") + F.col("c")).over(_so_far(_back())) - F.col("c")
    steps = F.least(left, right)
    if border:
        steps = F.least(steps, F.col("c") + 1, F.lit(w) - F.col("c"))
    return second.withColumn("steps", F.when(steps < far // 2, steps)).drop("__at", "__dv")


def _near(seeds: np.ndarray, steps: int) -> np.ndarray:
    """Whether a cell is within so many city-block steps of a seed."""
    d = np.where(seeds, 0, 1 << 30)
    for axis in (0, 1):
        d = np.moveaxis(d, axis, 0)
        i = np.arange(len(d))[:, None]
        ahead, back = np.minimum.accumulate(d - i, axis=0) + i, np.minimum.accumulate((d + i)[::-1], axis=0)[::-1] - i
        d = np.moveaxis(np.minimum(ahead, back), 0, axis)
    return d <= steps


def _far_from_outside(a: np.ndarray, there: np.ndarray, r0: int, c0: int, h: int, w: int, steps: int) -> np.ndarray:
    """What of a is further than so many steps from cells outside it and from all that lies beyond a grid of h and w."""
    r, c = np.arange(r0, r0 + len(a))[:, None], np.arange(c0, c0 + a.shape[1])
    beyond = (r < 0) | (r >= h) | (c < 0) | (c >= w)
    return a & ~_near((there & ~a) | beyond, steps)


def eroded(cells: DataFrame, mask: Column, steps: int, name: str = "eroded") -> DataFrame:
    """cells and a mask without what is within so many steps of its outside; beyond the grid is outside."""
    h, w = extent(cells)
    return mask_over_blocks(cells, mask, lambda a, there, r0, c0: _far_from_outside(a, there, r0, c0, h, w, steps), steps, name)


def dilated(cells: DataFrame, mask: Column, steps: int, name: str = "dilated") -> DataFrame:
    return mask_over_blocks(cells, mask, lambda a, there, r0, c0: _near(a, steps), steps, name)


def closed(cells: DataFrame, mask: Column, steps: int = 2, name: str = "closed") -> DataFrame:
    """Dilation and then erosion: small gaps fill; cells of the mask stay. Blocks have a margin for both."""
    h, w = extent(cells)
    return mask_over_blocks(cells, mask, lambda a, there, r0, c0: a | _far_from_outside(_near(a, steps) & there, there, r0, c0, h, w, steps), 2 * steps, name)


def sink_strip(cells: DataFrame, active: Column, steps: int = 10) -> DataFrame:
    """cells and active_mask: 0 void, 1 active, 2 the strip of active cells within so many steps of the void or the map's edge."""
    inner = eroded(cells.withColumn("__a", F.coalesce(active, F.lit(False))), F.col("__a"), steps, "__inner")
    return inner.withColumn("active_mask", F.when(F.col("__inner"), 1).when(F.col("__a"), 2).otherwise(0)).drop("__a", "__inner")


def box_mean(cells: DataFrame, column: str, radius: int, name: str = "mean") -> DataFrame:
    """cells and the mean over a square of 2 * radius + 1 cells a side; beyond the grid counts as 0 (so do nulls)."""
    n = 2 * radius + 1
    part = cells.withColumn("__s", F.sum(F.coalesce(F.col(column), F.lit(0)).cast("double")).over(_down().rowsBetween(-radius, radius)))
    return part.withColumn(name, F.sum("__s").over(_along().rowsBetween(-radius, radius)) / F.lit(float(n * n))).drop("__s")


def destep(cells: DataFrame, column: str, radius: int = 64, passes: int = 3, scale: int = 2, name: str = "smooth") -> DataFrame:
    """Terraces smoothed away: repeated box means of scaled values over the share of cells with data, as rounded units.

    The share stays that of the first pass while values bleed into cells without data, which are null again at the end.
    """
    at = cells.withColumns({"__v": F.coalesce(F.col(column) * F.lit(float(scale)), F.lit(0.0)), "__w": F.col(column).isNotNull().cast("double")})
    at = box_mean(at, "__w", radius, "__share")
    for _ in range(passes):
        at = box_mean(at, "__v", radius, "__m").withColumn("__v", F.when(F.col("__share") > 0, F.col("__m") / F.col("__share")).otherwise(F.lit(0.0)))
    return at.withColumn(name, F.when(F.col(column).isNotNull(), F.rint("__v").cast("int"))).drop("__v", "__w", "__share", "__m")


def gaussian_kernel(sigma: float, reach: float = 4.0) -> np.ndarray:
    k = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian(cells: DataFrame, column: str, sigma: float, name: str = "blurred", size: int = SIZE) -> DataFrame:
    """(r, c, name): Gaussian blur of a dense grid; at its edges the grid is mirrored (edge cells twice).

    Blocks are at least as long as two margins, so that a cell is sent to four blocks at most, however broad the blur.
    """
    if sigma <= 0:
        return cells.select("r", "c", F.col(column).cast("double").alias(name))
    h, w = extent(cells)
    kernel = gaussian_kernel(sigma)
    k = len(kernel) // 2

    def mirrored(i: np.ndarray, n: int) -> np.ndarray:
        i = np.mod(i, 2 * n)
        return np.where(i >= n, 2 * n - 1 - i, i)

    def rule(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        rows, cols = mirrored(np.arange(r0, r0 + len(a)), h) - r0, mirrored(np.arange(c0, c0 + len(a)), w) - c0
        ok_r, ok_c = (rows >= 0) & (rows < len(a)), (cols >= 0) & (cols < len(a))
        a = a[np.where(ok_r, rows, 0)][:, np.where(ok_c, cols, 0)]
        a = np.nan_to_num(a)
        a = sum(x * np.roll(a, k - i, axis=0) for i, x in enumerate(kernel))
        return sum(x * np.roll(a, k - i, axis=1) for i, x in enumerate(kernel))

    return over_blocks(cells, [column], name, rule, k, max(size, 2 * k))


def erosion_step(cells: DataFrame, column: str, talus: float = 4.0, rate: float = 0.1, name: str = "eroded") -> DataFrame:
    """One step of slope-driven erosion: a cell loses rate times all that drops to its four neighbours exceed talus.

    Cells on the map's edge, without data, or at 0 or below don't change; neighbours without data don't count.
    """
    near = neighbours(cells, column)
    h, w = extent(cells)
    inner = (F.col("r") > 0) & (F.col("r") < h - 1) & (F.col("c") > 0) & (F.col("c") < w - 1)
    v = F.col(column)
    loss = F.lit(0.0)
    for x in ("north", "south", "west", "east"):
        loss = loss + F.coalesce(F.greatest(v - F.col(x) - F.lit(talus), F.lit(0.0)), F.lit(0.0))
    new = F.when(inner & (v > 0), v - F.lit(rate) * loss).otherwise(v)
    return near.withColumn(name, new).drop("north", "south", "west", "east")


def erosion(cells: DataFrame, column: str, steps: int = 100, talus: float = 4.0, rate: float = 0.1, name: str = "eroded", per_shuffle: int = 32, size: int = SIZE) -> DataFrame:
    """(r, c, name): many erosion steps. Blocks see a margin as wide as the steps taken at once, so that per_shuffle steps need one shuffle."""
    h, w = extent(cells)

    def rule_of(k: int):
        def rule(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
            n = len(a)
            row, col = np.arange(r0, r0 + n)[:, None], np.arange(c0, c0 + n)[None, :]
            inner = (row > 0) & (row < h - 1) & (col > 0) & (col < w - 1)
            for _ in range(k):
                loss = np.zeros_like(a)
                for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
                    drop = a - np.roll(a, step, axis=axis) - talus
                    loss += np.where(np.isnan(drop), 0.0, np.maximum(drop, 0.0))
                a = np.where(inner & (a > 0), a - rate * loss, a)
            return a

        return rule

    out = cells.select("r", "c", F.col(column).cast("double").alias(name))
    done = 0
    while done < steps:
        k = min(per_shuffle, steps - done)
        out = over_blocks(out, [name], name, rule_of(k), k, size)
        out = out.withColumn(name, F.nanvl(F.col(name), F.lit(None).cast("double")))
        done += k
    return out
