"""Exact Euclidean distances on a grid, in two separable passes, and what is built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import algebra as A
from .blocks import extent, over_bands
from .resample import bilinear, strided


def lower_envelopes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of f: min over j of f[j] + (i - j)^2 for all i, and the j that has it (the least one); f may be infinite.

    Columns are taken one after another, for all rows at once: each row has its stack of parabolas (v, from z on).
    Where a row is infinite throughout, j is -1.
    """
    m, n = f.shape
    v, z, top = np.zeros((m, n), np.int64), np.full((m, n), -np.inf), np.full(m, -1)
    finite = np.isfinite(f)
    for q in np.flatnonzero(finite.any(axis=0)):
        rows = np.flatnonzero(finite[:, q])
        start = np.full(len(rows), -np.inf)
        todo = np.flatnonzero(top[rows] >= 0)
        while len(todo):
            r = rows[todo]
            j = v[r, top[r]]
            start[todo] = s = ((f[r, q] + q * q) - (f[r, j] + j * j)) / (2.0 * (q - j))
            hidden = s <= z[r, top[r]]
            top[r[hidden]] -= 1
            todo = todo[hidden]
        top[rows] += 1
        v[rows, top[rows]], z[rows, top[rows]] = q, start
    i = np.arange(n)
    at = np.full((m, n), -1)
    for r in np.flatnonzero(top >= 0):
        at[r] = v[r, np.searchsorted(z[r, 1 : top[r] + 1], i, "left")]
    least = np.take_along_axis(f, np.maximum(at, 0), axis=1) + (i - at) ** 2
    return np.where(at < 0, np.inf, least), at


def distances(seeds: np.ndarray) -> np.ndarray:
    """For each cell of a mask the distance to the nearest seed; infinite without one."""
    r = np.arange(len(seeds), dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(seeds, r, -np.inf), axis=0)
    below = np.minimum.accumulate(np.where(seeds, r, np.inf)[::-1], axis=0)[::-1]
    return np.sqrt(lower_envelopes(np.minimum(r - above, below - r) ** 2)[0])


def with_distances(cells: DataFrame, **seeds: Column) -> DataFrame:
    """cells and for each name the distance in cells to the nearest of its seeds, and that seed's <name>_r and <name>_c; null where the grid has none.

    Pass 1, columns of the grid: nearest seed above or below. Pass 2, rows: lower envelope of parabolas, linear in
    the row's length. Both in one shuffle of the cells. Of seeds at one distance the upper and left one is named.
    """

    names = list(seeds)

    def rule(*found) -> dict[str, np.ndarray]:
        *rows, r0, c0 = found
        out = {}
        for name, up in zip(names, rows, strict=True):
            least, j = lower_envelopes((up - np.arange(r0, r0 + len(up))[:, None]) ** 2)
            none = j < 0
            out |= {name: np.where(none, np.nan, np.sqrt(least)), f"{name}_r": np.where(none, np.nan, np.take_along_axis(up, np.maximum(j, 0), axis=1)), f"{name}_c": np.where(none, np.nan, j + c0)}
        return out

    kinds = [T.StructField(f"{name}{x}", kind) for name in names for x, kind in (("", T.DoubleType()), ("_r", T.IntegerType()), ("_c", T.IntegerType()))]
    return over_bands(cells, list(seeds.values()), rule, kinds)


def distance(cells: DataFrame, seed: Column, name: str = "d") -> DataFrame:
    """(r, c, d, seed_r, seed_c): distance in cells to the nearest seed, and that seed; null where the grid has none. See with_distances()."""
    at = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), seed.alias("__m"))
    return with_distances(at, __d=F.col("__m")).select("r", "c", F.col("__d").alias(name), F.col("__d_r").alias("seed_r"), F.col("__d_c").alias("seed_c"))


def with_signed_distance(cells: DataFrame, inside: Column, name: str = "sdf") -> DataFrame:
    """cells and the distance to the mask from outside, minus the distance to its outside from within."""
    at = cells.withColumn("__m", F.coalesce(inside, F.lit(False)))
    both = with_distances(at, __o=F.col("__m"), __i=~F.col("__m"))
    return both.withColumn(name, F.coalesce("__o", F.lit(0.0)) - F.coalesce("__i", F.lit(0.0))).select(*(x for x in cells.columns if x != name), name)


def signed_distance(cells: DataFrame, inside: Column, name: str = "sdf") -> DataFrame:
    """(r, c, sdf) of with_signed_distance()."""
    return with_signed_distance(cells.select("r", "c", inside.alias("__in")), F.col("__in"), name).select("r", "c", name)


def taper(cells: DataFrame, sea: Column, reach: float, power: float = 2.0, name: str = "taper") -> DataFrame:
    """cells and a weight that grows from 0 at the sea to 1 at reach (in cells); 1 everywhere without a sea."""
    weight = F.pow(A.clip(F.col("__d") / F.lit(float(reach))), F.lit(float(power)))
    return with_distances(cells, __d=sea).withColumn(name, F.coalesce(weight, F.lit(1.0))).drop("__d", "__d_r", "__d_c")


def coarse_taper(cells: DataFrame, sea: Column, reach: float, power: float = 2.0, step: int = 10, name: str = "taper") -> DataFrame:
    """taper() worked out on every step-th row and column and interpolated: a field for grids where the full one isn't worth its cost."""
    h, w = extent(cells)
    low = taper(strided(cells.withColumn("__sea", F.coalesce(sea, F.lit(False))).select("r", "c", "__sea"), step), F.col("__sea"), reach / step, power, "__t")
    field = bilinear(low, "__t", -(-h // step), -(-w // step), h, w, corners=False)
    return cells.join(field, ["r", "c"]).withColumnRenamed("__t", name)


def between_ramp(cells: DataFrame, mask: Column, low: Column, high: Column, name: str = "ramp") -> DataFrame:
    """cells and 0..1 across a mask: share of the distance from low cells in that to low and high cells; 0 outside."""
    dl, dh = (F.coalesce(x, F.lit(0.0)) for x in ("__dl", "__dh"))
    share = dl / F.when(dl + dh == 0, F.lit(1.0)).otherwise(dl + dh)
    at = with_distances(cells, __dl=low, __dh=high)
    return at.withColumn(name, F.when(mask, share).otherwise(F.lit(0.0))).drop(*(f"__d{x}{y}" for x in "lh" for y in ("", "_r", "_c")))


def warp_field(cells: DataFrame, river: Column, width: Column, strength: Column, reach: float) -> DataFrame:
    """cells, warp_x, warp_y, influence: a pull towards the nearest river cell that fades smoothly over reach * width."""
    at = with_distances(cells.withColumns({"__w": width, "__s": strength}), __d=river)
    return warped(at, "__d", F.col("__w"), F.col("__s"), reach).drop("__w", "__s", "__d", "__d_r", "__d_c")


def warped(cells: DataFrame, d: str, width: Column, strength: Column, reach: float) -> DataFrame:
    """warp_field() of cells that have the distance d to a river, with d_r and d_c."""
    t = F.lit(1.0) - F.col(d) / F.greatest(F.lit(float(reach)) * width, F.lit(0.001))
    out = cells.withColumn("influence", F.coalesce(A.smoothstep(t), F.lit(0.0)))
    unit = lambda x, s: F.when(F.col(d) > 0, (F.col(s) - F.col(x)) / F.col(d)).otherwise(F.lit(0.0)) * F.col("influence") * strength
    return out.withColumns({"warp_x": unit("c", f"{d}_c"), "warp_y": unit("r", f"{d}_r")})


def carve(cells: DataFrame, units: str, river: Column, scour: Column, name: str = "carved", **depth) -> DataFrame:
    """cells and the units with a channel carved where the river mask is set; deeper with the distance to its bank."""
    at = cells.withColumns({"__river": F.coalesce(river, F.lit(False)), "__scour": scour})
    inside = F.when(F.col("__river"), F.coalesce("__d", F.lit(0.0))).otherwise(F.lit(0.0))
    return with_distances(at, __d=~F.col("__river")).withColumn(name, A.carved(F.col(units), inside, F.col("__scour"), **depth)).drop("__d", "__d_r", "__d_c", "__river", "__scour")
