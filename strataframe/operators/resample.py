"""Grids of other resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strided(cells: DataFrame, step: int = 2) -> DataFrame:
    """Every step-th row and column, numbered anew."""
    return cells.where((F.col("r") % step == 0) & (F.col("c") % step == 0)).withColumns({"r": F.expr(f"r div {step}").cast("int"), "c": F.expr(f"c div {step}").cast("int")})


def nearest(cells: DataFrame, column: str, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    """(r, c, column) on a grid of new_h by new_w: the cell that holds each new cell's centre."""
    source = lambda i, n, new: f"cast(least(floor(({i} + 0.5D) * {n} / {new}), {n - 1}) as int)"
    # every old cell makes the new cells that it serves: no join
    lo = lambda i, n, new: f"cast(ceil({i} * {new} / {float(n)}D - 0.5D) as int)"
    hi = lambda i, n, new: f"cast(ceil(({i} + 1) * {new} / {float(n)}D - 0.5D) - 1 as int)"
    rows = cells.select("r", "c", column).withColumn("nr", F.explode(F.expr(f"case when {hi('r', h, new_h)} < {lo('r', h, new_h)} then cast(array() as array<int>) else sequence({lo('r', h, new_h)}, {hi('r', h, new_h)}) end")))
    both = rows.withColumn("nc", F.explode(F.expr(f"case when {hi('c', w, new_w)} < {lo('c', w, new_w)} then cast(array() as array<int>) else sequence({lo('c', w, new_w)}, {hi('c', w, new_w)}) end")))
    fits = F.expr(source("nr", h, new_h) + " = r and " + source("nc", w, new_w) + " = c")
    return both.where(fits & (F.col("nr") < new_h) & (F.col("nc") < new_w)).select(F.col("nr").alias("r"), F.col("nc").alias("c"), column)


def bilinear(cells: DataFrame, column: str, h: int, w: int, new_h: int, new_w: int, corners: bool = True) -> DataFrame:
    """(r, c, column) interpolated on a grid of new_h by new_w.

    corners: the outermost cell centres coincide; else the outermost cell edges do (and what lies beyond
    the centres is held). New cells are made and joined with their four neighbours on equal keys.
    """
    spark = cells.sparkSession
    grid = spark.range(new_h * new_w).select(F.expr(f"cast(id div {new_w} as int)").alias("r"), F.expr(f"cast(id % {new_w} as int)").alias("c"))
    at = lambda i, n, new: (f"{i} * {float(n - 1)}D / {float(max(new - 1, 1))}D" if corners else f"greatest(0D, least({float(n - 1)}D, ({i} + 0.5D) * {float(n)}D / {float(new)}D - 0.5D))")
    placed = grid.withColumns({"y": F.expr(at("r", h, new_h)), "x": F.expr(at("c", w, new_w))})
    placed = placed.withColumns({"r0": F.floor("y").cast("int"), "c0": F.floor("x").cast("int")})
    four = placed.select("r", "c", F.explode(F.array(*(F.struct((F.lit(1.0) - F.abs(F.col("y") - F.col("r0") - i)).alias("wy"), (F.lit(1.0) - F.abs(F.col("x") - F.col("c0") - j)).alias("wx"), F.least(F.col("r0") + i, F.lit(h - 1)).alias("sr"), F.least(F.col("c0") + j, F.lit(w - 1)).alias("sc")) for i in (0, 1) for j in (0, 1)))).alias("s"))
    source = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(column).alias("v"))
    joined = four.select("r", "c", "s.*").where("wy > 0 and wx > 0").join(source, ["sr", "sc"])
    return joined.groupBy("r", "c").agg(F.sum(F.col("wy") * F.col("wx") * F.col("v")).alias(column))


def dithered(cells: DataFrame, column: str, offset_r, offset_c, h: int, w: int, name: str = "dithered") -> DataFrame:
    """cells and the column's value at a displaced cell: offsets cut off towards zero, held within the grid."""
    inside = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), x)).cast("int")
    at = cells.withColumns({"__r": inside(F.col("r") + offset_r.cast("int"), h), "__c": inside(F.col("c") + offset_c.cast("int"), w)})
    return at.join(cells.select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col(column).alias(name)), ["__r", "__c"], "left").drop("__r", "__c")
