"""Statistics over cells: by zone, of the whole grid, and the box-counting dimension of a border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from .focal import edges


def summary(cells: DataFrame, column: str) -> DataFrame:
    """One row: least, greatest, mean, population standard deviation."""
    return cells.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def zonal(cells: DataFrame, zone: str, value: Column) -> DataFrame:
    """(zone, n, mean) by zone."""
    return cells.groupBy(zone).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def normalised(cells: DataFrame, column: str, how: str, to: float = 10.0, name: str = "v") -> DataFrame:
    """cells and the column less its mean ("mean") or least value ("min"), or scaled to a greatest magnitude ("max_abs").

    The one-row statistic is joined, not collected.
    """
    stat = {"mean": F.avg(column), "min": F.min(column), "max_abs": F.max(F.abs(column))}[how].alias("__stat")
    joined = cells.crossJoin(F.broadcast(cells.agg(stat)))
    new = F.when(F.col("__stat") > 0, F.col(column) * F.lit(to) / F.col("__stat")).otherwise(F.col(column)) if how == "max_abs" else F.col(column) - F.col("__stat")
    return joined.withColumn(name, new).drop("__stat")


def greatest_cut(cells: DataFrame, before: str, after: str, scale: int = 2) -> DataFrame:
    """One row: by how many units, and metres, the deepest cell was lowered."""
    most = F.max(F.col(before) - F.col(after))
    return cells.agg(most.alias("units"), (most / F.lit(float(scale))).alias("metres"))


def window_of(cells: DataFrame, mask: Column, pad: int = 50) -> tuple[int, int, int, int] | None:
    """(west, north, east, south) around a mask, ends exclusive, not before 0; None if it is empty."""
    top = cells.where(mask).agg(F.min("c"), F.min("r"), F.max("c"), F.max("r")).first()
    return None if top[0] is None else (max(0, top[0] - pad), max(0, top[1] - pad), top[2] + pad, top[3] + pad)


def cropped(cells: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    return cells.where(A.in_boxes(F.col("r"), F.col("c"), [box]))


def pasted(cells: DataFrame, part: DataFrame, column: str) -> DataFrame:
    """cells with the column's values of a part where it has them."""
    return cells.join(part.select("r", "c", F.col(column).alias("__new")), ["r", "c"], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def box_scales(least: int = 16, most: int = 512) -> list[int]:
    out, s = [], most
    while s >= least:
        out.append(s)
        s //= 2
    return out


def box_counts(border: DataFrame, scales: list[int]) -> DataFrame:
    """(scale, n): boxes of each size that hold a border cell. Equal boxes of a task meet before the shuffle."""
    at = border.select(F.explode(F.array(*(F.lit(s) for s in scales))).alias("scale"), "r", "c")
    boxes = at.select("scale", F.expr("r div scale").alias("br"), F.expr("c div scale").alias("bc")).distinct()
    return boxes.groupBy("scale").agg(F.count("*").alias("n"))


def fractal_dimension(cells: DataFrame, mask: str, boxes: list[tuple[int, int, int, int]] = (), least: int = 16, most: int = 512) -> DataFrame:
    """One row, dimension: minus the slope of ln n on ln scale over a mask's border; 1 with fewer than two scales.

    Cells on the map's edge and in the excluded boxes don't count.
    """
    from .blocks import extent

    h, w = extent(cells)
    border = edges(cells, mask).where((F.col("r") > 0) & (F.col("r") < h - 1) & (F.col("c") > 0) & (F.col("c") < w - 1) & ~A.in_boxes(F.col("r"), F.col("c"), list(boxes)))
    counts = box_counts(border, box_scales(least, most))
    slope = F.regr_slope(F.log(F.col("n").cast("double")), F.log(F.col("scale").cast("double")))
    return counts.agg(F.when(F.count("*") >= 2, -slope).otherwise(F.lit(1.0)).alias("dimension"))
