"""Connected components of grid cells and what is voted or measured by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut, in_shuffle, tidied

#: Links that one task contracts; of more, rounds over the table leave links of roots only.
FEW_LINKS = 1 << 20


@tidied
def components(cells: DataFrame, mask: Column, corners: bool = False, name: str = "label") -> DataFrame:
    """(r, c, label) of the mask's cells; label: the least r * 2^32 + c of the component (sides, or corners too).

    Runs along rows first: neighbours in a row are one run without a shuffle of pairs. Runs of adjacent
    rows that touch are linked, and links are contracted by alternating large and small stars.
    """
    rows = Window.partitionBy("r").orderBy("c")
    own = cells.where(F.coalesce(mask, F.lit(False))).select("r", "c")
    starts = own.withColumn("new", F.coalesce(F.col("c") - F.lag("c").over(rows) > 1, F.lit(True)).cast("int"))
    runs = starts.withColumn("k", F.sum("new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    code = F.col("r").cast("long") * F.lit(1 << 32) + F.min("c").over(Window.partitionBy("r", "k"))
    runs = cut(runs.select("r", "c", code.alias("run")))
    reach = [0, -1, 1] if corners else [0]
    below = runs.select((F.col("r") + 1).alias("r"), F.explode(F.array(*(F.col("c") + x for x in reach))).alias("c"), F.col("run").alias("v"))
    links = runs.join(in_shuffle(below), ["r", "c"]).select(F.col("run").alias("u"), "v").distinct()
    groups = in_shuffle(contracted(links))
    return runs.join(groups, runs["run"] == groups["id"], "left").select("r", "c", F.coalesce("root", "run").alias(name))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) -> (id, root): ids point to lower ones, and what they point to is taken up to its root."""
    held = [(np.asarray(b["u"]), np.asarray(b["v"])) for b in batches if len(b)]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while (up[u] != up[v]).any():
        np.minimum.at(up, np.maximum(up[u], up[v]), np.minimum(up[u], up[v]))
        while (up != up[up]).any():
            up = up[up]
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ids[up], pa.int64())], names=["id", "root"])


@tidied
def contracted(links: DataFrame) -> DataFrame:
    """links (u, v), long -> (id, root): the least id that each is connected with."""
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_roots, "id long, root long")
    while True:
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("u").agg((F.sum("up") + F.max("down")).alias("k")).where("k > 1").take(1):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(in_shuffle(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(in_shuffle(down), "u")
        edges = cut(pairs.select("u", F.col("m").alias("v")).unionByName(pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id")))


@tidied
def level_lakes(cells: DataFrame, column: str, lake: Column, name: str = "level") -> DataFrame:
    """cells and the column with each lake at its lowest shore cell; lakes without a shore don't change."""
    cells = cut(cells)  # read three times
    labels = components(cells, lake, name="__label")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
    ring = labels.select("r", "c", "__label", steps.alias("s")).select((F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), "__label")
    dry = cells.where(~F.coalesce(lake, F.lit(False))).select("r", "c", F.col(column).alias("__v"))
    lowest = ring.join(in_shuffle(dry), ["r", "c"]).groupBy("__label").agg(F.min("__v").alias("__low"))
    levels = labels.join(in_shuffle(lowest), "__label").select("r", "c", "__low")
    return cells.join(in_shuffle(levels), ["r", "c"], "left").withColumn(name, F.coalesce("__low", F.col(column))).drop("__low")


def south_bank(cells: DataFrame, zone: Column, river: Column, columns: int = 20) -> DataFrame:
    """(r, c, south): which of the zone's parts, cut by a river, lies south of it.

    Parts touch along sides or corners. At evenly spaced columns that hold two parts or more, the part of
    the highest mean row gets a vote; the part with most votes (of equals the first in reading order) wins.
    With one part the whole zone is south.
    """
    at = cells.select("r", "c", F.coalesce(zone, F.lit(False)).alias("z"), F.coalesce(river, F.lit(False)).alias("v"))
    labels = components(at, F.col("z") & ~F.col("v"), corners=True)
    span = labels.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.countDistinct("label").alias("n")).first()
    if span["n"] is None or span["n"] < 2:
        return at.where("z").select("r", "c", F.lit(True).alias("south"))
    picks = sorted({int(span["lo"] + (span["hi"] - span["lo"]) * k / (columns - 1)) for k in range(columns)})
    mean = labels.where(F.col("c").isin(picks)).groupBy("c", "label").agg(F.avg("r").alias("m"))
    best = mean.groupBy("c").agg(F.count("*").alias("k"), F.max(F.struct(F.col("m"), (-F.col("label")).alias("l"))).alias("b")).where("k > 1")
    top = best.groupBy((-F.col("b.l")).alias("label")).agg(F.count("*").alias("votes")).agg(F.max(F.struct(F.col("votes"), (-F.col("label")).alias("l"))).alias("t")).first()["t"]
    if top is None:
        return at.where("z").select("r", "c", F.lit(True).alias("south"))
    return at.where("z").join(labels, ["r", "c"], "left").select("r", "c", F.coalesce(F.col("label") == -top["l"], F.lit(False)).alias("south"))
