"""Sources of grids and features, and sinks with storage conventions."""

from __future__ import annotations

import logging
import math
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import algebra as A
from .store import exists

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@dataclass(frozen=True)
class Grid:
    """Shape and place of a raster: x = a * col + b * row + c, y = d * col + e * row + f."""

    h: int
    w: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    crs: str = "local"

    @property
    def pixel(self) -> float:
        return self.a


@dataclass(frozen=True)
class World:
    """An immutable set of layers (columns of cells) and feature tables over one grid."""

    grid: Grid
    cells: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def blank(spark: SparkSession, grid: Grid) -> World:
        """The primary layers at their first values."""
        if grid.h <= 0 or grid.w <= 0:
            raise ValueError("a grid needs rows and columns")
        ids = spark.range(grid.h * grid.w)
        cells = ids.select(F.expr(f"cast(id div {grid.w} as int)").alias("r"), F.expr(f"cast(id % {grid.w} as int)").alias("c"))
        layers = {"elevation": ("float", 0), "lithology_id": ("smallint", 10), "active_mask": ("smallint", 0), "water_flux": ("smallint", 0)}
        return World(grid, cells.select("r", "c", *(F.lit(v).cast(t).alias(k) for k, (t, v) in layers.items())))

    def with_layer(self, name: str, kind: str = "smallint", fill: float = 0) -> World:
        """A constant layer; one of that name is replaced."""
        return World(self.grid, self.cells.withColumn(name, F.lit(fill).cast(kind)), self.vectors)

    def with_cells(self, cells: DataFrame) -> World:
        return World(self.grid, cells, self.vectors)


def load_vectors(spark: SparkSession, paths: dict[str, str], grid: Grid) -> dict[str, DataFrame]:
    """Feature tables by name. A missing file is skipped with a warning; crs defaults to the grid's, another must be projected before."""
    out = {}
    for name, path in paths.items():
        if not exists(spark, path):
            logging.getLogger(__name__).warning("no vector layer at %s", path)
            continue
        table = spark.read.json(path) if path.endswith((".json", ".geojson")) else spark.read.parquet(path)
        out[name] = table if "crs" in table.columns else table.withColumn("crs", F.lit(grid.crs))
    return out


def projected(features: DataFrame, geographic: bool, processing_epsg: int | None = None, affine: tuple[float, float, float, float, float, float] | None = None) -> DataFrame:
    """Features in a plane: as they are; geographic ones need a target, and the affine map of the region to it."""
    if not geographic and processing_epsg is None:
        return features
    if geographic and processing_epsg is None:
        raise ValueError("geographic coordinates need a processing EPSG code")
    if affine is None:
        return features.withColumn("crs", F.lit(f"EPSG:{processing_epsg}"))
    a, b, c, d, e, f = affine
    moved = F.transform("geom", lambda p: F.struct((p["x"] * a + p["y"] * b + c).alias("x"), (p["x"] * d + p["y"] * e + f).alias("y")))
    return features.withColumn("geom", moved).withColumn("crs", F.lit(f"EPSG:{processing_epsg}"))


def ingest_axes(axes: DataFrame, explode: bool = True) -> DataFrame:
    """Ridge axes as generation-0 records; absent columns get defaults; multi-part geometries become rows."""
    for name, kind, default in (("oe_epoch", "int", 1), ("amplitude", "double", 1000.0), ("width_km", "double", 10.0)):
        axes = axes.withColumn(name, F.coalesce(F.col(name), F.lit(default)).cast(kind) if name in axes.columns else F.lit(default).cast(kind))
    if explode and isinstance(axes.schema["geom"].dataType.elementType, T.ArrayType):
        axes = axes.withColumn("geom", F.explode("geom"))
    return axes.select("geom", F.col("oe_epoch").alias("epoch"), F.col("amplitude").alias("base_amplitude"), F.col("width_km").alias("width_limit"), F.lit(0).alias("generation"))


def read_layer(cells: DataFrame, layer: DataFrame | None, name: str, column: str, nodata: float, fill: float = 0.0) -> DataFrame:
    """cells and a layer's column, its sentinel and gaps as fill."""
    if layer is None:
        raise ValueError(f"no such layer: {name}")
    return cells.join(layer.select("r", "c", F.col(column).alias(name)), ["r", "c"], "left").withColumn(name, F.coalesce(A.from_sentinel(F.col(name), nodata), F.lit(fill)))


def write_units(cells: DataFrame, column: str, path: str, valid: str | None = None, nodata: int = -32768) -> None:
    """A layer as rounded small integers with a sentinel where it isn't valid."""
    value = F.col(column) if valid is None else F.when(F.expr(valid), F.col(column))
    cells.select("r", "c", A.to_sentinel(value, nodata).alias(column)).write.mode("overwrite").parquet(path)


def write_floats(cells: DataFrame, column: str, path: str, nodata: float = -9999.0) -> None:
    """A layer as floats, with a sentinel where it has no value."""
    cells.select("r", "c", F.coalesce(F.col(column).cast("float"), F.lit(nodata).cast("float")).alias(column)).write.mode("overwrite").parquet(path)


def write_mask(cells: DataFrame, column: str, path: str, on: int = 1) -> None:
    """A mask as bytes of 0 and on."""
    cells.select("r", "c", F.when(F.col(column), on).otherwise(0).cast("tinyint" if on < 128 else "smallint").alias(column)).write.mode("overwrite").parquet(path)


def write_network(edges: DataFrame, path: str) -> None:
    """A directed network with its node ids as strings."""
    names = [c for c in ("u", "v", "source", "target") if c in edges.columns]
    edges.withColumns({c: F.col(c).cast("string") for c in names}).write.mode("overwrite").parquet(path)


def setup_logger(folder: str | None = None, name: str = "strataframe") -> logging.Logger:
    """A logger to the console, and to a file of the folder if one is given. Called by programs, not on import."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
        if folder:
            handlers.append(logging.FileHandler(f"{folder}/{name}.log"))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(h)
    return log


def proxy_factor(pixel: float) -> float:
    """Scale of the proxy grid for a pixel size in metres: a 500th of it, within 0.1 and 1."""
    return max(0.1, min(1.0, pixel / 500.0)) if math.isfinite(pixel) else 1.0
