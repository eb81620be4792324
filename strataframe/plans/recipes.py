"""Declarative recipes: layers as plan nodes, folded into one projection over the cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import noise as N
from ..operators import distance as D
from ..operators.components import level_lakes
from ..sources.store import cut, tidied


@dataclass(frozen=True)
class Layer:
    """A named step of a recipe."""

    name: str


@dataclass(frozen=True)
class AltitudeMask:
    """Weight by the elevation as it is when the layer's turn comes."""

    least: float = 0.0
    fade: float = 100.0


@dataclass(frozen=True)
class FeatureMask:
    """Weight that fades over reach cells from the cells where column is set; without the column nothing is weighted in."""

    column: str
    reach: float = 200.0
    invert: bool = False


Mask = AltitudeMask | FeatureMask | None


@dataclass(frozen=True)
class FractalLayer(Layer):
    seed: int = 42
    scale: float = 100.0
    amplitude: float = 1.0
    kind: str = "FBM"
    octaves: int = 6
    persistence: float = 0.5
    lacunarity: float = 2.0
    mask: Mask = None


@dataclass(frozen=True)
class TectonicLayer(Layer):
    seed: int = 42
    frequency: float = 0.01
    amplitude: float = 1.0
    mode: str = "Distance"
    mask: Mask = None

    def __post_init__(self) -> None:
        if self.mode not in ("Distance", "Distance2Sub"):
            raise ValueError(f"ridge mode must be Distance or Distance2Sub: {self.mode}")


@dataclass(frozen=True)
class RoughLayer(Layer):
    """Noise at coordinates displaced by a finer noise."""

    seed: int = 42
    frequency: float = 0.01
    amplitude: float = 1.0
    kind: str = "FBM"
    perturb: float = 0.0
    mask: Mask = None


@dataclass(frozen=True)
class RiverWarpLayer(Layer):
    """Displaces the coordinates of later layers towards rivers."""

    river: str = "river"
    width: str = "width"
    strength: float = 1.0
    reach: float = 10.0


@dataclass(frozen=True)
class LakeLayer(Layer):
    """Lakes at the level of their lowest shore, less a depth."""

    lake: str = "lake"
    depth: float = 0.0


@dataclass(frozen=True)
class CoastLayer(Layer):
    """Elevation tapered to a sea level over a beach, or over a cliff where the land stands higher than its threshold."""

    sea: str = "sea"
    level: float = 0.0
    cliff_height: float = 100.0
    beach: float = 10.0
    cliff: float = 2.0


@dataclass
class Recipe:
    layers: Sequence[Layer] = field(default_factory=list)

    def build(self, cells: DataFrame, elevation: str = "elev") -> DataFrame:
        """cells with the layers applied to the elevation, in order.

        Layers with masks by altitude or without are narrow; warps, coasts and feature masks share one pass of distances.
        """
        out = cells.withColumns({"__x": F.col("c").cast("double"), "__y": F.col("r").cast("double")})
        masks = [getattr(layer, "mask", None) for layer in self.layers]
        features = [m.column for m in masks if isinstance(m, FeatureMask) and m.column in cells.columns]
        features += [x.river if isinstance(x, RiverWarpLayer) else x.sea for x in self.layers if isinstance(x, RiverWarpLayer | CoastLayer)]
        far = {column: f"__d{k}" for k, column in enumerate(dict.fromkeys(features))}  # layers change the elevation, not where features are
        if far:
            out = _with_far(out, far)
        for layer in self.layers:
            out = self._apply(out, layer, elevation, far)
        return out.drop("__x", "__y", *(f"{d}{x}" for d in far.values() for x in ("", "_r", "_c")))

    @staticmethod
    def _weight(mask: Mask, elevation: str, far: dict[str, str]) -> Column:
        if mask is None:
            return F.lit(1.0)
        if isinstance(mask, AltitudeMask):
            return A.altitude_weight(F.col(elevation), mask.least, mask.fade)
        return F.coalesce(A.distance_weight(F.col(far[mask.column]), mask.reach, mask.invert), F.lit(float(mask.invert)))

    def _apply(self, cells: DataFrame, layer: Layer, elevation: str, far: dict[str, str]) -> DataFrame:
        x, y = F.col("__x"), F.col("__y")
        columns = cells.columns
        if isinstance(layer, RiverWarpLayer):
            if layer.width not in columns:
                raise ValueError(f"no column {layer.width}")
            warped = D.warped(cells, far[layer.river], F.col(layer.width), F.lit(layer.strength), layer.reach)
            return warped.withColumns({"__x": x + F.col("warp_x"), "__y": y + F.col("warp_y")}).select(columns)
        if isinstance(layer, LakeLayer):
            level = level_lakes(cells, elevation, F.col(layer.lake), "__level")
            return level.withColumn(elevation, F.when(F.col(layer.lake), F.col("__level") - layer.depth).otherwise(F.col(elevation))).select(columns)
        if isinstance(layer, CoastLayer):
            reach = F.when(F.col(elevation) - layer.level > layer.cliff_height, F.lit(layer.cliff)).otherwise(F.lit(layer.beach))
            weight = F.coalesce(A.smoothstep(F.col(far[layer.sea]) / reach), F.lit(1.0))
            return cells.withColumn(elevation, F.lit(layer.level) + (F.col(elevation) - layer.level) * weight).select(columns)
        mask = getattr(layer, "mask", None)
        if isinstance(mask, FeatureMask) and mask.column not in far:  # weighs nothing in
            return cells.withColumn(elevation, F.col(elevation) + F.lit(0.0))
        stage = N.Stage(cells)
        if isinstance(layer, FractalLayer):
            f = 1.0 / max(layer.scale, 1e-4)
            noise = N.fractal(N.simplex, layer.octaves, layer.persistence, layer.lacunarity, layer.kind)(stage, x * F.lit(f), y * F.lit(f), layer.seed)
        elif isinstance(layer, TectonicLayer):
            noise = N.generated(stage, layer.mode, x, y, layer.frequency, layer.seed)
            noise = F.lit(1.0) - noise if layer.mode == "Distance" else noise
        elif isinstance(layer, RoughLayer):
            noise = N.generated(stage, layer.kind, x, y, layer.frequency, layer.seed, layer.perturb)
        else:
            raise TypeError(f"unknown layer: {type(layer).__name__}")
        weight = self._weight(mask, elevation, far)
        return stage.end(__noise=noise).withColumn(elevation, F.col(elevation) + F.col("__noise") * F.lit(layer.amplitude) * weight).select(columns)


@tidied
def _with_far(cells: DataFrame, far: dict[str, str]) -> DataFrame:
    """cells and the distances that layers need; cells are written first, as they are read three times for them."""
    return D.with_distances(cut(cells), **{d: F.col(column) for column, d in far.items()})


def tectonic_pass(
    cells: DataFrame,
    mode: str,
    frequency: float,
    amplitude: float,
    zone: int | None = None,
    side: str | None = None,
    seed: int = 42,
    perturb: float = 0.0,
    invert: bool = False,
    positive: bool = False,
    attenuate: bool = False,
    river_safety: bool = True,
    elevation: str = "elev",
    zone_column: str = "z",
) -> DataFrame:
    """Noise added to the cells of a zone, or of one side of the rivers (North, South by warp_y), less where influence is high.

    Uses warp_x, warp_y and influence where cells has them.
    """
    warp = ("warp_x", "warp_y") if "warp_x" in cells.columns else None
    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    stage = N.Stage(cells)
    noise = N.generated(stage, mode, x, y, frequency, seed, perturb, *(F.col(w) for w in warp or ()), **({"warp": 1.0} if warp else {}))
    cells = stage.end(__noise=noise)
    noise = A.shaped(F.col("__noise"), mode, invert, positive)
    if "influence" in cells.columns and river_safety:
        noise = A.attenuated(noise, F.col("influence"), attenuate)
    where = F.lit(True) if zone is None else F.col(zone_column) == zone
    if side is not None:
        where = where & ((F.col("warp_y") > 0) if side == "North" else (F.col("warp_y") < 0))
    return cells.withColumn(elevation, F.when(where, F.col(elevation) + noise * F.lit(amplitude)).otherwise(F.col(elevation))).drop("__noise")


@tidied
def _smoothed(cells: DataFrame, mask: str, sigma: float) -> DataFrame:
    """cells and __k: the mask blurred, where it is more than a half."""
    from ..operators.focal import gaussian

    blurred = gaussian(cells.withColumn("__v", F.col(mask).cast("double")), "__v", sigma, "__b")
    return cells.join(blurred, ["r", "c"]).withColumn("__k", F.col("__b") > 0.5).drop("__b")


def roughened(cells: DataFrame, mask: str, seed: int = 42, scale: float = 20.0, magnitude: float = 10.0, persistence: float = 0.5, lacunarity: float = 2.0, octaves: int = 3, kind: str = "FBM", pre_smooth: float = 0.0, name: str = "rough") -> DataFrame:
    """cells and the mask with a fractal border: its signed distance displaced by noise. Optionally blurred before."""
    at = _smoothed(cells, mask, pre_smooth) if pre_smooth > 0 else cells.withColumn("__k", F.col(mask))
    f = 1.0 / max(scale, 1e-4)
    noisy = N.add(D.with_signed_distance(at, F.col("__k"), "__sdf"), "__noise", N.fractal(N.perlin, octaves, persistence, lacunarity, kind), F.col("c") * F.lit(f), F.col("r") * F.lit(f), seed)
    return noisy.withColumn(name, F.col("__sdf") + F.col("__noise") * F.lit(magnitude) < 0).drop("__k", "__sdf", "__noise")


def fractal_mask(cells: DataFrame, mask: str, dimension: float, scale: float = 20.0, seed: int = 42, name: str = "rough") -> DataFrame:
    """A mask whose border has about this fractal dimension."""
    return roughened(cells, mask, seed, scale, 0.75 * scale, A.persistence_of(dimension), name=name)


def repaired(cells: DataFrame, rough: str, reference: str, valid: Column, boxes: list[tuple[int, int, int, int]], name: str = "mask") -> DataFrame:
    """Within the boxes the reference where there is data; elsewhere the rough mask."""
    return cells.withColumn(name, F.when(A.in_boxes(F.col("r"), F.col("c"), boxes), F.col(reference) & valid).otherwise(F.col(rough)))


def seabed(cells: DataFrame, level: float = -50.0, amplitude: float = 10.0, sigma: float = 100.0, seed: int = 42, elevation: str = "elev", active: str = "active_mask") -> DataFrame:
    """A base level, with broad noise of a fixed greatest magnitude where the mask is active."""
    from ..operators.focal import gaussian
    from ..operators.zonal import normalised

    white = N.add(cells, "__n", N.white, F.col("c"), F.col("r"), seed).withColumn("__n", F.col("__n") * F.lit(10.0))
    broad = normalised(gaussian(white, "__n", sigma, "__b"), "__b", "max_abs", amplitude, "__v").select("r", "c", "__v")
    return cells.join(broad, ["r", "c"]).withColumn(elevation, F.lit(level) + F.when(F.col(active) > 0, F.col("__v")).otherwise(F.lit(0.0))).drop("__v")


def activated(cells: DataFrame, bounds: str | None, steps: int = 10, heal: int = 2) -> DataFrame:
    """active_mask from a column of what lies within the bounds: sink strip at its edge, small holes healed."""
    from ..operators.focal import closed, sink_strip

    if bounds is None or bounds not in cells.columns:
        raise ValueError("the world has no bounds")
    strip = sink_strip(cells, F.col(bounds), steps)
    healed = closed(strip, F.col("active_mask") > 0, heal, "__h")
    return healed.withColumn("active_mask", F.when(F.col("__h") & (F.col("active_mask") == 0), 1).otherwise(F.col("active_mask"))).drop("__h")


def south_bank_ramp(cells: DataFrame, zone: Column, river: Column, metres: float, units: str = "units", scale: int = 2, pad: int = 50) -> DataFrame:
    """Units of a zone's southern bank raised from the river's shore to its hills. Distances see the zone's window only."""
    from ..operators.components import south_bank
    from ..operators.zonal import cropped, pasted, window_of

    box = window_of(cells, zone, pad)
    if box is None:
        return cells
    part = cropped(cells, box).withColumns({"__z": F.coalesce(zone, F.lit(False)), "__v": F.coalesce(river, F.lit(False))})
    bank = south_bank(part, F.col("__z"), F.col("__v"))
    part = part.join(bank, ["r", "c"], "left").withColumn("__s", F.coalesce("south", F.lit(False)) & ~F.col("__v"))
    ramp = D.between_ramp(part, F.col("__s"), F.col("__v"), ~F.col("__s") & ~F.col("__v"), "__ramp")
    raised = ramp.withColumn(units, A.add_ramp(F.col(units), F.col("__ramp"), F.col("__s"), metres, scale))
    return pasted(cells, raised, units)
