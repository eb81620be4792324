"""Cell-wise expressions of map algebra: Column in, Column out, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def smoothstep(t: Column) -> Column:
    """t * t * (3 - 2 t) of t clipped to 0..1."""
    t = clip(t)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def to_units(metres: Column | float, scale: int = 2) -> Column:
    """Metres as whole scaled units, cut off towards zero."""
    x = F.lit(metres) if isinstance(metres, (int, float)) else metres
    return (x * F.lit(float(scale))).cast("int")


def flatten(value: Column, mask: Column, to: float = 0.0) -> Column:
    """The value where the mask is set becomes a constant; a null mask isn't set."""
    return F.when(mask, F.lit(to)).otherwise(value)


def shift_zone(units: Column, zone: Column, zone_id: int, metres: float, scale: int = 2) -> Column:
    """Whole units added in one zone; null units (no data) stay null."""
    k = int(metres * scale)
    return F.when((zone == F.lit(zone_id)) & units.isNotNull(), units + F.lit(k)).otherwise(units)


def lithology(sea: Column, fracture: Column, base: int = 10, sea_id: int = 99, fracture_id: int = 50) -> Column:
    """Rock code of a cell: sea before fracture before base."""
    return F.when(sea, F.lit(sea_id)).when(fracture, F.lit(fracture_id)).otherwise(F.lit(base))


def altitude_weight(elevation: Column, least: float = 0.0, fade: float = 100.0) -> Column:
    """0 below least, 1 from least + fade on."""
    return clip((elevation - F.lit(float(least))) / F.lit(float(fade)))


def distance_weight(distance: Column, reach: float, invert: bool = False) -> Column:
    """1 at a feature, 0 from reach on; the other way round if inverted."""
    w = clip(F.lit(1.0) - distance / F.lit(float(reach)))
    return F.lit(1.0) - w if invert else w


def attenuated(noise: Column, influence: Column, on: bool = True) -> Column:
    """Noise near rivers: times 1 - influence, and once more if attenuation is on."""
    out = noise * (F.lit(1.0) - influence)
    return out * (F.lit(1.0) - influence) if on else out


#: Noise modes with values from 0 on; their inverse is 1 - v, others' is -v.
DISTANCE_MODES = ("Distance", "Distance2Sub", "Cellular")
#: Modes that are moved from -1..1 to 0..1 to be positive.
SIGNED_MODES = ("Simplex", "Directional", "FBM", "Billow", "RidgedMulti")


def shaped(noise: Column, mode: str, invert: bool = False, positive: bool = False) -> Column:
    if invert:
        noise = F.lit(1.0) - noise if mode in DISTANCE_MODES else -noise
    if positive and mode in SIGNED_MODES:
        noise = (noise + F.lit(1.0)) / F.lit(2.0)
    return noise


def add_ramp(units: Column, ramp: Column, mask: Column, metres: float, scale: int = 2) -> Column:
    """Units raised by ramp (0..1) of so many metres where the mask is set, cut off towards zero."""
    return F.when(mask, units + (ramp * F.lit(float(int(metres * scale)))).cast("int")).otherwise(units)


def carved(units: Column, distance: Column, scour: Column, base: float = 5.0, width_factor: float = 2.0, sea: int = 0, scale: int = 2) -> Column:
    """A channel's bed: deeper towards its middle, by rock; never below sea, which also lifts what was."""
    depth = ((F.lit(base) + distance * F.lit(width_factor)) * scour * F.lit(float(scale))).cast("int")
    return F.when(distance > 0, F.greatest(units - depth, F.lit(sea))).otherwise(units)


def looked_up(key: Column, table: Mapping[int, float], default: float) -> Column:
    """Value of a key in a small fixed table."""
    if not table:
        return F.lit(default)
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def from_sentinel(value: Column, nodata: float) -> Column:
    return F.when(F.isnan(value.cast("double")) | (value == F.lit(nodata)), F.lit(None)).otherwise(value)


def to_sentinel(value: Column, nodata: int = -32768, kind: str = "smallint") -> Column:
    """Rounded half to even for storage; null becomes the sentinel."""
    return F.coalesce(F.rint(value).cast(kind), F.lit(nodata).cast(kind))


def in_boxes(row: Column, col: Column, boxes: list[tuple[int, int, int, int]]) -> Column:
    """Inside one of (west, north, east, south), ends exclusive."""
    out = F.lit(False)
    for w, n, e, s in boxes:
        out = out | ((col >= w) & (col < e) & (row >= n) & (row < s))
    return out


def persistence_of(dimension: float) -> float:
    """Octave persistence of a fractal dimension between 1 and 2."""
    return 2.0 ** (dimension - 2.0)


def coast_dimension(dimension: Column) -> Column:
    """A measured dimension held within the range of real coasts."""
    return clip(dimension, 1.1, 1.45)


def river_width(magnitude: Column, least: float = 10.0, most: float = 500.0, scale: float = 1.5) -> Column:
    """Width that grows with the logarithm of the flow."""
    return F.least(F.lit(least) + F.log(F.greatest(magnitude.cast("double"), F.lit(1.0))) * F.lit(scale), F.lit(most))


def detail(base: Column, lakes: Column, minor: Column, major: Column, north: Column, n1000: Column, n500: Column, n100: Column, n50: Column, nodata: float = -9999.0) -> Column:
    """Layered surface detail: fine noise by altitude on land, half of the broad noise on terraces along major rivers.

    Land is where all three water layers are negative, as no data reads as 0 there.
    """
    land = (lakes < 0) & (minor < 0) & (major < 0)
    broad = n1000 * F.lit(300.0)
    high = F.when(base > 1000, n100 * F.lit(1600.0)).otherwise(F.lit(0.0))
    middle = F.when((base > 500) | (north > 0), n500 * F.lit(300.0)).otherwise(F.lit(0.0))
    top = F.when(base > 2000, n50 * F.lit(1600.0)).otherwise(F.lit(0.0))
    terrace = (major > 0) & (minor < 0)
    out = F.when(land, base + broad + high + middle + top).when(terrace, base + broad * F.lit(0.5)).otherwise(base)
    return F.when(out < -200, F.lit(nodata)).otherwise(out)
