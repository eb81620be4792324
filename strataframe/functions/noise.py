"""Lattice noise from integer hashes: reproducible in any engine of 64-bit integers.

A noise is built in steps on a Stage: each step's values become columns of their own projection, so that
what is used several times is computed once and expressions stay small. All steps are narrow; the columns
go when the stage ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 2147483647
#: Lattice coordinates are shifted by this to be positive.
SHIFT = 1 << 20
#: Bytes of code of the largest method that a JVM compiles.
COMPILED = 8000


class Stage:
    """A DataFrame under work, and its temporary columns.

    The steps' projections make one generated method, which a JVM doesn't compile beyond 8,000 bytes of code: a
    setting of the session lets Spark run such steps one by one, in methods that are compiled.
    """

    def __init__(self, df: DataFrame):
        conf, key = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
        if int(conf.get(key)) > COMPILED:
            conf.set(key, str(COMPILED))
        self.df, self.columns, self.count = df, list(df.columns), 0

    def let(self, *values: Column) -> list[Column]:
        """The values as columns."""
        names = [f"__n{self.count + i}" for i in range(len(values))]
        self.count += len(values)
        self.df = self.df.withColumns(dict(zip(names, values, strict=True)))
        return [F.col(n) for n in names]

    def end(self, **results: Column) -> DataFrame:
        return self.df.withColumns(results).select(*[c for c in self.columns if c not in results], *results)


Noise = Callable[[Stage, Column, Column, int], Column]


def lattice_hashes(s: Stage, points: list[tuple[Column, Column]], seed: int) -> list[Column]:
    """0 <= h < M of pairs of integers; all products stay within 64 bits."""
    flat = s.let(*(c.cast("long") + F.lit(SHIFT) for p in points for c in p))
    xs, ys = flat[::2], flat[1::2]
    a = s.let(*((x * F.lit(73856093) + y * F.lit(19349663) + F.lit(seed * 83492791 + 12345)) % F.lit(M) for x, y in zip(xs, ys, strict=True)))
    b = s.let(*((v * v + y * F.lit(40503) + F.lit(977)) % F.lit(M) for v, y in zip(a, ys, strict=True)))
    return s.let(*((v * v + x * F.lit(30011) + F.lit(613)) % F.lit(M) for v, x in zip(b, xs, strict=True)))


def _unit(h: Column) -> Column:
    return h / F.lit(float(M))


def white(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
    """-1..1, independent by cell."""
    return _unit(lattice_hashes(s, [(F.floor(x), F.floor(y))], seed)[0]) * F.lit(2.0) - F.lit(1.0)


def _fade(t: Column) -> Column:
    return t * t * t * (t * (t * F.lit(6.0) - F.lit(15.0)) + F.lit(10.0))


def _lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def _lattice(s: Stage, x: Column, y: Column, seed: int, corner: Callable[[Column, Column, Column], Column]) -> Column:
    x, y, ix, iy = s.let(x, y, F.floor(x), F.floor(y))
    fx, fy = s.let(x - ix, y - iy)
    steps = [(0, 0), (1, 0), (0, 1), (1, 1)]
    h = lattice_hashes(s, [(ix + F.lit(i), iy + F.lit(j)) for i, j in steps], seed)
    k = s.let(*(corner(v, fx - F.lit(float(i)), fy - F.lit(float(j))) for v, (i, j) in zip(h, steps, strict=True)), _fade(fx), _fade(fy))
    return s.let(_lerp(_lerp(k[0], k[1], k[4]), _lerp(k[2], k[3], k[4]), k[5]))[0]


def value(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
    """-1..1, smooth between random lattice values."""
    return _lattice(s, x, y, seed, lambda h, fx, fy: _unit(h) * F.lit(2.0) - F.lit(1.0))


def _gradient(h: Column, fx: Column, fy: Column) -> Column:
    """Dot product with one of eight directions: four diagonals, then four axes as long."""
    g, root = h % F.lit(8), F.lit(2.0**0.5)
    out = F.when(g == 0, fx + fy).when(g == 1, fy - fx).when(g == 2, fx - fy).when(g == 3, -fx - fy)
    return out.when(g == 4, fx * root).when(g == 5, -fx * root).when(g == 6, fy * root).otherwise(-fy * root)


def perlin(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
    """Gradient noise, about -1..1 and 0 at lattice points."""
    return _lattice(s, x, y, seed, _gradient)


_SKEW, _UNSKEW = 0.5 * (3.0**0.5 - 1.0), (3.0 - 3.0**0.5) / 6.0


def simplex(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
    """Gradient noise on triangles, about -1..1."""
    x, y = s.let(x, y)
    skew = (x + y) * F.lit(_SKEW)
    i, j = s.let(F.floor(x + skew), F.floor(y + skew))
    t = (i + j) * F.lit(_UNSKEW)
    x0, y0 = s.let(x - (i - t), y - (j - t))
    (right,) = s.let(F.when(x0 > y0, F.lit(1)).otherwise(F.lit(0)))
    u = F.lit(_UNSKEW)
    h = lattice_hashes(s, [(i, j), (i + right, j + F.lit(1) - right), (i + F.lit(1), j + F.lit(1))], seed)
    far = F.lit(2.0) * u - F.lit(1.0)
    at = s.let(x0, y0, x0 - right + u, y0 - F.lit(1) + right + u, x0 + far, y0 + far)
    k = s.let(*(F.greatest(F.lit(0.0), F.lit(0.5) - a * a - b * b) for a, b in zip(at[::2], at[1::2], strict=True)))
    parts = s.let(*(v * v * v * v * _gradient(g, a, b) for v, g, a, b in zip(k, h, at[::2], at[1::2], strict=True)))
    return s.let(F.lit(70.0) * (parts[0] + parts[1] + parts[2]))[0]


def _feature_distances(s: Stage, x: Column, y: Column, seed: int) -> Column:
    """Distances to the random points of the 3 x 3 cells around, in order."""
    x, y, ix, iy = s.let(x, y, F.floor(x), F.floor(y))
    cells = [(ix + F.lit(i), iy + F.lit(j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    hx, hy = lattice_hashes(s, cells, seed), lattice_hashes(s, cells, seed + 1)
    off = s.let(*(c + _unit(h) - at for (cx, cy), a, b in zip(cells, hx, hy, strict=True) for c, h, at in ((cx, a, x), (cy, b, y))))
    return s.let(F.sort_array(F.array(*(F.sqrt(a * a + b * b) for a, b in zip(off[::2], off[1::2], strict=True)))))[0]


def cellular(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
    """Distance to the nearest random point."""
    return _feature_distances(s, x, y, seed)[0]


def ridge_distance(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
    """Second nearest minus nearest distance: 0 on the borders between cells."""
    d = _feature_distances(s, x, y, seed)
    return d[1] - d[0]


def fractal(base: Noise, octaves: int = 3, persistence: float = 0.5, lacunarity: float = 2.0, kind: str = "FBM") -> Noise:
    """Octaves of a noise: FBM as it is, Billow of its absolute value, RidgedMulti of one minus it. About -1..1."""
    if kind not in ("FBM", "Billow", "RidgedMulti"):
        raise ValueError(f"unknown fractal kind: {kind}")

    def run(s: Stage, x: Column, y: Column, seed: int = 42) -> Column:
        total, amplitude, frequency, norm = F.lit(0.0), 1.0, 1.0, 0.0
        x, y = s.let(x, y)
        for k in range(octaves):
            n = base(s, x * F.lit(frequency), y * F.lit(frequency), seed + k)
            if kind == "Billow":
                n = F.abs(n) * F.lit(2.0) - F.lit(1.0)
            elif kind == "RidgedMulti":
                n = F.lit(1.0) - F.abs(n) * F.lit(2.0)
            total = total + n * F.lit(amplitude)
            norm += amplitude
            amplitude, frequency = amplitude * persistence, frequency * lacunarity
        return s.let(total / F.lit(norm))[0]

    return run


#: Noise by mode name.
MODES: dict[str, Noise] = {
    "WhiteNoise": white,
    "Value": value,
    "Perlin": perlin,
    "Simplex": simplex,
    "Directional": simplex,
    "Cellular": cellular,
    "Distance": cellular,
    "Distance2Sub": ridge_distance,
    "FBM": fractal(simplex, 3),
    "Billow": fractal(simplex, 3, kind="Billow"),
    "RidgedMulti": fractal(simplex, 4, kind="RidgedMulti"),
}


def generated(s: Stage, mode: str, x: Column, y: Column, frequency: float, seed: int = 42, perturb: float = 0.0, warp_x: Column | None = None, warp_y: Column | None = None, warp: float = 0.0) -> Column:
    """Noise of a mode at scaled coordinates, first displaced by a finer noise and by warp fields."""
    if mode not in MODES:
        raise ValueError(f"unknown noise mode: {mode}")
    if perturb:
        shift = simplex(s, x * F.lit(frequency * 2), y * F.lit(frequency * 2), seed + 999) * F.lit(perturb)
        x, y = s.let(x + shift, y + shift)
    if warp_x is not None:
        x, y = s.let(x + warp_x * F.lit(warp), y + warp_y * F.lit(warp))
    return MODES[mode](s, x * F.lit(frequency), y * F.lit(frequency), seed)


def add(df: DataFrame, name: str, noise: Noise, x: Column, y: Column, seed: int = 42) -> DataFrame:
    """df and a column of noise."""
    s = Stage(df)
    return s.end(**{name: noise(s, x, y, seed)})
