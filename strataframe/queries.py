"""Registered queries of the grid and network operators, with their SQL twins.

Twins state the result directly (often by brute force over the small tables), not the operator's plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions import algebra as A
from .functions import noise as N
from .operators import components as C
from .operators import distance as D
from .operators import focal, lines, raster, resample, rivers, zonal
from .plans import recipes as P
from .sources import scans, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(x: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def with_(*views: str) -> str:
    return "with " + ", ".join(views) + " "


O, E, B, R, X = V.SQL_O, V.SQL_E, V.SQL_B, V.SQL_R, V.SQL_X  # noqa: E741

# ---- cell-wise map algebra


@query(with_(O) + "select z as zone, count(*) n, round(avg(case when m = 0 then 0 else elev + 25 * z end), 6) + 0.0 mean_elev from grid_o group by z")
def zonal_uplift_stats(spark, d):
    raised = F.col("elev") + A.looked_up(F.col("z"), {k: 25.0 * k for k in range(1, 6)}, 0.0)
    out = zonal.zonal(V.grid_o(spark, d), "z", A.flatten(raised, F.col("m") == 0))
    return out.select(F.col("z").alias("zone"), "n", rounded("mean").alias("mean_elev"))


@query(with_(O) + "select r, c, round(case when m = 0 then 0 else elev end, 6) + 0.0 elev from grid_o")
def flatten_by_mask(spark, d):
    return V.grid_o(spark, d).select("r", "c", rounded(A.flatten(F.col("elev"), F.col("m") == 0)).alias("elev"))


@query(with_(O) + "select r, c, cast(case when m = 2 then -32768 when z = 3 then trunc(elev * 2) + 2 when z = 2 then trunc(elev * 2) - 2 else trunc(elev * 2) end as int) units from grid_o")
def zone_shift_trunc(spark, d):
    units = F.when(F.col("m") != 2, A.to_units(F.col("elev")))
    at = V.grid_o(spark, d).withColumn("units", units)
    for zone, metres in ((3, 1.3), (2, -1.3), (4, 0.4)):
        at = at.withColumn("units", A.shift_zone(F.col("units"), F.col("z"), zone, metres))
    return at.select("r", "c", F.coalesce("units", F.lit(-32768)).alias("units"))


@query(with_(O, E) + "select case when m = 0 then 99 when river then 50 else 10 end code, count(*) n from grid_o left join grid_e using (r, c) group by 1")
def lithology_priority(spark, d):
    cells = V.grid_o(spark, d).join(V.grid_e(spark, d), ["r", "c"], "left")
    return cells.groupBy(A.lithology(F.col("m") == 0, F.col("river")).alias("code")).agg(F.count("*").alias("n"))


@query(with_(O) + "select r, c, round(greatest(0, least(1, (elev - 500) / 200.0::double)), 6) + 0.0 weight from grid_o")
def altitude_ramp(spark, d):
    return V.grid_o(spark, d).select("r", "c", rounded(A.altitude_weight(F.col("elev"), 500, 200)).alias("weight"))


@query(
    with_(B)
    + """, s as (select r, c, elev base, case when m = 0 then 1 else -1 end lakes, case when river then 1 else -1 end minor, case when z = 5 then 1 else -1 end major, case when r < 50 then 1 else -1 end north, v / 100 a, v / 200 b, v / 400 e, v / 800 f from cells),
t as (select r, c, case when lakes < 0 and minor < 0 and major < 0 then base + a * 300 + case when base > 1000 then e * 1600 else 0 end + case when base > 500 or north > 0 then b * 300 else 0 end + case when base > 2000 then f * 1600 else 0 end
  when major > 0 and minor < 0 then base + a * 300 * 0.5 else base end x from s)
select r, c, round(case when x < -200 then -9999 else x end, 6) + 0.0 elev from t"""
)
def detail_stack(spark, d):
    sign = lambda x: F.when(x, 1).otherwise(-1)
    v = F.col("v")
    out = A.detail(F.col("elev"), sign(F.col("m") == 0), sign(F.col("river")), sign(F.col("z") == 5), sign(F.col("r") < 50), v / 100, v / 200, v / 400, v / 800)
    return V.both(spark, d).select("r", "c", rounded(out).alias("elev"))


@query(with_(O) + "select count(*) n, count(*) filter (m <> 2) valid, cast(sum(case when m <> 2 then round_even(elev, 0) else -32768 end) as bigint) total from grid_o")
def nodata_roundtrip(spark, d):
    stored = V.grid_o(spark, d).select(A.to_sentinel(F.when(F.col("m") != 2, F.col("elev"))).cast("int").alias("u"))
    return stored.agg(F.count("*").alias("n"), F.count(A.from_sentinel(F.col("u"), -32768)).alias("valid"), F.sum("u").alias("total"))


_BOXES = [(10, 10, 40, 30), (50, 20, 90, 60)]


@query(with_(B) + "select r, c, case when (c >= 10 and c < 40 and r >= 10 and r < 30) or (c >= 50 and c < 90 and r >= 20 and r < 60) then z >= 3 and m <> 2 else river end mask from cells")
def box_repair(spark, d):
    cells = V.both(spark, d).withColumn("ref", F.col("z") >= 3)
    return P.repaired(cells, "river", "ref", F.col("m") != 2, _BOXES).select("r", "c", "mask")


@query(with_(E) + "select r, c, round(v - avg(v) over (), 6) + 0.0 centred, round(v - min(v) over (), 6) + 0.0 raised, round(v * 10 / max(abs(v)) over (), 6) + 0.0 scaled from grid_e")
def global_normalise(spark, d):
    at = V.grid_e(spark, d)
    for how, name in (("mean", "centred"), ("min", "raised"), ("max_abs", "scaled")):
        at = zonal.normalised(at, "v", how, name=name)
    return at.select("r", "c", *(rounded(x).alias(x) for x in ("centred", "raised", "scaled")))


@query(with_(O) + "select round(min(elev), 6) + 0.0 low, round(max(elev), 6) + 0.0 high, round(avg(elev), 6) + 0.0 mean, round(stddev_pop(elev), 6) + 0.0 std from grid_o")
def grid_summary(spark, d):
    return zonal.summary(V.grid_o(spark, d), "elev").select(*(rounded(x).alias(x) for x in ("low", "high", "mean", "std")))


@query(with_(O) + "select r, c, case z when 1 then 0.5 when 2 then 1.5 else 1.0 end::double width_mod, case z when 2 then 0.25 when 5 then 2.0 else 1.0 end::double strength_mod from grid_o")
def zone_param_lookup(spark, d):
    look = lambda t: A.looked_up(F.col("z"), t, 1.0)
    return V.grid_o(spark, d).select("r", "c", look({1: 0.5, 2: 1.5}).alias("width_mod"), look({2: 0.25, 5: 2.0}).alias("strength_mod"))


@query(with_(B) + "select r, c, round(v * (1 - least(1, elev / 5000)), 6) + 0.0 once, round(v * (1 - least(1, elev / 5000)) * (1 - least(1, elev / 5000)), 6) + 0.0 twice, round(1 - v, 6) + 0.0 inverted, round((v + 1) / 2, 6) + 0.0 positive from cells")
def noise_shaping(spark, d):
    v, i = F.col("v"), F.least(F.lit(1.0), F.col("elev") / 5000)
    return V.both(spark, d).select("r", "c", rounded(A.attenuated(v, i, False)).alias("once"), rounded(A.attenuated(v, i)).alias("twice"), rounded(A.shaped(v, "Distance", invert=True)).alias("inverted"), rounded(A.shaped(v, "FBM", positive=True)).alias("positive"))


# ---- neighbourhoods


@query(
    with_(O)
    + """, s as (select r, c, z >= 3 m from grid_o), n as (select a.r, a.c, a.m, bool_or(coalesce(b.m, false)) or a.m hit, (count(b.m) = 4 and bool_and(b.m)) and a.m every
  from s a left join s b on abs(a.r - b.r) + abs(a.c - b.c) = 1 and b.r between a.r - 1 and a.r + 1 group by a.r, a.c, a.m) select r, c from n where hit and not every"""
)
def edge_cells(spark, d):
    return focal.edges(V.grid_o(spark, d).withColumn("k", F.col("z") >= 3), "k")


@query(with_(O) + "select distinct a.r, a.c from grid_o a join grid_o b on abs(a.r - b.r) + abs(a.c - b.c) = 1 and b.r between a.r - 1 and a.r + 1 where a.z = 1 and b.z = 2")
def contact_lines(spark, d):
    return focal.contact(V.grid_o(spark, d), F.col("z") == 1, F.col("z") == 2)


@query(with_(O) + "select distinct a.r, a.c, b.z label from grid_o a join grid_o b on b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1 where a.m <> 0 and b.m = 0")
def shore_cells(spark, d):
    return focal.shore(V.grid_o(spark, d).withColumn("label", F.when(F.col("m") == 0, F.col("z"))), "label")


_STEPS = "select i, j from range(-{k}, {k} + 1) a(i), range(-{k}, {k} + 1) b(j) where abs(i) + abs(j) <= {k}"


@query(
    with_(O, "step as (" + _STEPS.format(k=1) + ")")
    + """, near as (select a.r, a.c, a.z, bool_and(coalesce(b.z >= 2, false)) kept from grid_o a cross join step left join grid_o b on b.r = a.r + i and b.c = a.c + j group by all)
select case when z >= 2 and kept then 1 when z >= 2 then 2 else 0 end active_mask, count(*) n from near group by 1"""
)
def erode_l1_sink(spark, d):
    return focal.sink_strip(V.grid_o(spark, d).select("r", "c", "z"), F.col("z") >= 2, 1).groupBy("active_mask").agg(F.count("*").alias("n"))


@query(
    with_(O, "step as (" + _STEPS.format(k=2) + ")")
    + """, wide as (select a.r, a.c, a.z, bool_or(coalesce(b.z = 4, false)) m from grid_o a cross join step left join grid_o b on b.r = a.r + i and b.c = a.c + j group by all),
back as (select a.r, a.c, a.z, bool_and(coalesce(b.m, false)) k from wide a cross join step left join wide b on b.r = a.r + i and b.c = a.c + j group by all)
select k or z = 4 closed, z = 4 was, count(*) n from back group by all"""
)
def closing_fill(spark, d):
    return focal.closed(V.grid_o(spark, d), F.col("z") == 4, 2).groupBy("closed", (F.col("z") == 4).alias("was")).agg(F.count("*").alias("n"))


@query(with_(O) + "select a.r, a.c, round(sum(b.elev) / 25, 6) + 0.0 mean from grid_o a join grid_o b on b.r between a.r - 2 and a.r + 2 and b.c between a.c - 2 and a.c + 2 group by all")
def box_mean(spark, d):
    return focal.box_mean(V.grid_o(spark, d), "elev", 2).select("r", "c", rounded("mean").alias("mean"))


@query(
    with_(O, "step as (select i, j from range(-2, 3) a(i), range(-2, 3) b(j))")
    + """, s as (select r, c, case when m = 2 then null else elev end x from grid_o),
w as (select a.r, a.c, a.x, sum(case when b.x is null then 0 else 1 end) / 25 share, sum(coalesce(b.x * 2, 0)) / 25 total from s a cross join step left join s b on b.r = a.r + i and b.c = a.c + j group by all),
one as (select r, c, x, share, case when share > 0 then total / share else 0 end v from w),
two as (select a.r, a.c, a.x, a.share, sum(coalesce(b.v, 0)) / 25 total from one a cross join step left join one b on b.r = a.r + i and b.c = a.c + j group by all)
select r, c, cast(case when x is null then -32768 else round_even(case when share > 0 then total / share else 0 end, 0) end as int) smooth from two"""
)
def destep(spark, d):
    at = V.grid_o(spark, d).withColumn("x", F.when(F.col("m") != 2, F.col("elev")))
    return focal.destep(at, "x", 2, 2).select("r", "c", F.coalesce("smooth", F.lit(-32768)).alias("smooth"))


_KERNEL = focal.gaussian_kernel(1.0)


@query(
    with_(E)
    + f""", k as (select unnest(range(-4, 5)) i, unnest([{", ".join(f"{x:.17g}::double" for x in _KERNEL)}]) w), size as (select max(r) + 1 h, max(c) + 1 n from grid_e),
rows as (select a.r, a.c, sum(k.w * b.v) v from grid_e a cross join k cross join size join grid_e b on b.c = a.c and b.r = case when a.r + i < 0 then -1 - a.r - i when a.r + i >= h then 2 * h - 1 - a.r - i else a.r + i end group by all)
select a.r, a.c, round(sum(k.w * b.v), 6) + 0.0 blurred from rows a cross join k cross join size join rows b on b.r = a.r and b.c = case when a.c + i < 0 then -1 - a.c - i when a.c + i >= n then 2 * n - 1 - a.c - i else a.c + i end group by all"""
)
def gaussian_blur(spark, d):
    return focal.gaussian(V.grid_e(spark, d), "v", 1.0, size=64).select("r", "c", rounded("blurred").alias("blurred"))


def _erosion_sql(steps: int) -> str:
    parts = ["e0 as (select r, c, case when m = 2 then null else elev end h from grid_o)", "size as (select max(r) hi, max(c) wi from grid_o)"]
    for k in range(steps):
        parts.append(
            f"""e{k + 1} as (select a.r, a.c, case when a.h > 0 and a.r > 0 and a.r < any_value(hi) and a.c > 0 and a.c < any_value(wi) then a.h - 0.1::double * coalesce(sum(greatest(a.h - b.h - 4, 0)), 0) else a.h end h
  from e{k} a cross join size left join e{k} b on abs(a.r - b.r) + abs(a.c - b.c) = 1 and b.r between a.r - 1 and a.r + 1 and b.h is not null group by a.r, a.c, a.h)"""
        )
    return with_(O, *parts) + f"select r, c, coalesce(round(h, 8), -32768) + 0.0 h from e{steps}"


@query(_erosion_sql(1))
def thermal_erosion_step(spark, d):
    at = V.grid_o(spark, d).withColumn("x", F.when(F.col("m") != 2, F.col("elev")))
    return focal.erosion_step(at, "x", 4.0, 0.1, "h").select("r", "c", (F.coalesce(F.round("h", 8), F.lit(-32768.0)) + F.lit(0.0)).alias("h"))


@query(_erosion_sql(3))
def thermal_erosion_k(spark, d):
    at = V.grid_o(spark, d).withColumn("x", F.when(F.col("m") != 2, F.col("elev")))
    return focal.erosion(at, "x", 3, 4.0, 0.1, "h", per_shuffle=2, size=64).select("r", "c", (F.coalesce(F.round("h", 8), F.lit(-32768.0)) + F.lit(0.0)).alias("h"))


# ---- distances

_FAR = "min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))"


@query(with_(E) + f"select a.r, a.c, round(sqrt({_FAR}), 6) + 0.0 d from grid_e a, (select * from grid_e where river) b group by a.r, a.c")
def edt(spark, d):
    return D.distance(V.grid_e(spark, d), F.col("river")).select("r", "c", rounded("d").alias("d"))


_SDF = f"""o as (select a.r, a.c, sqrt({_FAR}) d from grid_e a, (select * from grid_e where river) b group by a.r, a.c), i as (select a.r, a.c, sqrt({_FAR}) d from grid_e a, (select * from grid_e where not river) b group by a.r, a.c)"""


@query(with_(E, _SDF) + "select r, c, round(o.d - i.d, 6) + 0.0 sdf from o join i using (r, c)")
def sdf(spark, d):
    return D.signed_distance(V.grid_e(spark, d), F.col("river")).select("r", "c", rounded("sdf").alias("sdf"))


_SEA = "(r * 100 + c) % 97 = 0"


@query(
    with_(O)
    + f""", t as (select a.r, a.c, any_value(a.elev) elev, pow(least(1, sqrt({_FAR}) / 10.0::double), 2.0::double) taper from grid_o a, (select * from grid_o where (r * 100 + c) % 97 = 0) b group by a.r, a.c)
select r, c, round(taper, 6) + 0.0 taper, cast(round_even(trunc(elev * 2) * taper, 0) as int) units from t"""
)
def coastal_taper(spark, d):
    at = D.taper(V.grid_o(spark, d).select("r", "c", "elev"), F.expr(_SEA), 10.0)
    return at.select("r", "c", rounded("taper").alias("taper"), F.rint(A.to_units(F.col("elev")) * F.col("taper")).cast("int").alias("units"))


@query(
    with_(O)
    + """, low as (select r // 2 r, c // 2 c, (r * 100 + c) % 97 = 0 sea from grid_o where r % 2 = 0 and c % 2 = 0), size as (select max(r) + 1.0::double h, max(c) + 1.0::double w from grid_o), ls as (select max(r) + 1.0::double lh, max(c) + 1.0::double lw from low),
t as (select a.r, a.c, pow(least(1, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) / 5.0::double), 2.0::double) v from low a, (select * from low where sea) b group by a.r, a.c),
p as (select r, c, greatest(0, least(lh - 1, (r + 0.5) * lh / h - 0.5)) y, greatest(0, least(lw - 1, (c + 0.5) * lw / w - 0.5)) x, lh, lw from grid_o, size, ls), q as (select *, cast(floor(y) as int) y0, cast(floor(x) as int) x0 from p)
select q.r, q.c, round(sum(t.v * (1 - abs(y - (y0 + i))) * (1 - abs(x - (x0 + j)))), 6) + 0.0 taper from q, range(0, 2) s(i), range(0, 2) u(j), t where t.r = least(y0 + i, lh - 1) and t.c = least(x0 + j, lw - 1) and 1 - abs(y - (y0 + i)) > 0 and 1 - abs(x - (x0 + j)) > 0 group by q.r, q.c"""
)
def coarse_taper(spark, d):
    return D.coarse_taper(V.grid_o(spark, d), F.expr(_SEA), 10.0, 2.0, 2).select("r", "c", rounded("taper").alias("taper"))


@query(
    with_(B)
    + f""", d as (select a.r, a.c, any_value(a.z) z, sqrt({_FAR}) d from cells a, (select * from cells where river and v > 150) b group by a.r, a.c), t as (select r, c, greatest(0, least(1, 1 - d / greatest(6.0::double * case when z = 1 then 0.5 else 1 end, 0.001))) t from d)
select r, c, round(t * t * (3 - 2 * t), 6) + 0.0 influence from t"""
)
def river_warp(spark, d):
    at = D.warp_field(V.both(spark, d), F.col("river") & (F.col("v") > 150), A.looked_up(F.col("z"), {1: 0.5}, 1.0), F.lit(2.0), 6.0)
    return at.select("r", "c", rounded("influence").alias("influence"))


@query(
    with_(B)
    + f""", d as (select a.r, a.c, any_value(a.z) z, any_value(a.elev) elev, any_value(a.river) river, sqrt({_FAR}) d from cells a, (select * from cells where not river) b group by a.r, a.c)
select r, c, cast(case when river and d > 0 then greatest(trunc(elev * 2) - trunc((5 + d * 2) * case z when 5 then 1.5 else 1.0 end * 2), 0) else trunc(elev * 2) end as int) units from d"""
)
def hydraulic_carve(spark, d):
    at = V.both(spark, d).withColumn("units", A.to_units(F.col("elev")))
    return D.carve(at, "units", F.col("river"), A.looked_up(F.col("z"), {5: 1.5}, 1.0)).select("r", "c", F.col("carved").alias("units"))


@query("select max(trunc(elev * 2) - units)::int units, round(max(trunc(elev * 2) - units) / 2.0::double, 6) + 0.0 metres from (" + SQL["hydraulic_carve"] + ") join (select cast(o_orderkey // 100 as int) r, cast(o_orderkey % 100 as int) c, o_totalprice / 100.0::double elev from orders) using (r, c)")
def greatest_cut(spark, d):
    at = V.both(spark, d).withColumn("units", A.to_units(F.col("elev")))
    carved = D.carve(at, "units", F.col("river"), A.looked_up(F.col("z"), {5: 1.5}, 1.0))
    return zonal.greatest_cut(carved, "units", "carved").select("units", rounded("metres").alias("metres"))


@query(
    with_(B)
    + f""", l as (select a.r, a.c, sqrt({_FAR}) d from cells a, (select * from cells where river) b group by a.r, a.c), h as (select a.r, a.c, sqrt({_FAR}) d from cells a, (select * from cells where z = 5 and not river) b group by a.r, a.c)
select r, c, round(case when z between 2 and 4 and not river then l.d / (l.d + h.d) else 0 end, 6) + 0.0 ramp, cast(case when z between 2 and 4 and not river then trunc(l.d / (l.d + h.d) * 20) else 0 end as int) delta from cells join l using (r, c) join h using (r, c)"""
)
def ramp(spark, d):
    mask = F.col("z").between(2, 4) & ~F.col("river")
    at = D.between_ramp(V.both(spark, d).select("r", "c", "z", "river"), mask, F.col("river"), (F.col("z") == 5) & ~F.col("river"))
    return at.select("r", "c", rounded("ramp").alias("ramp"), A.add_ramp(F.lit(0), F.col("ramp"), mask, 10.0).alias("delta"))


@query(with_(E) + f"select a.r, a.c, round(greatest(0, 1 - sqrt({_FAR}) / 3.0::double), 6) + 0.0 w, round(1 - greatest(0, 1 - sqrt({_FAR}) / 3.0::double), 6) + 0.0 inverted from grid_e a, (select * from grid_e where river) b group by a.r, a.c")
def vector_fade(spark, d):
    at = D.distance(V.grid_e(spark, d), F.col("river"))
    return at.select("r", "c", rounded(A.distance_weight(F.col("d"), 3.0)).alias("w"), rounded(A.distance_weight(F.col("d"), 3.0, True)).alias("inverted"))


# ---- borders and boxes

_BORDER = """, s as (select r, c, v > 100 m from grid_e), n as (select a.r, a.c, bool_or(coalesce(b.m, false)) or a.m hit, (count(b.m) = 4 and bool_and(b.m)) and a.m every
  from s a left join s b on abs(a.r - b.r) + abs(a.c - b.c) = 1 and b.r between a.r - 1 and a.r + 1 group by a.r, a.c, a.m), border as (select r, c from n where hit and not every)"""


@query(with_(E) + _BORDER + ", scales as (select unnest([16, 8, 4, 2]) scale) select scale, count(distinct (r // scale) * 1000000 + c // scale) n from border, scales group by scale")
def box_counts(spark, d):
    return zonal.box_counts(focal.edges(V.grid_e(spark, d).withColumn("k", F.col("v") > 100), "k"), [16, 8, 4, 2])


@query(
    with_(E)
    + _BORDER
    + """, scales as (select unnest([16, 8, 4, 2]) scale), kept as (select r, c from border, (select max(r) h, max(c) w from grid_e) where r > 0 and r < h and c > 0 and c < w and not (c >= 10 and c < 40 and r >= 10 and r < 30)),
counts as (select scale, count(distinct (r // scale) * 1000000 + c // scale) n from kept, scales group by scale) select round(-regr_slope(ln(n), ln(scale)), 6) + 0.0 dimension from counts"""
)
def fractal_dimension(spark, d):
    at = V.grid_e(spark, d).withColumn("k", F.col("v") > 100)
    return zonal.fractal_dimension(at, "k", [(10, 10, 40, 30)], 2, 16).select(rounded("dimension").alias("dimension"))


@query("select greatest(1.1::double, least(1.45::double, dimension)) dimension from (" + SQL["fractal_dimension"] + ")")
def coast_dimension(spark, d):
    """The measured dimension, held within what coasts have."""
    at = V.grid_e(spark, d).withColumn("k", F.col("v") > 100)
    measured = zonal.fractal_dimension(at, "k", [(10, 10, 40, 30)], 2, 16)
    return measured.select(A.coast_dimension(F.col("dimension")).alias("dimension")).select(rounded("dimension").alias("dimension"))


# ---- resolution


@query(
    with_(E)
    + """, low as (select r // 2 r, c // 2 c, v from grid_e where r % 2 = 0 and c % 2 = 0), size as (select max(r) + 1 h, max(c) + 1 w from grid_e), lsize as (select max(r) + 1 lh, max(c) + 1 lw from low),
p as (select r, c, r * (lh - 1.0::double) / (h - 1.0::double) y, c * (lw - 1.0::double) / (w - 1.0::double) x, lh, lw from grid_e, size, lsize), q as (select *, cast(floor(y) as int) y0, cast(floor(x) as int) x0 from p)
select q.r, q.c, round(sum(b.v * (1 - abs(y - (y0 + i))) * (1 - abs(x - (x0 + j)))), 6) + 0.0 v from q, range(0, 2) s(i), range(0, 2) t(j), low b where b.r = least(y0 + i, lh - 1) and b.c = least(x0 + j, lw - 1) and 1 - abs(y - (y0 + i)) > 0 and 1 - abs(x - (x0 + j)) > 0 group by q.r, q.c"""
)
def down_up_sample(spark, d):
    from .operators.blocks import extent

    cells = V.grid_e(spark, d)
    (h, w), low = extent(cells), resample.strided(cells)
    lh, lw = (h + 1) // 2, (w + 1) // 2
    return resample.bilinear(low, "v", lh, lw, h, w).select("r", "c", rounded("v").alias("v"))


@query(with_(E) + ", size as (select max(r) + 1 h, max(c) + 1 w from grid_e) select cast(a.r as int) r, cast(a.c as int) c, b.v from (select unnest(range(0, 33)) r) x(r), (select unnest(range(0, 150)) c) y(c), size, grid_e b, (select 1) z, lateral (select x.r r, y.c c) a where b.r = least(floor((a.r + 0.5::double) * h / 33), h - 1) and b.c = least(floor((a.c + 0.5::double) * w / 150), w - 1)")
def nearest_resample(spark, d):
    from .operators.blocks import extent

    cells = V.grid_e(spark, d)
    return resample.nearest(cells, "v", *extent(cells), 33, 150)


@query(
    with_(O)
    + """, box as (select greatest(0, min(c) - 5) w, greatest(0, min(r) - 5) n, max(c) + 5 e, max(r) + 5 s from grid_o where z = 5 and elev > 4800)
select r, c, round(case when c >= w and c < e and r >= n and r < s then elev * 2 else elev end, 6) + 0.0 elev from grid_o, box"""
)
def crop_paste(spark, d):
    cells = V.grid_o(spark, d)
    box = zonal.window_of(cells, (F.col("z") == 5) & (F.col("elev") > 4800), 5)
    part = zonal.cropped(cells, box).withColumn("elev", F.col("elev") * 2) if box else cells.limit(0)
    return zonal.pasted(cells, part, "elev").select("r", "c", rounded("elev").alias("elev"))


@query(
    with_(E)
    + """, o as (select r, c, cast(trunc(v % 7) - 3 as int) dr, cast(trunc(v % 5) - 2 as int) dc from grid_e), size as (select max(r) h, max(c) w from grid_e)
select o.r, o.c, b.v from o, size join grid_e b on b.r = greatest(0, least(h, o.r + dr)) and b.c = greatest(0, least(w, o.c + dc))"""
)
def dithered_lookup(spark, d):
    from .operators.blocks import extent

    cells = V.grid_e(spark, d)
    cut_ = lambda k, m: F.expr(f"cast(v % {k} as int) - {m}")
    return resample.dithered(cells, "v", cut_(7, 3), cut_(5, 2), *extent(cells)).select("r", "c", F.col("dithered").alias("v"))


# ---- noise


def _h(x: str, y: str, seed: int) -> str:
    x, y = f"(cast({x} as bigint) + {N.SHIFT})", f"(cast({y} as bigint) + {N.SHIFT})"
    a = f"(({x} * 73856093 + {y} * 19349663 + {seed * 83492791 + 12345}) % {N.M})"
    b = f"(({a} * {a} + {y} * 40503 + 977) % {N.M})"
    return f"(({b} * {b} + {x} * 30011 + 613) % {N.M})"


def _u(x: str, y: str, seed: int) -> str:
    return f"({_h(x, y, seed)} / {N.M}.0::double)"


def _grad(h: str, x: str, y: str) -> str:
    return f"(case {h} % 8 when 0 then {x} + {y} when 1 then -({x}) + {y} when 2 then {x} - ({y}) when 3 then -({x}) - ({y}) when 4 then ({x}) * sqrt(2) when 5 then -({x}) * sqrt(2) when 6 then ({y}) * sqrt(2) else -({y}) * sqrt(2) end)"


def _lattice(x: str, y: str, corner: Callable[[str, str, str, str], str]) -> str:
    """Smooth interpolation of corners by DuckDB expressions of x and y."""
    ix, iy = f"floor({x})", f"floor({y})"
    fx, fy = f"({x} - {ix})", f"({y} - {iy})"
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
    k = {(i, j): corner(f"({ix} + {i})", f"({iy} + {j})", f"({fx} - {i})", f"({fy} - {j})") for i in (0, 1) for j in (0, 1)}
    top, low = (f"({k[0, j]} + ({k[1, j]} - {k[0, j]}) * {fade(fx)})" for j in (0, 1))
    return f"({top} + ({low} - {top}) * {fade(fy)})"


def _perlin(x: str, y: str, seed: int) -> str:
    return _lattice(x, y, lambda ix, iy, fx, fy: _grad(_h(ix, iy, seed), fx, fy))


def _value(x: str, y: str, seed: int) -> str:
    return _lattice(x, y, lambda ix, iy, fx, fy: f"({_u(ix, iy, seed)} * 2 - 1)")


def _simplex(x: str, y: str, seed: int) -> str:
    g, s = "((3 - sqrt(3)) / 6)", "(0.5 * (sqrt(3) - 1))"
    i, j = f"floor({x} + ({x} + {y}) * {s})", f"floor({y} + ({x} + {y}) * {s})"
    x0, y0 = f"({x} - ({i} - ({i} + {j}) * {g}))", f"({y} - ({j} - ({i} + {j}) * {g}))"
    di = f"(case when {x0} > {y0} then 1 else 0 end)"
    part = lambda ci, cj, fx, fy: f"pow(greatest(0, 0.5 - {fx} * {fx} - {fy} * {fy}), 4) * {_grad(_h(ci, cj, seed), fx, fy)}"
    return f"(70 * ({part(i, j, x0, y0)} + {part(f'({i} + {di})', f'({j} + 1 - {di})', f'({x0} - {di} + {g})', f'({y0} - 1 + {di} + {g})')} + {part(f'({i} + 1)', f'({j} + 1)', f'({x0} - 1 + 2 * {g})', f'({y0} - 1 + 2 * {g})')}))"


def _nine(x: str, y: str, seed: int) -> str:
    points = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            cx, cy = f"(floor({x}) + {i})", f"(floor({y}) + {j})"
            points.append(f"sqrt(pow({cx} + {_u(cx, cy, seed)} - {x}, 2) + pow({cy} + {_u(cx, cy, seed + 1)} - {y}, 2))")
    return f"list_sort([{', '.join(points)}])"


def _octaves(f: Callable[[str, str, int], str], x: str, y: str, seed: int, n: int, persistence: float, shape: str = "{}") -> str:
    terms = [shape.format(f(f"({x} * {2.0**k})", f"({y} * {2.0**k})", seed + k)) + f" * {persistence**k!r}::double" for k in range(n)]
    return f"(({' + '.join(terms)}) / {sum(persistence**k for k in range(n))!r}::double)"


_P = ", p as (select *, c * 0.11::double x, r * 0.07::double y from grid_o)"
_XY = ("c * 0.11D", "r * 0.07D")


def _noise(name: str, noise: N.Noise, sql: str, x: str = _XY[0], y: str = _XY[1]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return N.add(V.grid_o(spark, d), "n", noise, F.expr(x), F.expr(y)).select("r", "c", rounded("n").alias("v"))

    run.__name__ = name
    query(with_(O) + _P + f" select r, c, round({sql}, 6) + 0.0 v from p")(run)


_noise("white_noise", N.white, f"{_u('c', 'r', 42)} * 2 - 1", "c", "r")
_noise("value_noise", N.value, _value("x", "y", 42))
_noise("simplex_noise", N.simplex, _simplex("x", "y", 42))
_noise("perlin_fbm", N.fractal(N.perlin, 3), _octaves(_perlin, "x", "y", 42, 3, 0.5))
_noise("worley_f1", N.cellular, _nine("x", "y", 42) + "[1]")
_noise("worley_f2_f1", N.ridge_distance, f"{_nine('x', 'y', 42)}[2] - {_nine('x', 'y', 42)}[1]")
_noise("billow", N.fractal(N.perlin, 3, kind="Billow"), _octaves(_perlin, "x", "y", 42, 3, 0.5, "(abs({}) * 2 - 1)"))
_noise("ridged", N.fractal(N.perlin, 4, kind="RidgedMulti"), _octaves(_perlin, "x", "y", 42, 4, 0.5, "(1 - abs({}) * 2)"))


@query(with_(O) + _P + f", n as (select r, c, abs({_perlin('x', 'y', 7)}) v from p) select r, c, round(v - min(v) over (), 6) + 0.0 v from n")
def noise_raised(spark, d):
    at = N.add(V.grid_o(spark, d), "n", N.perlin, F.expr(_XY[0]), F.expr(_XY[1]), 7).withColumn("n", F.abs("n"))
    return zonal.normalised(at, "n", "min").select("r", "c", rounded("v").alias("v"))


# ---- recipes


@query(
    with_(O)
    + f""", one as (select *, elev + {_octaves(_simplex, "(c * 0.05::double)", "(r * 0.05::double)", 5, 2, 0.5)} * 100 * greatest(0, least(1, (elev - 500) / 200.0::double)) e1 from grid_o)
select r, c, round(e1 + ({_nine("(c * 0.1::double)", "(r * 0.1::double)", 9)}[2] - {_nine("(c * 0.1::double)", "(r * 0.1::double)", 9)}[1]) * 30 * greatest(0, least(1, (e1 - 1000) / 500.0::double)), 6) + 0.0 elev from one"""
)
def fractal_blend(spark, d):
    recipe = P.Recipe(
        [
            P.FractalLayer("hills", 5, 20.0, 100.0, "FBM", 2, mask=P.AltitudeMask(500, 200)),
            P.TectonicLayer("ridges", 9, 0.1, 30.0, "Distance2Sub", P.AltitudeMask(1000, 500)),
        ]
    )
    return recipe.build(V.grid_o(spark, d)).select("r", "c", rounded("elev").alias("elev"))


@query(with_(O) + f"""select r, c, round(elev + (1 - {_nine("(c * 0.1::double)", "(r * 0.1::double)", 9)}[1]) * 30 * greatest(0, least(1, (elev - 1000) / 500.0::double)), 6) + 0.0 elev from grid_o""")
def distance_ridges(spark, d):
    """Hills around the random points: the nearest distance, inverted."""
    recipe = P.Recipe([P.TectonicLayer("hills", 9, 0.1, 30.0, "Distance", P.AltitudeMask(1000, 500))])
    return recipe.build(V.grid_o(spark, d)).select("r", "c", rounded("elev").alias("elev"))


@query(
    with_(B)
    + f""", i as (select *, least(1, v / 500) f from cells)
select r, c, round(case when z = 3 then elev + (({_octaves(_simplex, "(c * 0.04::double)", "(r * 0.04::double)", 3, 3, 0.5)} + 1) / 2) * (1 - f) * (1 - f) * 250 else elev end, 6) + 0.0 elev from i"""
)
def tectonic_pass(spark, d):
    at = V.both(spark, d).withColumn("influence", F.least(F.lit(1.0), F.col("v") / 500))
    return P.tectonic_pass(at, "FBM", 0.04, 250.0, zone=3, seed=3, positive=True, attenuate=True).select("r", "c", rounded("elev").alias("elev"))


def _rough_sql(magnitude: float, persistence: float, scale: float, seed: int) -> str:
    f = f"{1.0 / scale!r}::double"
    return f", o as (select a.r, a.c, sqrt({_FAR}) d from s a, (select * from s where k) b group by a.r, a.c), i as (select a.r, a.c, sqrt({_FAR}) d from s a, (select * from s where not k) b group by a.r, a.c) select r, c, o.d - i.d + {_octaves(_perlin, f'(c * {f})', f'(r * {f})', seed, 3, persistence)} * {magnitude!r}::double < 0 rough from o join i using (r, c)"


@query(with_(E) + ", s as (select r, c, v > 100 k from grid_e)" + _rough_sql(4.0, 0.5, 8.0, 42))
def roughen_mask(spark, d):
    return P.roughened(V.grid_e(spark, d).select("r", "c", (F.col("v") > 100).alias("k")), "k", 42, 8.0, 4.0).select("r", "c", "rough")


@query(with_(E) + ", s as (select r, c, v > 100 k from grid_e)" + _rough_sql(6.0, A.persistence_of(1.3), 8.0, 42))
def fractal_mask(spark, d):
    return P.fractal_mask(V.grid_e(spark, d).withColumn("k", F.col("v") > 100), "k", 1.3, 8.0).select("r", "c", "rough")


def _blur_sql(source: str, value: str, sigma: float, out: str) -> str:
    """CTEs that leave in out (r, c, v) a source's value blurred, mirrored at the edges."""
    kernel = focal.gaussian_kernel(sigma)
    k = len(kernel) // 2
    weights = ", ".join(f"{x:.17g}::double" for x in kernel)
    mirror = lambda i, n: f"case when {i} < 0 then -1 - ({i}) when {i} >= {n} then 2 * {n} - 1 - ({i}) else {i} end"
    return f"""{out}_k as (select unnest(range(-{k}, {k + 1})) i, unnest([{weights}]) w), {out}_n as (select max(r) + 1 h, max(c) + 1 n from {source}),
{out}_r as (select a.r, a.c, sum(w * b.{value}) v from {source} a cross join {out}_k cross join {out}_n join {source} b on b.c = a.c and b.r = {mirror("a.r + i", "h")} group by all),
{out} as (select a.r, a.c, sum(w * b.v) v from {out}_r a cross join {out}_k cross join {out}_n join {out}_r b on b.r = a.r and b.c = {mirror("a.c + i", "n")} group by all)"""


@query(with_(E, "f as (select r, c, case when v > 100 then 1.0::double else 0.0::double end x from grid_e)", _blur_sql("f", "x", 1.0, "b")) + ", s as (select r, c, v > 0.5 k from b)" + _rough_sql(4.0, 0.5, 8.0, 42))
def smooth_mask(spark, d):
    """A mask blurred before its border is made rough."""
    return P.roughened(V.grid_e(spark, d).select("r", "c", (F.col("v") > 100).alias("k")), "k", 42, 8.0, 4.0, pre_smooth=1.0).select("r", "c", "rough")


def _component_sql(mask: str, corners: bool, table: str = "grid_o") -> str:
    touch = "abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1" if corners else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    return f"s as (select cast(r as bigint) * 4294967296 + c id, r, c from {table} where {mask}), e as (select a.id x, b.id y from s a join s b on b.r between a.r - 1 and a.r + 1 and {touch} and a.id <> b.id), reach(x, y) as (select id, id from s union select reach.x, e.y from reach join e on reach.y = e.x), label as (select x id, min(y) label from reach group by x)"


@query(
    f"""with recursive {B}, near as (select a.r, a.c, min(((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 1000000000::bigint + b.c * 1000000::bigint + b.r) k from cells a, (select * from cells where river) b group by a.r, a.c),
t as (select r, c, sqrt(k // 1000000000) d, k // 1000000 % 1000 sc, k % 1000000 sr, greatest(0, least(1, 1 - sqrt(k // 1000000000) / 6.0::double)) t from near),
w as (select r, c, c + case when d > 0 then (sc - c) / d * (t * t * (3 - 2 * t)) * 2 else 0 end wx, r + case when d > 0 then (sr - r) / d * (t * t * (3 - 2 * t)) * 2 else 0 end wy from t),
p as (select r, c, wx, wy, {_simplex("(wx * 0.06::double)", "(wy * 0.06::double)", 1003)} * 1.5::double shift from w), q as (select r, c, (wx + shift) * 0.03::double x, (wy + shift) * 0.03::double y from p),
n as materialized (select r, c, m, elev + {_octaves(_simplex, "x", "y", 4, 3, 0.5, "(abs({}) * 2 - 1)")} * 50 elev from q join cells using (r, c)), {_component_sql("m = 0", False, "n")},
l as (select r, c, label from s join label using (id)), ring as (select label, min(g.elev) low from l join n g on g.r between l.r - 1 and l.r + 1 and g.c between l.c - 1 and l.c + 1 where g.m <> 0 group by label),
o as (select n.r, n.c, coalesce(low, n.elev) elev from n left join l using (r, c) left join ring using (label)),
far as (select a.r, a.c, any_value(a.elev) elev, sqrt({_FAR}) d from o a, (select * from o where {_SEA}) b group by a.r, a.c), g as (select r, c, elev, least(1, d / case when elev > 100 then 2.0::double else 10.0::double end) t from far)
select r, c, round(elev * (t * t * (3 - 2 * t)), 6) + 0.0 elev from g"""
)
def recipe_layers(spark, d):
    """Every kind of layer once: warp, rough noise, lakes, coast."""
    cells = V.both(spark, d).select("r", "c", "elev", "river", (F.col("m") == 0).alias("lake"), F.expr(_SEA).alias("sea"), F.lit(1.0).alias("width"))
    recipe = P.Recipe([P.RiverWarpLayer("bend", strength=2.0, reach=6.0), P.RoughLayer("rough", 4, 0.03, 50.0, "Billow", 1.5), P.LakeLayer("lakes"), P.CoastLayer("coast")])
    return recipe.build(cells).select("r", "c", rounded("elev").alias("elev"))


@query(
    with_(O, f"n as (select r, c, m, ({_u('c', 'r', 42)} * 2 - 1) * 10 x from grid_o)", _blur_sql("n", "x", 3.0, "b"))
    + "select r, c, round(-50 + case when m > 0 then b.v * 10 / max(abs(b.v)) over () else 0 end, 6) + 0.0 elev from n join b using (r, c)"
)
def seabed(spark, d):
    cells = V.grid_o(spark, d).withColumn("active_mask", F.col("m"))
    return P.seabed(cells, sigma=3.0).select("r", "c", rounded("elev").alias("elev"))


@query(
    with_(O, "step as (" + _STEPS.format(k=2) + ")")
    + """, near as (select a.r, a.c, a.z, bool_and(coalesce(b.z > 1, false)) kept from grid_o a cross join step left join grid_o b on b.r = a.r + i and b.c = a.c + j group by all),
strip as (select r, c, case when z > 1 and kept then 1 when z > 1 then 2 else 0 end k from near),
wide as (select a.r, a.c, a.k, bool_or(coalesce(b.k > 0, false)) m from strip a cross join step left join strip b on b.r = a.r + i and b.c = a.c + j group by all),
back as (select a.r, a.c, a.k, bool_and(coalesce(b.m, false)) h from wide a cross join step left join wide b on b.r = a.r + i and b.c = a.c + j group by all)
select case when h and k = 0 then 1 else k end active_mask, count(*) n from back group by 1"""
)
def active_mask(spark, d):
    return P.activated(V.grid_o(spark, d).withColumn("within", F.col("z") > 1), "within", 2).groupBy("active_mask").agg(F.count("*").alias("n"))


@query(
    with_(O)
    + f""", p as (select r, c, m, z, {_simplex("(c * 0.1::double)", "(r * 0.1::double)", 1010)} * 2 shift from grid_o), q as (select r, c, (c + shift + m * 0.5::double) * 0.05::double x, (r + shift + z * 0.5::double) * 0.05::double y from p)
select r, c, round({_octaves(_simplex, "x", "y", 11, 4, 0.5, "(1 - abs({}) * 2)")}, 6) + 0.0 v from q"""
)
def perturbed_noise(spark, d):
    """Ridges at coordinates that a finer noise and two fields displace."""
    stage = N.Stage(V.grid_o(spark, d))
    noise = N.generated(stage, "RidgedMulti", F.col("c").cast("double"), F.col("r").cast("double"), 0.05, 11, 2.0, F.col("m"), F.col("z"), 0.5)
    return stage.end(n=noise).select("r", "c", rounded("n").alias("v"))


_HILLS = _octaves(_simplex, "(c * 0.05::double)", "(r * 0.05::double)", 5, 2, 0.5)


@query(
    with_(B)
    + f""", far as (select a.r, a.c, any_value(a.elev) elev, greatest(0, 1 - sqrt({_FAR}) / 4.0::double) w from cells a, (select * from cells where river) b group by a.r, a.c)
select r, c, round(elev + {_HILLS} * 100 * w + {_HILLS} * 10 * (1 - w), 6) + 0.0 elev from far"""
)
def feature_mask(spark, d):
    """Noise near features, and a weaker one away from them; a mask of an absent column weighs nothing in."""
    near, away = P.FeatureMask("river", 4.0), P.FeatureMask("river", 4.0, True)
    recipe = P.Recipe([P.FractalLayer("near", 5, 20.0, 100.0, "FBM", 2, mask=near), P.FractalLayer("away", 5, 20.0, 10.0, "FBM", 2, mask=away), P.FractalLayer("none", 5, 20.0, 10.0, "FBM", 2, mask=P.FeatureMask("absent"))])
    return recipe.build(V.both(spark, d)).select("r", "c", rounded("elev").alias("elev"))


# ---- features to cells


@query(with_(O, X) + "select distinct g.r, g.c from grid_o g join rect on g.r between r0 and r1 and g.c between c0 and c1")
def rasterize_rects(spark, d):
    return raster.mask(V.grid_o(spark, d), V.rings(spark, d)).where("mask").select("r", "c")


@query(with_(O, X) + "select g.r, g.c, max_by(v, id) as value from grid_o g join rect on g.r between r0 and r1 and g.c between c0 and c1 group by all")
def burn_zone(spark, d):
    return raster.burn(V.grid_o(spark, d), V.rings(spark, d), "v", "id")


@query(
    with_(O, X)
    + """, l as (select id, c0 + 0.5::double x0, r0 + 0.5::double y0, c1 + 0.5::double x1, r1 + 0.5::double y1, (v % 4 + 1) / 2.0::double rad from rect),
n as (select r, c, rad, x0, y0, x1, y1, c + 0.5::double x, r + 0.5::double y, case when x0 = x1 and y0 = y1 then 0 else greatest(0, least(1, ((c + 0.5::double - x0) * (x1 - x0) + (r + 0.5::double - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) end t from grid_o, l)
select distinct r, c from n where sqrt(pow(x0 + t * (x1 - x0) - x, 2) + pow(y0 + t * (y1 - y0) - y, 2)) <= rad"""
)
def buffered_lines(spark, d):
    return raster.buffered(V.grid_o(spark, d), V.diagonals(spark, d), (F.col("v") % 4 + 1) / 2.0).where("mask").select("r", "c")


#: Cells of the diagonals in whole numbers of half cells.
_LINE_CELLS = """l as (select id, 2 * c0 + 1 x0, 2 * r0 + 1 y0, 2 * (c1 - c0) dx, 2 * (r1 - r0) dy from rect), met as (select *, unnest(range(y0 // 2, (y0 + dy) // 2 + 1)) r from l),
part as (select id, r, case when dy = 0 then x0 // 2 else (x0 * dy + (greatest(2 * r, y0) - y0) * dx) // (2 * dy) end lo, case when dy = 0 then (x0 + dx) // 2 else (x0 * dy + (least(2 * r + 2, y0 + dy) - y0) * dx) // (2 * dy) end hi from met),
passed as (select id, cast(r as int) r, cast(unnest(range(lo, hi + 1)) as int) c from part)"""


@query(with_(X, _LINE_CELLS) + "select id, r, c from passed")
def line_burn(spark, d):
    return raster.line_cells(V.diagonals(spark, d), ["id"])


@query(with_(X, _LINE_CELLS) + "select r, c, max_by(case id // 20 % 4 when 0 then 255 when 1 then 180 when 2 then 100 else 50 end, id) as value from passed group by r, c")
def spine_raster(spark, d):
    return raster.spine_raster(V.diagonals(spark, d).withColumns({"generation": F.expr("cast(id div 20 % 4 as int)"), "seq": F.col("id")}))


@query(with_(X) + "select distinct a.id from rect a join rect b on a.id <> b.id and a.c0 + 0.5 >= b.c0 and a.c0 + 0.5 <= b.c1 + 1 and a.r0 + 0.5 >= b.r0 and a.r0 + 0.5 <= b.r1 + 1 and b.id % 40 = 0 and a.id % 40 = 20")
def points_in_water(spark, d):
    points = V.rect(spark, d).where("id % 40 = 20").select("id", (F.col("c0") + 0.5).alias("x"), (F.col("r0") + 0.5).alias("y"))
    return rivers.in_water(points, V.rings(spark, d).where("id % 40 = 0")).select("id")


@query(with_(O, X) + "select r, c, exists (select 1 from rect where g.r between r0 and r1 and g.c between c0 and c1) mask from grid_o g where r >= 5 and r < 12")
def strip_mask(spark, d):
    return raster.strip(V.grid_o(spark, d), V.rings(spark, d), 5, 7).select("r", "c", "mask")


@query(with_(X) + "select distinct a.id from rect a join rect b on a.c0 + 0.5 >= b.c0 and a.c0 + 0.5 <= b.c1 + 1 and a.r0 + 0.5 >= b.r0 and a.r0 + 0.5 <= b.r1 + 1 and (b.id % 60 = 0 or b.id % 100 = 0) where a.id % 40 = 20")
def sea_and_lakes(spark, d):
    """Points in the sea's or the lakes' polygons, taken as one water."""
    points = V.rect(spark, d).where("id % 40 = 20").select("id", (F.col("c0") + 0.5).alias("x"), (F.col("r0") + 0.5).alias("y"))
    water = rivers.all_water(V.rings(spark, d).where("id % 60 = 0"), V.rings(spark, d).where("id % 100 = 0"))
    return rivers.in_water(points, water).select("id")


# ---- rivers

_PLACED = "placed as (select u edge_id, u, v, len, u * 7 % 100 x0, u * 13 % 150 y0, v * 7 % 100 x1, v * 13 % 150 y1 from river)"


def placed(spark, d):
    place = {f"{k}{i}": F.expr(f"{n} * {m}") for i, n in ((0, "u"), (1, "v")) for k, m in (("x", "7 % 100"), ("y", "13 % 150"))}
    return V.river(spark, d).withColumn("edge_id", F.col("u")).withColumns(place)


@query(with_(R, X, _PLACED) + "select edge_id from placed p where not exists (select 1 from rect where least(x0, x1) >= c0 and greatest(x0, x1) <= c1 + 9 and least(y0, y1) >= r0 and greatest(y0, y1) <= r1 + 9)")
def rivers_outside_water(spark, d):
    wide = V.rect(spark, d).withColumns({"c1": F.col("c1") + 9, "r1": F.col("r1") + 9})
    return rivers.outside_water(placed(spark, d), wide).select("edge_id")


@query(with_(R, X, _PLACED) + "select edge_id from placed p where exists (select 1 from rect where (x0 between c0 and c1 and y0 between r0 and r1) or (x1 between c0 and c1 and y1 between r0 and r1))")
def water_legs(spark, d):
    return rivers.touching_water(placed(spark, d), V.rect(spark, d)).select("edge_id")


def mixed(spark, d):
    """The tree's edges, every other one written against the flow."""
    return V.river(spark, d).select(F.col("u").alias("edge_id"), F.when(F.col("u") % 2 == 0, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("u") % 2 == 0, F.col("v")).otherwise(F.col("u")).alias("v"), "len")


@query(with_(R) + "select u edge_id, u source, v target, u % 2 <> 0 flipped from river")
def orient_edges(spark, d):
    edges = mixed(spark, d)
    found = rivers.oriented(edges, None, spark.createDataFrame([(0,)], "node long"))
    xy = edges.select("edge_id", F.col("u").alias("x0"), F.col("u").alias("y0"), F.col("v").alias("x1"), F.col("v").alias("y1"))
    turned = rivers.reoriented(xy, found.withColumns({"sx": F.col("source"), "sy": F.col("source")}))
    return turned.select("edge_id", "source", "target", "flipped")


_WALK = "walk(node, level) as (select cast(0 as bigint), 0 union all select u, level + 1 from river join walk on v = node)"


@query("with recursive " + R + ", " + _WALK + " select node, level from walk")
def upstream_walk(spark, d):
    return rivers.upstream(mixed(spark, d), spark.createDataFrame([(0,)], "node long")).select("node", "level")


@query("with recursive " + R + ", walk(node, level) as (select cast(0 as bigint), 0 union all select u, level + 1 from river join walk on v = node where level = 0 or node % 7 <> 3) select node, level from walk")
def walk_to_lakes(spark, d):
    """Up from the sea; lakes are reached and not passed."""
    lakes = V.river(spark, d).where("u % 7 = 3").select(F.col("u").alias("node"))
    return rivers.upstream(mixed(spark, d), spark.createDataFrame([(0,)], "node long"), lakes).select("node", "level")


@query(with_(R) + "select u edge_id, u source, v target from river")
def orient_through_lakes(spark, d):
    """Up from the sea to the lakes, and on from the lakes that were reached."""
    lakes = V.river(spark, d).where("u % 7 = 3").select(F.col("u").alias("node"))
    return rivers.oriented(mixed(spark, d), None, spark.createDataFrame([(0,)], "node long"), lakes)


def flowing(spark, d):
    return V.river(spark, d).select(F.col("u").alias("edge_id"), F.col("u").alias("source"), F.col("v").alias("target"), "len")


_FLOW = "down(node, below) as (select node, node from (select u node from river union select v from river) union all select node, v from down join river on u = below), flow as (select below node, cast(count(*) as bigint) flow from down group by below)"


@query("with recursive " + R + ", " + _FLOW + " select node, flow from flow")
def flow_accumulation(spark, d):
    return rivers.flow(flowing(spark, d)).select("node", "flow")


def _strahler_sql(levels: int = 14) -> str:
    parts = [R, "s0 as (select node, 1 s from (select u node from river union select v from river))"]
    for k in range(levels):
        parts.append(
            f"""s{k + 1} as (select a.node, coalesce(t.s, 1) s from s{k} a left join (select v node, max(s) + case when count(*) filter (s = m) > 1 then 1 else 0 end s
  from (select v, s, max(s) over (partition by v) m from river join s{k} on u = node) group by v) t using (node))"""
        )
    return with_(*parts) + f"select node, cast(s as int) strahler from s{levels}"


@query(_strahler_sql())
def strahler(spark, d):
    return rivers.flow(flowing(spark, d)).select("node", "strahler")


@query("with recursive " + R + ", " + _FLOW + " select u edge_id, flow magnitude, round(least(20 + ln(flow) * 100, 1000), 6) + 0.0 width from river join flow on u = node")
def river_widths(spark, d):
    edges = flowing(spark, d)
    wide = rivers.widths(rivers.edge_flow(edges, rivers.flow(edges)), 20.0, 1000.0, 100.0)
    return wide.select("edge_id", "magnitude", rounded("width").alias("width"))


@query("with recursive " + R + ", " + _FLOW + " select count(*) n, round(min(least(20 + ln(flow) * 100, 1000)), 6) + 0.0 narrowest, round(max(least(20 + ln(flow) * 100, 1000)), 6) + 0.0 widest from river join flow on u = node")
def width_range(spark, d):
    edges = flowing(spark, d)
    wide = rivers.widths(rivers.edge_flow(edges, rivers.flow(edges)), 20.0, 1000.0, 100.0)
    return rivers.width_range(wide).select("n", rounded("narrowest").alias("narrowest"), rounded("widest").alias("widest"))


@query(with_(R, _PLACED) + "select cast(u as varchar) u, cast(v as varchar) v, count(*) n from placed group by all")
def network_sink(spark, d):
    path = f"{store.shared_folder(spark)}/network-{uuid.uuid4().hex}"
    scans.write_network(placed(spark, d), path)
    return spark.read.parquet(path).groupBy("u", "v").agg(F.count("*").alias("n"))


@query(with_(R, _PLACED) + ", apart as (select p.edge_id a, q.edge_id b, sqrt(pow(q.x0 - (p.x1 + p.edge_id % 3), 2)) gap from placed p join placed q on p.v = q.u) select count(*) n, round(sum(gap), 6) + 0.0 total, (select count(*) from placed where u % 5 > 1) misplaced from apart where gap > 1")
def topology_check(spark, d):
    at = placed(spark, d).withColumns({"source": F.concat(F.lit("("), F.col("x0") + F.col("u") % 5, F.lit(", "), F.col("y0"), F.lit(")")), "target": F.col("v")})
    wrong = rivers.misplaced(at).agg(F.count("*").alias("misplaced"))
    shifted = at.withColumns({"x1": F.col("x1") + F.col("edge_id") % 3, "source": F.col("u")})
    gap = rivers.gaps(shifted).agg(F.count("*").alias("n"), rounded(F.sum("gap")).alias("total"))
    return gap.crossJoin(wrong)


def _prune_sql(passes: int) -> str:
    parts = [R, "p0 as (select * from river)"]
    for k in range(passes):
        parts.append(f"d{k} as (select n from (select u n from p{k} union all select v from p{k}) group by n having count(*) = 1)")
        parts.append(f"p{k + 1} as (select * from p{k} where not (len < 4000 and (u in (select n from d{k}) or v in (select n from d{k}))))")
    return with_(*parts) + f"select u, v from p{passes}"


@query(_prune_sql(12))
def prune_short(spark, d):
    return rivers.pruned(V.river(spark, d), 4000.0).select("u", "v")


@query(with_(R, _PLACED) + "select edge_id, round((x1 - x0) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) + 0.0 dx, round((y1 - y0) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) + 0.0 dy from placed where edge_id % 10 = 0 and (x0 <> x1 or y0 <> y1)")
def flow_arrows(spark, d):
    return rivers.directions(placed(spark, d)).select("edge_id", rounded("dx").alias("dx"), rounded("dy").alias("dy"))


@query(with_(R) + "select u source, v target from river union all select * from (values (0, 1000000000), (1000000000, 1000000001), (1000000001, 1000000002))")
def cycles_removed(spark, d):
    """The tree and a cycle of three below its root, of which the largest edge goes."""
    extra = spark.createDataFrame([(0, 10**9), (10**9, 10**9 + 1), (10**9 + 1, 10**9 + 2)], "source long, target long").unionByName(spark.createDataFrame([(10**9 + 2, 10**9)], "source long, target long"))
    return rivers.without_cycles(flowing(spark, d).select("source", "target").unionByName(extra))


@query(with_(X) + ", l as (select id, '(' || (c0 + 0.5::double) || ', ' || (r0 + 0.5::double) || ')' u, '(' || (c1 + 0.5::double) || ', ' || (r1 + 0.5::double) || ')' v from rect) select min(id) edge_id, least(u, v) a, greatest(u, v) b from l group by 2, 3")
def graph_of_lines(spark, d):
    _, edges = rivers.graph_of(V.diagonals(spark, d).select(F.col("id").alias("edge_id"), "geom"))
    return edges.select("edge_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


# ---- components


@query("with recursive " + O + ", " + _component_sql("m = 0", False) + " select r, c, label from s join label using (id)")
def components(spark, d):
    return C.components(V.grid_o(spark, d), F.col("m") == 0)


@query("with recursive " + O + ", " + _component_sql("z = 2", True) + " select r, c, label from s join label using (id)")
def components_corners(spark, d):
    return C.components(V.grid_o(spark, d), F.col("z") == 2, corners=True)


@query(
    "with recursive "
    + O
    + ", "
    + _component_sql("m = 0", False)
    + """, l as (select r, c, label from s join label using (id)), ring as (select label, min(g.elev) low from l join grid_o g on g.r between l.r - 1 and l.r + 1 and g.c between l.c - 1 and l.c + 1 where g.m <> 0 group by label)
select g.r, g.c, round(coalesce(low, elev), 6) + 0.0 level from grid_o g left join l using (r, c) left join ring using (label)"""
)
def lake_levels(spark, d):
    return C.level_lakes(V.grid_o(spark, d), "elev", F.col("m") == 0).select("r", "c", rounded("level").alias("level"))


_ZONE, _BED = "r between 3 and 40 and c between 10 and 60", "r between 5 and 6"


@query(with_(O) + f"select r, c, r > 6 south from grid_o where {_ZONE}")
def south_vote(spark, d):
    return C.south_bank(V.grid_o(spark, d), F.expr(_ZONE), F.expr(_BED))


@query(
    with_(O)
    + f""", crop as (select * from grid_o where r < 40 + 5 and c >= 5 and c < 65), b as (select *, {_ZONE} and r > 6 south, {_ZONE} and {_BED} bed from crop),
l as (select a.r, a.c, sqrt({_FAR}) d from b a, (select * from b where bed) b group by a.r, a.c), h as (select a.r, a.c, sqrt({_FAR}) d from b a, (select * from b where not south and not bed) b group by a.r, a.c)
select g.r, g.c, cast(trunc(elev * 2) + case when south then trunc(l.d / (l.d + h.d) * 40) else 0 end as int) units from grid_o g left join (select r, c, south from b) using (r, c) left join l using (r, c) left join h using (r, c)"""
)
def south_bank_ramp(spark, d):
    at = V.grid_o(spark, d).withColumn("units", A.to_units(F.col("elev")))
    return P.south_bank_ramp(at, F.expr(_ZONE), F.expr(f"{_ZONE} and {_BED}"), 20.0, pad=5).select("r", "c", "units")


# ---- lines and centre lines


@query()
def ridge_growth(spark, d):
    axes = scans.ingest_axes(V.diagonals(spark, d)).withColumn("id", F.abs(F.xxhash64("geom")))
    grown = lines.grown_ridges(axes, 3, 1.0, 4.0)
    points = grown.select("id", "generation", "base_amplitude", "width_limit", F.posexplode("geom").alias("at", "p"))
    return points.select("id", "generation", "at", rounded("p.x").alias("x"), rounded("p.y").alias("y"), rounded("base_amplitude").alias("amplitude"), rounded("width_limit").alias("width"))


_MIXED = f"({{h}} * 48271 + {{k}} * 69621 + 977) % {N.M}"


def _mix(h: str, k: str) -> str:
    g = f"({_MIXED.format(h=h, k=k)})"
    return f"(({g} * {g} + 613) % {N.M})"


_LENGTH = "sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))"


@query(
    "with recursive "
    + X
    + f""", one as (select id, {_mix("12345::bigint", "id")} h, c0 + 0.5::double px, r0 + 0.5::double py, c1 + 0.5::double qx, r1 + 0.5::double qy from rect), two as (select id, {_mix("h", "0")} h, {_LENGTH} total, px, py, qx, qy from one),
seg(id, h, total, place, depth, px, py, qx, qy, n) as (select id, h, total, 1::bigint, 0, px, py, qx, qy, total from two union all
  select id, h, total, place * 2 + side, depth + 1, case side when 0 then px else mx end, case side when 0 then py else my end, case side when 0 then mx else qx end, case side when 0 then my else qy end,
    sqrt(case side when 0 then (mx - px) * (mx - px) + (my - py) * (my - py) else (qx - mx) * (qx - mx) + (qy - my) * (qy - my) end)
  from (select *, (px + qx) / 2 - (qy - py) / n * move mx, (py + qy) / 2 + (qx - px) / n * move my from (select *, greatest(-0.8::double * n, least(0.8::double * n, (2 * ({_mix("h", "place")} / {N.M}.0::double) - 1) * 0.5::double * 2 * pow(n / total, 0.6::double))) move from seg where n >= 0.5)), (select unnest([0, 1]) side))
select id, 0 as "at", round(px, 6) + 0.0 x, round(py, 6) + 0.0 y from two union all
select id, cast(row_number() over (partition by id order by place / pow(2.0::double, depth)) as int) "at", round(qx, 6) + 0.0, round(qy, 6) + 0.0 from seg where n < 0.5"""
)
def midpoint_fractal(spark, d):
    fine = lines.midpoint(V.diagonals(spark, d).select("id", "geom"), 0.5, 0.5, 2.0)
    return fine.select("id", F.posexplode("geom").alias("at", "p")).select("id", "at", rounded("p.x").alias("x"), rounded("p.y").alias("y"))


@query(
    with_(X)
    + """, bent as (select id, c1 - c0 dx, r1 - r0 dy, v % 4 / 4.0::double h from rect)
select id, case when (case when dx = 0 and dy = 0 then sqrt(h * h) else abs(dx * h) / sqrt(dx * dx + dy * dy) end) > 0.3 then 3 else 2 end n from bent"""
)
def simplify_line(spark, d):
    """Lines with a middle point that is lifted by a part of a cell: kept where it is off the straight line by more than 0.3."""
    lifted = F.expr("array(geom[0], named_struct('x', (geom[0].x + geom[1].x) / 2, 'y', (geom[0].y + geom[1].y) / 2 + v % 4 / 4.0D), geom[1])")
    return lines.simplify(V.diagonals(spark, d).select("id", lifted.alias("geom")), 0.3).select("id", F.size("geom").alias("n"))


@query(with_(X) + ", l as (select id, c0 + 0.5::double x0, r0 + 0.5::double y0, c1 - c0 dx, r1 - r0 dy, v % 5 * 0.7::double so from rect), n as (select *, sqrt(dx * dx + dy * dy) len from l) select id, round(case when len = 0 then x0 else x0 + dx * least(so, len) / len end, 6) + 0.0 x, round(case when len = 0 then y0 else y0 + dy * least(so, len) / len end, 6) + 0.0 y from n")
def points_along(spark, d):
    """A point so far along each line, on lines with a middle point."""
    bent = F.expr("array(geom[0], named_struct('x', (geom[0].x + geom[1].x) / 2, 'y', (geom[0].y + geom[1].y) / 2), geom[1])")
    at = lines.points_along(V.diagonals(spark, d).withColumn("geom", bent), F.expr("v % 5 * 0.7D"))
    return at.select("id", rounded("p.x").alias("x"), rounded("p.y").alias("y"))


def _thick(spark, d):
    return V.grid_o(spark, d).withColumn("wet", F.expr("r between 2 and 6 or c between 40 and 44"))


@query()
def skeleton(spark, d):
    return lines.skeleton(_thick(spark, d), F.col("wet"), size=64)


@query()
def centre_lines(spark, d):
    return lines.centre_lines(_thick(spark, d), F.col("wet"), 1.0, 3.0, 8).select("u", "v", rounded("len").alias("len"))


# ---- worlds, checkpoints, streams


@query(with_(O) + "select r, c, round(cast(cast(elev as float) as double), 4) + 0.0 elevation, cast(10 as smallint) lithology_id, cast(m as smallint) active_mask, cast(0 as smallint) water_flux, cast(7 as smallint) extra from grid_o")
def checkpoint_roundtrip(spark, d):
    cells = V.grid_o(spark, d)
    h, w = (cells.agg(F.max("r"), F.max("c")).first())
    world = scans.World.blank(spark, scans.Grid(h + 1, w + 1)).with_layer("extra", fill=7)
    filled = world.cells.drop("elevation", "active_mask").join(cells.select("r", "c", F.col("elev").cast("float").alias("elevation"), F.col("m").cast("smallint").alias("active_mask")), ["r", "c"])
    path = f"{store.shared_folder(spark)}/world-{uuid.uuid4().hex}"
    store.save_world(filled, {"h": h + 1, "w": w + 1}, path)
    back, _ = store.load_world(spark, path)
    return back.select("r", "c", (F.round(F.col("elevation").cast("double"), 4) + F.lit(0.0)).alias("elevation"), "lithology_id", "active_mask", "water_flux", "extra")


@query(with_(O) + "select r, c, case when m = 0 then 255 else 0 end shown from grid_o")
def mask_export(spark, d):
    path = f"{store.shared_folder(spark)}/mask-{uuid.uuid4().hex}"
    scans.write_mask(V.grid_o(spark, d).withColumn("k", F.col("m") == 0), "k", path, 255)
    return spark.read.parquet(path).select("r", "c", F.col("k").cast("int").alias("shown"))


@query(with_(O) + "select r, c, round(case when m = 2 then 7 else round_even(elev, 0) end, 6)::double elev from grid_o")
def units_sink(spark, d):
    """Rounded whole numbers with a sentinel, written and read as a layer whose gaps are filled."""
    path = f"{store.shared_folder(spark)}/units-{uuid.uuid4().hex}"
    cells = V.grid_o(spark, d)
    scans.write_units(cells, "elev", path, "m <> 2")
    return scans.read_layer(cells.select("r", "c"), spark.read.parquet(path), "elev", "elev", -32768, 7.0).select("r", "c", F.col("elev").cast("double").alias("elev"))


@query(with_(O) + "select r, c, round(case when m = 2 then -1 else cast(cast(elev as float) as double) end, 4) + 0.0 elev from grid_o")
def floats_sink(spark, d):
    path = f"{store.shared_folder(spark)}/floats-{uuid.uuid4().hex}"
    cells = V.grid_o(spark, d)
    scans.write_floats(cells.withColumn("elev", F.when(F.col("m") != 2, F.col("elev"))), "elev", path)
    back = scans.read_layer(cells.select("r", "c"), spark.read.parquet(path), "elev", "elev", -9999.0, -1.0)
    return back.select("r", "c", (F.round(F.col("elev").cast("double"), 4) + F.lit(0.0)).alias("elev"))


@query(with_(X) + "select c0 + 0.5::double x, r0 + 0.5::double y, case when v % 3 = 0 then 1 else v end epoch, 1000.0::double base_amplitude, case when v % 2 = 0 then 10.0::double else v / 2.0::double end width_limit, 0 generation from rect")
def ingest_axes(spark, d):
    """Ridge axes with gaps in some columns and one column missing."""
    axes = V.diagonals(spark, d).select("geom", F.when(F.col("v") % 3 != 0, F.col("v")).alias("oe_epoch"), F.when(F.col("v") % 2 != 0, F.col("v") / 2.0).alias("width_km"))
    return scans.ingest_axes(axes).select(F.expr("geom[0].x").alias("x"), F.expr("geom[0].y").alias("y"), "epoch", "base_amplitude", "width_limit", "generation")


@query(with_(X) + "select id, round((c0 + 0.5::double) * 30 + 5, 6) + 0.0 x, round((r0 + 0.5::double) * -30 + 7, 6) + 0.0 y, 'EPSG:32632' crs from rect")
def project_lines(spark, d):
    """Geographic lines put into a plane by the region's affine map."""
    at = scans.projected(V.diagonals(spark, d), True, 32632, (30.0, 0.0, 5.0, 0.0, -30.0, 7.0))
    return at.select("id", rounded(F.col("geom")[0]["x"]).alias("x"), rounded(F.col("geom")[0]["y"]).alias("y"), "crs")
