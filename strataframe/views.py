"""Grids, a river tree and rectangles derived from the business tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.store import in_shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain, 100 columns wide: elevation, zone 1 to 5, class 0 to 2."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey div 100 as int) as r",
        "cast(o_orderkey % 100 as int) as c",
        "o_totalprice / 100.0D as elev",
        "cast(substring(o_orderpriority, 1, 1) as int) as z",
        "case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as m",
    )


def grid_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second grid of the same width: a value and a river mask."""
    return table(spark, sf_dir, "events").selectExpr("cast(event_id div 100 as int) as r", "cast(event_id % 100 as int) as c", "value as v", "event_type = 'error' as river")


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that both grids have, with all layers."""
    return grid_o(spark, sf_dir).join(in_shuffle(grid_e(spark, sf_dir)), ["r", "c"])


def river(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree rooted at 0: each u flows to v."""
    return table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("c_custkey as u", "c_custkey div (2 + c_nationkey % 3) as v", "abs(c_acctbal) as len")


def rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of cells, corners included."""
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").selectExpr(
        "p_partkey as id",
        "cast(p_partkey * 7 % 100 as int) as c0",
        "cast(p_partkey * 13 % 150 as int) as r0",
        "cast(p_partkey * 7 % 100 as int) + p_size % 8 as c1",
        "cast(p_partkey * 13 % 150 as int) + p_size % 5 as r1",
        "p_size as v",
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles as polygons (geom) that hold their cells' centres."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, n, e, s = F.col("c0"), F.col("r0"), F.col("c1") + 1, F.col("r1") + 1
    return rect(spark, sf_dir).withColumn("geom", F.array(point(w, n), point(e, n), point(e, s), point(w, s)))


def diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line across each rectangle (geom), from one cell's centre to another's."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    half = F.lit(0.5)
    return rect(spark, sf_dir).withColumn("geom", F.array(point(F.col("c0") + half, F.col("r0") + half), point(F.col("c1") + half, F.col("r1") + half)))


#: The same views in DuckDB.
SQL_O = "grid_o as (select cast(o_orderkey // 100 as int) r, cast(o_orderkey % 100 as int) c, o_totalprice / 100.0::double elev, cast(substring(o_orderpriority, 1, 1) as int) z, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end m from orders)"
SQL_E = "grid_e as (select cast(event_id // 100 as int) r, cast(event_id % 100 as int) c, value v, event_type = 'error' river from events)"
SQL_B = f"{SQL_O}, {SQL_E}, cells as (select * from grid_o join grid_e using (r, c))"
SQL_R = "river as (select c_custkey u, c_custkey // (2 + c_nationkey % 3) v, abs(c_acctbal) len from customer where c_custkey > 0)"
SQL_X = "rect as (select p_partkey id, cast(p_partkey * 7 % 100 as int) c0, cast(p_partkey * 13 % 150 as int) r0, cast(p_partkey * 7 % 100 as int) + p_size % 8 c1, cast(p_partkey * 13 % 150 as int) + p_size % 5 r1, p_size v from part where p_partkey % 20 = 0)"
