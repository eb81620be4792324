import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Compares a registered query with its SQL over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")

    def plain(df):
        df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
        return sorted(tuple(f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in row) for row in df.itertuples(index=False))

    def check(name, run, sql):
        got, want = run(spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert plain(got) == plain(want), name

    return check
