"""Tables that outlive a job: checkpoints of worlds, and cuts of lineage in a folder that executors share."""

from __future__ import annotations

import functools
import json
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only one local JVM may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="strataframe-"))


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_shuffle(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle of both sides: cells in Parquet take a fraction of their size in memory, and the planner goes by the files' size."""
    return df.hint("merge")


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is cut, after which all tables that it cut on its way are deleted, also if it fails.

    What is left in the shared folder is one table a result; within another tidied operator it goes with that one's.
    """

    @functools.wraps(operator)
    def run(first: DataFrame, *args, **named) -> DataFrame:
        spark = first.sparkSession
        scopes = _scopes.__dict__.setdefault("open", [])
        mine: list[str] = []
        scopes.append(mine)
        try:
            try:
                out = operator(first, *args, **named)
            finally:
                scopes.pop()
            return cut(out)
        finally:
            for path in mine:
                _delete(spark, path)

    return run


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_or_run(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written there first if there is none complete."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_world(cells: DataFrame, meta: dict, path: str, blocks: int = 256) -> None:
    """A world's layers and its grid's description. Partitioned by bands of rows, so that a reader of a window prunes."""
    from pyspark.sql import functions as F

    cells.withColumn("band", F.expr(f"r div {blocks}")).write.mode("overwrite").partitionBy("band").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_world(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    if not exists(spark, f"{path}/cells/_SUCCESS"):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/cells").drop("band"), json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
