"""Places and tables that all executors share, and the ways rows are written to and read from them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only on a single local JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="strataframe-")
    return _local_dirs[sc.applicationId]


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, lost executors lose nothing.

    Shuffle files of the writing query are removed when it ends (where Spark has the setting).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataframe-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables made by cut() that nothing will read again."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession, least: int = 16) -> int:
    """Partitions for tables several times as large as a shuffle of the input's rows."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get whole texts in batches of so many rows at most (a setting of the session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that docs doesn't have."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)
