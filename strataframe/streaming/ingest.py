"""Cells that arrive as a stream: cell-wise operators run on them as they do on tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files: int = 64) -> DataFrame:
    """New files of cells in a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def keep_applied(cells: DataFrame, change: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """change, a cell-wise operator, on every batch; results as Parquet, each cell once whatever is lost meanwhile."""
    writer = change(cells).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(out)
