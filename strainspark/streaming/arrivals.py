"""Incremental arrival of rows: windowed counts with late data, and hits of new files through a batch plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strainspark.columns import q


def read_arrivals(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int = 16) -> DataFrame:
    """A stream over the Parquet files of a folder, new ones as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, at: str, keys: Sequence[str], *, window: str = "1 hour", late: str = "2 hours", row_id: str | None = None) -> DataFrame:
    """``window_start``, ``keys``, ``n`` of each window and key; rows later than ``late`` are dropped, and with ``row_id``
    those that came before within that time. Works on streams (state is dropped behind the watermark) and tables."""
    t = F.col(q(at)).cast("timestamp")
    rows = stream.withColumn(at, t)
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
        if row_id:
            rows = rows.dropDuplicatesWithinWatermark([row_id])
    elif row_id:
        rows = rows.dropDuplicates([row_id])
    n = rows.groupBy(F.window(at, window).alias("w"), *[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("window_start"), *[q(k) for k in keys], "n")


def drain(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Write all that is there now as Parquet, then stop; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, plan: Callable[[DataFrame, int], None], *, mode: str = "append") -> None:
    """Run a batch plan on the rows of each trigger that is due now. The plan gets the batch's number: written into
    the target's path, it makes a repeated batch overwrite itself."""
    stream.writeStream.foreachBatch(plan).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
