"""Statistics that follow a stream of voxels or samples, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measures


def windowed_statistics(stream: DataFrame, time: str = "ts", value: str = "value", by: str = "vol", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean, sd, rms, variance, low, high and mean_abs of each group and window; values later than `late` are left out.

    Of a streaming DataFrame the state is a handful of sums for each open window; of a static one all windows are given.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("window"), by).agg(*measures.statistics(F.col(value)))
    return timed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, *(c for c in timed.columns if c not in ("window", by)))


def write_statistics(stream: DataFrame, path: str, checkpoint: str, **options):
    """Appends closed windows to Parquet as the stream goes on; takes what is there and ends. checkpoint: a folder that all executors share."""
    out = windowed_statistics(stream, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()
