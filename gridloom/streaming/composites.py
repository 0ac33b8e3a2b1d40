"""Composites over event time: watermarked windows over a stream of observations (row, col, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_stream(spark: SparkSession, path: str, schema: str = "row int, col int, ts timestamp, value float", files_per_trigger: int = 16) -> DataFrame:
    """Observations from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_composite(observations: DataFrame, every: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, row, col, n, n_valid, mean, minimum, maximum per pixel and time window; nodata (NULL) drops out.

    Observations later than ``late`` behind the newest one are dropped, which bounds the state. Works on batches too.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    seen = observations.withWatermark("ts", late) if observations.isStreaming else observations
    return (
        seen.groupBy(F.window("ts", every, slide or every).alias("w"), "row", "col")
        .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
        .select(F.col("w.start").alias("window_start"), "row", "col", "n", "n_valid", "mean", "minimum", "maximum")
    )
