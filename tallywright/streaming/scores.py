"""Score histograms over event-time windows: the state every metric can be computed from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.metrics import equal_width_bin


def windowed_histogram(stream: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes", n_bins: int = 10) -> DataFrame:
    """(window, keys, bin, n, p, sum_s) of a stream with y and s; rows later than the watermark are left out."""
    return (
        stream.withWatermark(time, late).withColumn("bin", equal_width_bin(n_bins)).groupBy(F.window(time, window).alias("window"), *keys, "bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.sum("s").alias("sum_s"))
    )
