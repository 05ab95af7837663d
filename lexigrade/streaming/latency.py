"""Latency rounds over a stream of requests: a natural extension of the batch metrics, beyond what they had to cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_windows(requests: DataFrame, time_col: str = "ts", ok_col: str = "ok", latency_col: str = "latency_s", width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(start, requests, success, fail, success_rate, mean_s, max_s) by tumbling window; rows later than the watermark are left out.

    Works on streams and tables alike; state holds one row per open window.
    """
    rows = requests.withColumn("__ts", F.col(time_col).cast("timestamp")).withWatermark("__ts", late)
    good = F.col(ok_col).cast("long")
    out = rows.groupBy(F.window("__ts", width)).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(good).alias("success"), F.avg(F.when(F.col(ok_col), F.col(latency_col))).alias("mean_s"), F.max(F.when(F.col(ok_col), F.col(latency_col))).alias("max_s")
    )
    return out.select(
        F.col("window.start").alias("start"), "requests", "success", (F.col("requests") - F.col("success")).alias("fail"), F.bround(F.col("success") / F.col("requests"), 4).alias("success_rate"), "mean_s", "max_s"
    )
