"""Monthly counts of a stream of complaints: the batch operator's receipts, with a watermark for late ones.

An extension: the same cells as dense_grid before its zeros, kept up to date as files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_counts(stream: DataFrame, late: str = "62 days") -> DataFrame:
    """grp, month and n of a stream with odino, grp and ldate. A complaint counts once; rows later than late are dropped by the watermark."""
    rows = stream.where("ldate is not null").withColumn("received", F.col("ldate").cast("timestamp")).withWatermark("received", late)
    once = rows.dropDuplicatesWithinWatermark(["odino"])
    return once.groupBy("grp", F.trunc("received", "MM").alias("month")).agg(F.count("*").alias("n"))
