"""Problem 2: totals over trailing periods of a calendar without gaps, by a range join on coarse buckets of months."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import month_index, month_of_index


def trailing_totals(df: DataFrame, entity: Sequence[str], calendar_end: Sequence[str], periods: Sequence[int] = (3, 12), month: str = "month", n: str = "n", loaded_at: str = "loaded_at") -> DataFrame:
    """entity, month, n, reported, total_P and avg_P of each month of each entity, for each period of P months.

    An entity's calendar goes from the month of its first row to the last month of the rows alike in calendar_end (a part of
    entity). Of several rows for one cell the one with the latest loaded_at holds, of equally late ones the largest n; reported
    says whether any row of the cell has an n. A month without n counts as zero, and so do months before the first row; an
    average divides by the whole period. Rows without a date count for no month. Null entities are entities. An empty table
    gives an empty result; other columns don't matter.

    The periods are no windows over a sorted entity: each calendar month is joined to the monthly totals within its longest
    period, by entity and bucket of as many months, so that a month meets two buckets only.
    """
    width = max(periods)
    entity = list(entity)
    rows = df.select(*entity, month_index(month).alias("_m"), F.col(n).alias("_n"), F.col(loaded_at).alias("_at")).where("_m is not null")
    # Partial aggregates are made before the exchange, so that repeated deliveries of a cell are no load.
    cells = rows.groupBy(*entity, "_m").agg(F.max_by("_n", F.struct(F.coalesce(F.col("_at").cast("timestamp"), F.timestamp_seconds(F.lit(-(10**11)))), F.coalesce("_n", F.lit(-1)))).alias("_n"), F.count("_n").alias("_given"))
    ends = rows.groupBy(*[F.col(c).alias(f"_e_{c}") for c in calendar_end]).agg(F.max("_m").alias("_last"))
    firsts = rows.groupBy(*entity).agg(F.min("_m").alias("_first"))
    spans = firsts.join(ends, reduce(lambda a, b: a & b, [firsts[c].eqNullSafe(ends[f"_e_{c}"]) for c in calendar_end]))
    calendar = spans.select(*entity, F.explode(F.sequence("_first", "_last")).alias("_month"))
    lookback = F.sequence(F.floor((F.col("_month") - (width - 1)) / width), F.floor(F.col("_month") / width))
    calendar = calendar.select(*entity, "_month", F.explode(lookback).alias("_bucket"))
    totals = cells.select(*[F.col(c).alias(f"_t_{c}") for c in entity], F.floor(F.col("_m") / width).alias("_b"), "_m", "_n", "_given")
    on = [calendar[c].eqNullSafe(totals[f"_t_{c}"]) for c in entity] + [calendar["_bucket"] == totals["_b"], totals["_m"] <= calendar["_month"], totals["_m"] > calendar["_month"] - width]
    near = calendar.join(totals, reduce(lambda a, b: a & b, on), "left")
    same = F.col("_m") == F.col("_month")
    value = F.coalesce("_n", F.lit(0))
    sums = [F.sum(F.when(F.col("_m") > F.col("_month") - p, value).otherwise(0)).alias(f"total_{p}") for p in periods]
    out = near.groupBy(*entity, "_month").agg(F.sum(F.when(same, value).otherwise(0)).alias("n"), (F.coalesce(F.max(F.when(same, F.col("_given"))), F.lit(0)) > 0).alias("reported"), *sums)
    return out.select(*entity, month_of_index("_month").alias("month"), "n", "reported", *(x for p in periods for x in (f"total_{p}", (F.col(f"total_{p}") / p).alias(f"avg_{p}"))))
