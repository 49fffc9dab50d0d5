"""Evidence of alert cells, co-movement, monthly figures and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_cells(alerts: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labelled complaints of each alert cell: same group, month and, among all its labels, category.

    labelled: odino, grp, ldate, primary, secondary and more. Rows of both sides meet by group, month and category, after the
    labels are exploded; narratives are not carried: join them by odino to what is left.
    """
    rows = labelled.withColumn("month", F.trunc("ldate", "MM")).withColumn("categories", F.array_distinct(F.concat(F.array("primary"), "secondary")))
    return rows.withColumn("category", F.explode("categories")).join(alerts.select("grp", "category", "month"), ["grp", "category", "month"])


def severity_order() -> list[Column]:
    """Fire, then injury, then crash, then the id."""
    return [F.desc_nulls_last("fire"), F.desc_nulls_last(F.coalesce("injured", F.lit(0)) > 0), F.desc_nulls_last("crash"), F.asc("odino")]


def top(rows: DataFrame, by: Sequence[str], order: list[Column], k: int | None) -> DataFrame:
    """The first k rows of each group with their rank; k None: all of them, ranked."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def ordered_counts(rows: DataFrame, by: Sequence[str], value: str, descending: bool, k: int | None, out: str) -> DataFrame:
    """by and out: the values of each group with their counts, the most frequent first, ties by value; k of them at most."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    order = [F.desc("_c"), F.desc(value) if descending else F.asc(value)]
    best = top(counts, by, order, k)
    return best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("value"), F.col("_c").alias("count")))).alias("_l")).select(*by, F.transform("_l", lambda x: F.concat_ws(":", x["value"], x["count"])).alias(out))


def year_bucket(c: Column) -> Column:
    """A model year as text, unknown where it is blank, 0 or 9999."""
    y = F.trim(c)
    return F.when(y.isNull() | y.isin("", "0", "9999"), "unknown").otherwise(y)


def comovement(alerts: DataFrame) -> DataFrame:
    """category, month, groups (sorted) of the alerts of a month, and their number, where there are two or more.

    One row for each category and month; a group's others are the members of its row, so pairs are never written out.
    """
    return alerts.select("category", "month", "grp").distinct().groupBy("category", "month").agg(F.array_sort(F.collect_set("grp")).alias("groups"), F.count("*").alias("number")).where("number > 1")


def monthly_figures(complaints: DataFrame, detections: DataFrame) -> DataFrame:
    """month, complaints, alerts, groups with a fire alert, and complaints and alerts of the month before (0 if there is none)."""
    received = complaints.where("ldate is not null").select("odino", F.trunc("ldate", "MM").alias("month")).groupBy("month").agg(F.count_distinct("odino").alias("complaints"))
    alerts = detections.groupBy("month").agg(F.count_if("alert").alias("alerts"), F.count_distinct(F.when(F.col("alert") & (F.col("category") == "fire_thermal"), F.col("grp"))).alias("fire_groups"))
    both = received.join(alerts, "month", "full_outer").select("month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("complaints", "alerts", "fire_groups")])
    before = both.select(F.add_months("month", 1).alias("month"), F.col("complaints").alias("complaints_before"), F.col("alerts").alias("alerts_before"))
    return both.join(before, "month", "left").select("month", "complaints", "alerts", "fire_groups", F.coalesce("complaints_before", F.lit(0)).alias("complaints_before"), F.coalesce("alerts_before", F.lit(0)).alias("alerts_before"))


def series(grid: DataFrame, until: str | None = None) -> DataFrame:
    """grp, category, months and counts: a series as parallel arrays in calendar order, up to the date until."""
    rows = grid if until is None else grid.where(F.col("month") <= F.lit(until).cast("date"))
    packed = rows.groupBy("grp", "category").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("_s"))
    return packed.select("grp", "category", F.transform("_s", lambda x: F.date_format(x["month"], "yyyy-MM")).alias("months"), F.transform("_s", lambda x: x["n"]).alias("counts"))
