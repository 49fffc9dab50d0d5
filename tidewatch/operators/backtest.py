"""Alerts against a registered pool of cases and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is: the join then exchanges both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def groups_of(vehicles: DataFrame) -> DataFrame:
    """case_id and groups: the MAKE|MODEL of each case's MAKE|MODEL|YEAR strings, once, in order."""
    one = F.transform("vehicles", lambda v: F.regexp_extract(v, r"^(.*)\|[^|]*$", 1))
    return vehicles.select("case_id", F.array_sort(F.array_distinct(one)).alias("groups"))


def windows(pool: DataFrame) -> DataFrame:
    """grp, begin, until of the receipts that a case or control needs: 48 months before its date to 6 after."""
    return pool.select(F.explode("groups").alias("grp"), F.add_months("odate", -48).alias("begin"), F.add_months("odate", 6).alias("until")).distinct()


def in_scope(complaints: DataFrame, spans: DataFrame) -> DataFrame:
    """The complaints within any window of their group, each as often as it is there: overlapping windows don't repeat it."""
    c, w = complaints, small(spans).alias("w")
    return c.join(w, (c["grp"] == F.col("w.grp")) & (c["ldate"] >= F.col("w.begin")) & (c["ldate"] < F.col("w.until")), "left_semi")


def near(detections: DataFrame, pool: DataFrame) -> DataFrame:
    """The cells of each pool entry's groups from 12 months before its date to 6 after, with the date of which its month is known."""
    entries = small(pool.select("id", "odate", "targets", F.explode("groups").alias("grp")))
    cells = detections.withColumn("available", F.add_months("month", 1)).join(entries, "grp")
    return cells.where("month >= add_months(odate, -12) and month <= add_months(odate, 6)")


def evaluated(detections: DataFrame, pool: DataFrame, basis: str = "month") -> DataFrame:
    """pool with result (early, late, missed), lead_days, the first alert, primary_hit, alerts and group_months.

    pool: id, arm, split, groups, targets, odate. basis is the date of a cell that windows look at: month or available.
    """
    at = F.col(basis)
    rows = detections.withColumn("available", F.add_months("month", 1)).join(small(pool.select("id", "odate", "targets", F.explode("groups").alias("grp"))), "grp")
    main = (at >= F.add_months("odate", -12)) & (at < F.add_months("odate", -1))
    first_window = (at >= F.add_months("odate", -12)) & (at <= F.add_months("odate", 6)) & (F.col("available") <= F.add_months("odate", 6))
    hit = F.col("alert") & F.array_contains("targets", F.col("category"))
    first = F.min(F.when(hit & first_window, F.struct("available", "grp", "category", "month", "n", "baseline", "p_value")))
    found = rows.groupBy("id").agg(first.alias("first"), F.max(hit & main).alias("primary_hit"), F.count_if(main & F.col("alert")).alias("alerts"), F.count_distinct(F.when(main, F.struct("grp", "month"))).alias("group_months"))
    out = pool.join(found, "id", "left")
    lead = F.date_diff("odate", "first.available")
    return out.select(
        "id", "arm", "split", "odate", F.when(lead.isNull(), "missed").when(lead > 0, "early").otherwise("late").alias("result"), lead.alias("lead_days"), F.col("first.grp").alias("first_grp"), F.col("first.category").alias("first_category"), F.col("first.month").alias("first_month"),
        F.coalesce("primary_hit", F.lit(False)).alias("primary_hit"), F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("group_months", F.lit(0)).alias("group_months"),
    )


def summary(results: DataFrame, *by: str) -> DataFrame:
    """hits, total, alerts, group_months and their ratio (null without months), by split and arm or by arm alone."""
    return results.groupBy(*by).agg(F.count_if("primary_hit").alias("hits"), F.count("*").alias("total"), F.sum("alerts").alias("alerts"), F.sum("group_months").alias("group_months")).withColumn("ratio", F.try_divide("alerts", "group_months"))
