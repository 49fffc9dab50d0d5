"""From complaints and labels to a dense grid of monthly counts, and to scored cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.tails import binomial_tail, poisson_tail
from tidewatch.functions.values import month_index
from tidewatch.operators.labels import CATEGORIES

# History of the baseline, least history, floor of the baseline, level and least count of an alert.
HISTORY, LEAST_HISTORY, FLOOR, ALPHA, LEAST_COUNT = 12, 6, 0.5, 0.001, 3


class Broken(ValueError):
    """An input that breaks a rule of an operator."""


def require_none(df: DataFrame, says: str) -> None:
    """Raise if df has a row. One row is looked for, not all counted."""
    if df.limit(1).count():
        raise Broken(says)


def receipts(complaints: DataFrame, as_of: str | None = None) -> DataFrame:
    """odino, grp and ldate of each complaint with a received date, once: no other column can enter the counts.

    Received later than as_of is unknown. Of a complaint that comes with several dates the earliest row counts.
    """
    rows = complaints.select(F.col("odino").cast("string").alias("odino"), "grp", "ldate").where("ldate is not null")
    if as_of is not None:
        rows = rows.where(F.col("ldate") <= F.lit(as_of).cast("date"))
    first = rows.groupBy("odino").agg(F.min(F.struct("ldate", "grp")).alias("r"))
    return first.select("odino", "r.grp", "r.ldate").where("grp is not null")


def check_labels(complaints: DataFrame, labels: DataFrame) -> None:
    """Raise unless each complaint has exactly one label row, of known categories."""
    require_none(labels.groupBy("odino").count().where("count > 1"), "more than one label row for a complaint")
    require_none(labels.select(F.explode(F.concat(F.array("primary"), F.coalesce("secondary", F.array().cast("array<string>")))).alias("c")).where(~F.col("c").isin(CATEGORIES)), "unknown category")
    require_none(complaints.select("odino").join(labels.select("odino"), "odino", "left_anti"), "complaints without a label")


def dense_grid(complaints: DataFrame, labels: DataFrame, as_of: str | None = None, categories: list[str] = CATEGORIES) -> DataFrame:
    """grp, category, month, n, total: complaints that carry the category, and all, of each group and calendar month.

    A group's months go from its first to the last of all groups (or to the month of as_of); months without complaints are 0.
    One shuffle by complaint joins the labels. What follows works on sums per group, day and category, so a hot group is
    summed before it is exchanged. The calendar is made per group; the last month is one value.
    """
    data = receipts(complaints, as_of).withColumn("month", F.trunc("ldate", "MM"))
    marks = labels.select(F.col("odino").cast("string").alias("odino"), F.array_distinct(F.concat(F.array("primary"), F.coalesce("secondary", F.array().cast("array<string>")))).alias("of"))
    # One pass: each complaint gives one row for itself (category null) and one for each of its categories.
    joined = data.join(marks, "odino", "left").select("grp", "month", F.explode(F.concat(F.array(F.lit("")), F.coalesce("of", F.array().cast("array<string>")))).alias("category"))
    counts = joined.groupBy("grp", "month", "category").agg(F.count("*").alias("n"))
    totals = counts.where("category = ''").select("grp", "month", F.col("n").alias("total"))
    last = totals.agg(F.max("month").alias("last")) if as_of is None else complaints.sparkSession.range(1).select(F.trunc(F.lit(as_of).cast("date"), "MM").alias("last"))
    spans = totals.groupBy("grp").agg(F.min("month").alias("first")).join(F.broadcast(last), how="cross")  # last is one row
    months = spans.select("grp", F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month")).join(totals, ["grp", "month"], "left")
    cells = months.select("grp", "month", F.coalesce("total", F.lit(0)).alias("total"), F.explode(F.array(*map(F.lit, categories))).alias("category"))
    out = cells.join(counts, ["grp", "month", "category"], "left")
    return out.select("grp", "category", "month", F.coalesce("n", F.lit(0)).alias("n"), "total")


def check_grid(grid: DataFrame) -> None:
    """Raise unless months are unique month starts without a gap and 0 <= n <= total."""
    require_none(grid.where("month is null or day(month) <> 1"), "months must be the first of a month")
    require_none(grid.where("n < 0 or total < 0 or n > total"), "0 <= n <= total")
    require_none(grid.groupBy("grp", "category", "month").count().where("count > 1"), "duplicate month")
    m = month_index("month")
    require_none(grid.groupBy("grp", "category").agg(F.count("*").alias("c"), (F.max(m) - F.min(m) + 1).alias("span")).where("c <> span"), "missing months")


def scored(grid: DataFrame, history: int = HISTORY, least_history: int = LEAST_HISTORY, floor: float = FLOOR, alpha: float = ALPHA, least_count: int = LEAST_COUNT) -> DataFrame:
    """grid with baseline, p_value, alert, streak, binomial_p_value and binomial_alert; null baselines and p-values aren't scored.

    A cell's baseline is the mean n of the months before it, at most history and at least least_history of them, and at least
    floor. All window functions share one partitioning by series, so the grid is exchanged and sorted once.
    """
    series = Window.partitionBy("grp", "category").orderBy("month")
    before = series.rowsBetween(-history, -1)
    enough = F.count("n").over(before) >= least_history
    rows = grid.withColumn("baseline", F.when(enough, F.greatest(F.avg("n").over(before), F.lit(floor)))).withColumn("_n", F.when(enough, F.sum("n").over(before))).withColumn("_t", F.when(enough, F.sum("total").over(before)))
    rate = F.when(F.col("_t") > 0, F.least(F.greatest(F.col("_n") / F.col("_t"), F.lit(0.0)), F.lit(1.0)))  # least and greatest pass nulls over
    p, q = poisson_tail(F.col("n"), F.col("baseline")), binomial_tail(F.col("n"), F.col("total"), rate)

    def rule(c: str) -> Column:
        return F.coalesce((F.col(c) < alpha) & (F.col("n") >= least_count), F.lit(False))

    # The tails are made where they can matter to an alert or are asked for; they are lazy columns either way.
    rows = rows.withColumn("p_value", p).withColumn("binomial_p_value", q).withColumn("alert", rule("p_value")).withColumn("binomial_alert", rule("binomial_p_value"))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("alert"), 0).otherwise(1)).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("alert").cast("int")).over(Window.partitionBy("grp", "category", "_island").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", run).select("grp", "category", "month", "n", "total", "baseline", "p_value", "alert", "streak", "binomial_p_value", "binomial_alert")


def replayed(complaints: DataFrame, labels: DataFrame, cutoffs: list[str]) -> DataFrame:
    """cutoff, cells and differing: at each cutoff (a month's last day), the cells known then, and those the full run shows otherwise.

    One job: counts per group, month and category are made once; the grid of a cutoff is those months up to it, as its
    receipts are whole months; the detector runs over all cutoffs at once with the cutoff as part of the series.
    """
    grid = dense_grid(complaints, labels)
    full = scored(grid)
    # An explode of the cutoffs multiplies cells of the grid, not complaints.
    parts = grid.withColumn("cutoff", F.explode(F.array(*[F.lit(c).cast("date") for c in cutoffs]))).where("month <= cutoff")
    known = parts.select(F.concat_ws("\x1f", F.col("cutoff").cast("string"), "grp").alias("grp"), "category", "month", "n", "total")
    again = scored(known).withColumn("cutoff", F.split("grp", "\x1f")[0].cast("date")).withColumn("grp", F.split("grp", "\x1f")[1])
    f = full.select("grp", "category", "month", *[F.col(c).alias(f"f_{c}") for c in ("n", "total", "baseline", "p_value", "alert", "streak")])
    same = F.lit(True)
    for c in ("n", "total", "baseline", "p_value", "alert", "streak"):
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    return again.join(f, ["grp", "category", "month"], "left").groupBy("cutoff").agg(F.count("*").alias("cells"), F.count_if(~same).alias("differing"))
