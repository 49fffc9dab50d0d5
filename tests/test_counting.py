"""The grid, the detector and the backtest on small hand-made inputs."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.tails import binomial_tail, poisson_tail
from tidewatch.operators import backtest as B
from tidewatch.operators import counting as C


def complaints(spark, rows):
    return spark.createDataFrame([(i, g, d, "trap") for i, g, d in rows], "odino string, grp string, ldate date, compdesc string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "odino string, primary string, secondary array<string>")


def test_grid_counts_ids_once_and_fills_months(spark):
    rows = [("1", "A|B", date(2018, 1, 3)), ("1", "A|B", date(2018, 1, 3)), ("2", "A|B", date(2018, 3, 4)), ("3", "A|B", None), ("4", None, date(2018, 1, 1))]
    marks = [("1", "fire_thermal", ["brakes", "fire_thermal"]), ("2", "other", []), ("3", "other", None), ("4", "other", [])]
    got = {(r["category"], r["month"].month): (r["n"], r["total"]) for r in C.dense_grid(complaints(spark, rows), labels(spark, marks)).collect()}
    assert len(got) == 48
    assert [got["fire_thermal", m] for m in (1, 2, 3)] == [(1, 1), (0, 0), (0, 1)] and [got["brakes", m][0] for m in (1, 2, 3)] == [1, 0, 0] and got["other", 3] == (1, 1)
    cut = {(r["category"], r["month"].month): r["n"] for r in C.dense_grid(complaints(spark, [("1", "A|B", date(2018, 3, 10)), ("2", "A|B", date(2018, 3, 25))]), labels(spark, marks), "2018-03-15").collect()}
    assert cut["fire_thermal", 3] == 1 and cut["other", 3] == 0
    assert C.dense_grid(complaints(spark, []), labels(spark, [])).count() == 0


def test_label_rules_raise(spark):
    c = complaints(spark, [("1", "A|B", date(2018, 1, 1))])
    for bad in ([], [("1", "other", []), ("1", "brakes", [])], [("1", "unknown", [])]):
        with pytest.raises(C.Broken):
            C.check_labels(c, labels(spark, bad))
    C.check_labels(c, labels(spark, [("1", "other", [])]))


def grid(spark, n, total=10, start=(2017, 1)):
    rows = [("A|B", "brakes", date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1), k, total) for i, k in enumerate(n)]
    return spark.createDataFrame(rows, "grp string, category string, month date, n bigint, total bigint")


def test_detector(spark):
    rows = C.scored(grid(spark, [0] * 6 + [5, 8, 0, 3])).orderBy("month").collect()
    assert [r["baseline"] for r in rows[:6]] == [None] * 6 and rows[6]["baseline"] == 0.5 and math.isclose(rows[7]["baseline"], 5 / 7)
    assert math.isclose(rows[6]["p_value"], 1 - sum(math.exp(-0.5) * 0.5**k / math.factorial(k) for k in range(5)), rel_tol=1e-9)
    assert [r["streak"] for r in rows[6:9]] == [1, 2, 0] and not rows[0]["alert"] and rows[0]["p_value"] is None


def test_grid_rules_raise(spark):
    g = grid(spark, [1, 2, 3])
    for bad in (g.where("month <> '2017-02-01'"), g.union(g), g.withColumn("n", F.lit(11)), g.withColumn("month", F.date_add("month", 1))):
        with pytest.raises(C.Broken):
            C.check_grid(bad)
    C.check_grid(g)


def test_tails(spark):
    cases = [(n, lam) for lam in (0.5, 3.3, 40.0, 1000.0) for n in (0, 1, 3, 20, 40, 90, 900, 1000, 1100)]
    got = spark.createDataFrame(cases, "n bigint, l double").select("n", "l", poisson_tail(F.col("n"), F.col("l")).alias("p")).collect()
    for n, lam, p in got:
        want = math.fsum(math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) for k in range(n, n + 4000))
        assert math.isclose(p, min(want, 1), rel_tol=1e-9, abs_tol=1e-13), (n, lam, p, want)
    cases = [(n, t, q) for t, q in ((10, 0.1), (500, 0.02), (300, 0.9)) for n in (0, 1, 5, 10, 30, 250, 280)] + [(1, 1, 0.0), (1, 1, 1.0)]
    for n, t, q, p in spark.createDataFrame(cases, "n bigint, t bigint, q double").select("n", "t", "q", binomial_tail(F.col("n"), F.col("t"), F.col("q")).alias("p")).collect():
        want = math.fsum(math.comb(t, k) * q**k * (1 - q) ** (t - k) for k in range(n, t + 1))
        assert math.isclose(p, want, rel_tol=1e-9, abs_tol=1e-13), (n, t, q, p, want)
    assert spark.range(1).select(poisson_tail(F.lit(None).cast("bigint"), F.lit(1.0)).alias("p")).first()["p"] is None


def test_no_later_receipt_changes_an_earlier_month(spark):
    rows = [(f"{m}-{i}", "A|B", date(2017 + m // 12, m % 12 + 1, 3)) for m in range(24) for i in range(1 if m < 6 else 6)]
    got = C.replayed(complaints(spark, rows), labels(spark, [(r[0], "brakes", []) for r in rows]), ["2017-07-31", "2017-12-31", "2018-08-31"]).collect()
    assert {str(r["cutoff"]): (r["cells"], r["differing"]) for r in got} == {"2017-07-31": (112, 0), "2017-12-31": (192, 0), "2018-08-31": (320, 0)}


@pytest.mark.parametrize("month,odate,basis,result,lead,hit", [
    (date(2020, 2, 1), "2020-03-15", "available", "early", 14, False), (date(2020, 1, 1), "2020-03-15", "available", "early", 43, True), (date(2020, 2, 1), "2020-03-01", "available", "late", 0, False), (date(2019, 2, 1), "2020-03-01", "available", "early", 366, True),
    (date(2020, 2, 1), "2020-03-15", "month", "early", 14, True), (date(2020, 3, 1), "2020-03-15", "month", "late", -17, False), (date(2020, 9, 1), "2020-03-15", "month", "missed", None, False),
])
def test_backtest(spark, month, odate, basis, result, lead, hit):
    d = spark.createDataFrame([("A|B", "brakes", month, 5, 0.5, 0.0001, True)], "grp string, category string, month date, n bigint, baseline double, p_value double, alert boolean")
    pool = spark.createDataFrame([("x", "case", "dev", ["A|B"], ["brakes"], odate)], "id string, arm string, split string, groups array<string>, targets array<string>, odate string").withColumn("odate", F.col("odate").cast("date"))
    r = B.evaluated(d, pool, basis).first()
    assert (r["result"], r["lead_days"], r["primary_hit"]) == (result, lead, hit)


def test_groups_of_vehicles(spark):
    df = spark.createDataFrame([("c", ["B|Y|2015", "A|X|2014", "B|Y|2016"])], "case_id string, vehicles array<string>")
    assert B.groups_of(df).first()["groups"] == ["A|X", "B|Y"]
