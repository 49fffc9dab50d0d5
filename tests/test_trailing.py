"""Problem 2: against sums by hand."""

from __future__ import annotations

from datetime import date, datetime

from tidewatch.operators.trailing import trailing_totals

SCHEMA = "label_run string, grp string, category string, month date, n bigint, total bigint, loaded_at timestamp, _m string"
AT = datetime(2020, 1, 1)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, at, "clash") for *r, at in rows], SCHEMA).drop("_m")
    out = trailing_totals(df, ["label_run", "grp", "category"], ["label_run"]).collect()
    return {(r["label_run"], r["grp"], r["month"].strftime("%Y-%m")): r for r in out}


def test_gaps_corrections_and_ends(spark):
    got = run(spark, [
        ("r", "a", "c", date(2019, 1, 15), 5, AT), ("r", "a", "c", date(2019, 1, 1), 7, datetime(2020, 2, 1)), ("r", "a", "c", date(2019, 4, 1), None, AT), ("r", "a", "c", date(2019, 5, 1), 2, AT), ("r", "a", "c", date(2019, 5, 1), 2, AT),
        ("r", None, "c", date(2020, 3, 1), 1, AT), ("s", "a", "c", date(2019, 1, 1), 3, AT), ("r", "a", "c", None, 9, AT),
    ])
    a = {m: r for (run_, g, m), r in got.items() if run_ == "r" and g == "a"}
    assert len(a) == 15 and min(a) == "2019-01" and max(a) == "2020-03"
    assert (a["2019-01"]["n"], a["2019-01"]["total_3"], a["2019-03"]["total_3"], a["2019-04"]["total_3"], a["2019-05"]["total_3"]) == (7, 7, 7, 0, 2)
    assert a["2019-12"]["total_12"] == 9 and a["2020-01"]["total_12"] == 2 and a["2019-12"]["avg_12"] == 0.75
    assert [a[m]["reported"] for m in ("2019-01", "2019-02", "2019-04", "2019-05")] == [True, False, False, True]
    assert len([k for k in got if k[0] == "s"]) == 1 and len([k for k in got if k[1] is None]) == 1


def test_empty(spark):
    assert run(spark, []) == {}


def test_plan_joins_by_bucket(spark, sf):
    from tidewatch.plans.problems import p2_trailing

    plan = p2_trailing(spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan
