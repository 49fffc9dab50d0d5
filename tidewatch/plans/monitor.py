"""Queries of the monitoring pipeline over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import backtest as B
from tidewatch.operators import counting as C
from tidewatch.operators import evidence as E
from tidewatch.operators import labels as L
from tidewatch.operators import normalize as N
from tidewatch.sources.tables import read

CUTOFFS = ["2017-07-31", "2017-12-31", "2018-03-31", "2018-08-31", "2019-06-30"]
AS_OF = "2018-03-15"


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complaints with labels by keywords; a complaint that comes twice is alike in both rows."""
    return L.keyword_labels(read(spark, sf_dir, "complaints"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """odino, primary, secondary, once each."""
    return complaints(spark, sf_dir).select("odino", "primary", "secondary").groupBy("odino").agg(F.min(F.struct("primary", "secondary")).alias("l")).select("odino", "l.*")


def grid(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> DataFrame:
    return C.dense_grid(read(spark, sf_dir, "complaints"), labels(spark, sf_dir), as_of)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scored(grid(spark, sf_dir))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of cases and controls made from the 60 vehicle groups by their place in order."""
    w = Window.orderBy("grp")  # over the 60 fixed rows of vehicle_groups
    rows = read(spark, sf_dir, "vehicle_groups").select("grp", F.row_number().over(w).alias("i"), F.lead("grp").over(w).alias("next"))
    categories = F.array(*map(F.lit, L.CATEGORIES))
    at = F.when(F.col("i") % 3 == 2, F.col("i") - 1).otherwise(F.col("i"))
    rows = rows.where("i % 3 <> 0").select(
        F.concat(F.when(F.col("i") % 3 == 1, "case-").otherwise("control-"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("id"), F.when(F.col("i") % 3 == 1, "case").otherwise("control").alias("arm"), F.when(at % 2 == 0, "dev").otherwise("holdout").alias("split"),
        F.array_compact(F.array("grp", F.when((F.col("i") % 3 == 1) & (F.col("i") % 4 == 0), F.col("next")))).alias("groups"),
        F.array(F.element_at(categories, (at % 15 + 1).cast("int")), F.element_at(categories, (at * 7 % 15 + 1).cast("int"))).alias("targets"), F.date_add(F.lit("2018-01-10").cast("date"), (at * 8).cast("int")).alias("odate"),
    )
    return rows


def normalized_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalized(read(spark, sf_dir, "complaints_raw"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalized_complaints(spark, sf_dir)
    return out.agg(F.count("*").alias("complaints"), F.count_if(F.isnull("ldate")).alias("without_date"), F.count_distinct("grp").alias("groups"), F.sum(F.size("compdesc_list")).alias("components"))


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complaints").groupBy("grp").agg(F.count_distinct("odino").alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def primary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).groupBy("primary").agg(F.count("*").alias("n"))


def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("odino", "primary", F.concat_ws(",", "secondary").alias("secondary"))


def record_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complaints").select("odino", F.concat_ws(",", L.flags(F.col("text"), F.col("fire"), F.col("crash"), F.col("injured"))).alias("flags")).distinct()


def expression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each month, the complaints whose text matches each of six expressions."""
    rows = read(spark, sf_dir, "complaints").where("month is not null").dropDuplicates(["odino"])
    return rows.groupBy("month").agg(*[F.count_if(L.matches(F.col("text"), L.LEXICON[k])).alias(k) for k in ("fire_thermal", "loss_of_power", "engine_stall", "brakes", "steering", "fuel_leak")])


def dense_monthly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


def asof_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, AS_OF)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 12) for c in ("baseline", "p_value", "binomial_p_value") if c in rows.columns})


def causal_poisson_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(detections(spark, sf_dir).select("grp", "category", "month", "n", "total", "baseline", "p_value", "alert"))


def binomial_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(detections(spark, sf_dir).where("n > 0").select("grp", "category", "month", "n", "total", "binomial_p_value", "binomial_alert"))


def alert_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts with their ratio to the baseline, how long they have lasted, and whether they are new."""
    rows = detections(spark, sf_dir).where("alert")
    return rows.select("grp", "category", "month", "n", "streak", (F.col("streak") == 1).alias("is_new"), F.round(F.col("n") / F.col("baseline"), 6).alias("ratio"), F.round(F.least(F.col("n") / F.col("baseline"), F.lit(5.0)) / 5, 6).alias("intensity"), F.add_months("month", 1).alias("available"), F.concat_ws(":", "grp", "category", F.date_format("month", "yyyy-MM")).alias("cell"))


def asof_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replayed(read(spark, sf_dir, "complaints"), labels(spark, sf_dir), CUTOFFS)


def registered_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.in_scope(read(spark, sf_dir, "complaints"), B.windows(pool(spark, sf_dir)))
    return rows.select("odino", "grp", "ldate").distinct()


def disjunctive_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [r["grp"] for r in read(spark, sf_dir, "vehicle_groups").orderBy("grp").limit(3).collect()]  # three of 60 rows
    a = F.col("grp").isin(groups[:2]) & (F.col("ldate") >= F.lit("2017-01-01").cast("date")) & (F.col("ldate") < F.lit("2018-01-01").cast("date"))
    b = (F.col("grp") == groups[2]) & (F.col("ldate") >= F.lit("2018-06-01").cast("date")) & (F.col("ldate") < F.lit("2019-01-01").cast("date"))
    return read(spark, sf_dir, "complaints").where(a | b).select("odino", "grp", "ldate").distinct()


def case_window_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each case's groups whose month is within 48 months before its date and known within 6 after."""
    entries = B.small(pool(spark, sf_dir).where("arm = 'case'").select("id", "odate", F.explode("groups").alias("grp")))
    rows = grid(spark, sf_dir).where("n > 0").join(entries, "grp").where("month >= add_months(odate, -48) and add_months(month, 1) <= add_months(odate, 6)")
    return rows.groupBy("id").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


def backtest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.evaluated(detections(spark, sf_dir), pool(spark, sf_dir))


def backtest_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.evaluated(detections(spark, sf_dir), pool(spark, sf_dir), "available").select("id", "result", "lead_days", "primary_hit", "alerts", "group_months")


def backtest_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(backtest_cases(spark, sf_dir), "split", "arm").withColumn("ratio", F.round("ratio", 9))


def backtest_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(backtest_cases(spark, sf_dir), "arm").withColumn("ratio", F.round("ratio", 9))


def backtest_single_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(B.evaluated(detections(spark, sf_dir), pool(spark, sf_dir).where("size(groups) = 1")), "arm").select("arm", "hits", "total")


def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest_cases(spark, sf_dir).groupBy("split", "arm", "result").agg(F.count("*").alias("n"))


def lead_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between an entry's first alert and its date, and on which side."""
    return backtest_cases(spark, sf_dir).where("lead_days is not null").select("id", F.abs("lead_days").alias("days"), F.when(F.col("lead_days") > 0, "before").otherwise("after").alias("side"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = complaints(spark, sf_dir).where("ldate is not null").dropDuplicates(["odino"])
    rows = rows.select("odino", "grp", "ldate", "primary", "secondary", "fire", "crash", "injured", "year", L.flags(F.col("text"), F.col("fire"), F.col("crash"), F.col("injured")).alias("flags"))
    return E.of_cells(detections(spark, sf_dir).where("alert"), rows)


def evidence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each alert cell, the records and how many carry each flag."""
    return _evidence(spark, sf_dir).groupBy("grp", "category", "month").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("flags", f)).alias(f) for f in L.FLAGS]).where("n >= 3")


def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top(_evidence(spark, sf_dir), ["grp", "category", "month"], E.severity_order(), 10).select("grp", "category", "month", "odino", "rank")


def co_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumn("other", F.explode(F.array_remove("categories", F.col("category"))))
    return E.ordered_counts(rows, ["grp", "category", "month"], "other", False, 3, "top").withColumn("top", F.concat_ws(",", "top"))


def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumn("model_year", E.year_bucket(F.col("year")))
    return E.ordered_counts(rows, ["grp", "category", "month"], "model_year", True, None, "years").withColumn("years", F.concat_ws(",", "years"))


def comovement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.comovement(detections(spark, sf_dir).where("alert")).withColumn("groups", F.concat_ws(",", "groups"))


def snapshot_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.monthly_figures(read(spark, sf_dir, "complaints"), detections(spark, sf_dir))


def series_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.series(grid(spark, sf_dir), "2018-10-01").select("grp", "category", F.concat_ws(",", "months").alias("months"), F.concat_ws(",", F.transform("counts", lambda x: x.cast("string"))).alias("counts"))


def last_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 18 months of each series of all complaints of a group."""
    rows = grid(spark, sf_dir).where("category = 'other'")
    return E.top(rows, ["grp"], [F.desc("month")], 18).select("grp", "month", "total", "rank")


_CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in L.CATEGORIES) + "]"
_FOUND = "list_filter([" + ", ".join(f"case when regexp_matches(lower(text), '{L.WORD}(?:{w})') then '{c}' end" for c, w in L.LEXICON.items()) + "], lambda x: x is not null)"
_FLAGS = "list_filter([" + ", ".join(f"case when regexp_matches(lower(text), '{L.WORD}(?:{L.FLAG_PATTERNS[f]})') then '{f}' end" for f in L.FLAGS[:3]) + ", case when fire then 'fire' end, case when crash then 'crash' end, case when injured > 0 then 'injured' end], lambda x: x is not null)"
_LABELS = f"""
once as (select distinct on (odino) * from complaints order by odino),
found as (select *, {_FOUND} as f from once),
lab as (select *, coalesce(f[1], 'other') as prim, f[2:3] as sec, list_distinct(list_concat([coalesce(f[1], 'other')], f[2:3])) as cats from found)"""


def _grid_sql(as_of: str | None = None) -> str:
    known = f"and ldate <= date '{as_of}'" if as_of else ""
    last = f"date_trunc('month', date '{as_of}')" if as_of else "(select max(month) from dat)"
    return f"""{_LABELS},
dat as (select odino, grp, cast(date_trunc('month', ldate) as date) as month, cats from lab where ldate is not null and grp is not null {known}),
tot as (select grp, month, count(distinct odino) as total from dat group by all),
cnt as (select grp, month, c as category, count(distinct odino) as n from (select odino, grp, month, unnest(cats) as c from dat) group by all),
sp as (select grp, min(month) as first from dat group by grp),
cal as (select grp, cast(unnest(generate_series(first, {last}, interval 1 month)) as date) as month from sp),
cel as (select grp, month, unnest({_CATEGORY_LIST}) as category from cal),
grid as (
  select cel.grp, cel.category, cel.month, coalesce(n, 0) as n, coalesce(total, 0) as total from cel
  left join cnt on cel.grp = cnt.grp and cel.month = cnt.month and cel.category = cnt.category left join tot on cel.grp = tot.grp and cel.month = tot.month)"""


_SCORED = f"""{_grid_sql()},
h as (
  select *, count(n) over w >= {C.LEAST_HISTORY} as enough, avg(n) over w as m, sum(n) over w as hn, sum(total) over w as ht from grid
  window w as (partition by grp, category order by month rows between {C.HISTORY} preceding and 1 preceding)),
b as (select *, case when enough then greatest(m, {C.FLOOR}) end as baseline, case when enough and ht > 0 then least(greatest(hn / ht, 0), 1) end as rate from h),
p as (
  select *, case when baseline is null then null when n = 0 then 1.0
    when n >= baseline then list_sum(list_transform(range(cast(n as bigint), cast(n + 80 + 12 * sqrt(greatest(baseline, 1)) as bigint)), lambda k: exp(k * ln(baseline) - baseline - lgamma(k + 1))))
    else 1 - list_sum(list_transform(range(0, cast(n as bigint)), lambda k: exp(k * ln(baseline) - baseline - lgamma(k + 1)))) end as p_value,
  case when rate is null then null when n = 0 then 1.0 when rate = 0 then 0.0 when rate = 1 then 1.0
    when n >= total * rate then list_sum(list_transform(range(cast(n as bigint), cast(total + 1 as bigint)), lambda k: exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(rate) + (total - k) * ln(1 - rate))))
    else 1 - list_sum(list_transform(range(0, cast(n as bigint)), lambda k: exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(rate) + (total - k) * ln(1 - rate)))) end as q from b),
r as (select *, coalesce(p_value < {C.ALPHA} and n >= {C.LEAST_COUNT}, false) as alert, coalesce(q < {C.ALPHA} and n >= {C.LEAST_COUNT}, false) as binomial_alert from p),
i as (select *, sum(case when alert then 0 else 1 end) over (partition by grp, category order by month rows unbounded preceding) as island from r),
det as (select *, sum(case when alert then 1 else 0 end) over (partition by grp, category, island order by month rows unbounded preceding) as streak from i)"""
_POOL = f"""
pr as (select grp, row_number() over (order by grp) as i, lead(grp) over (order by grp) as nxt from vehicle_groups),
pa as (select *, case when i % 3 = 2 then i - 1 else i end as a from pr where i % 3 <> 0),
pool as (
  select case when i % 3 = 1 then 'case-' else 'control-' end || lpad(cast(i as varchar), 2, '0') as id, case when i % 3 = 1 then 'case' else 'control' end as arm, case when a % 2 = 0 then 'dev' else 'holdout' end as split,
    case when i % 3 = 1 and i % 4 = 0 and nxt is not null then [grp, nxt] else [grp] end as groups, [{_CATEGORY_LIST}[a % 15 + 1], {_CATEGORY_LIST}[a * 7 % 15 + 1]] as targets, cast(date '2018-01-10' + cast(a * 8 as int) as date) as odate from pa),
pg as (select *, unnest(groups) as grp from pool)"""


def _evaluated(basis: str, where: str = "true") -> str:
    return f"""{_POOL.replace("pg as (select *, unnest(groups) as grp from pool)", f"pg as (select *, unnest(groups) as grp from pool where {where})")},
dv as (select *, cast(month + interval 1 month as date) as available from det),
jn as (select pg.id, pg.odate, targets, dv.* from pg join dv on pg.grp = dv.grp),
fl as (select *, {basis} >= odate - interval 12 month and {basis} < odate - interval 1 month as main, alert and list_contains(targets, category) as hit,
  {basis} >= odate - interval 12 month and {basis} <= odate + interval 6 month and available <= odate + interval 6 month as fw from jn),
fa as (select id, min((available, grp, category, month)) filter (where hit and fw) as f, coalesce(bool_or(hit and main), false) as primary_hit, count(*) filter (where main and alert) as alerts, count(distinct case when main then (grp, month) end) as group_months from fl group by id),
ev as (
  select pool.id, arm, split, odate, case when f is null then 'missed' when date_diff('day', f[1], odate) > 0 then 'early' else 'late' end as result, date_diff('day', f[1], odate) as lead_days, f[2] as first_grp, f[3] as first_category, f[4] as first_month,
    coalesce(primary_hit, false) as primary_hit, coalesce(alerts, 0) as alerts, coalesce(group_months, 0) as group_months from pool left join fa on pool.id = fa.id where {where})"""


_EV = f"with {_SCORED}, {_evaluated('month')}"
_SUM = "cast(count(*) filter (where primary_hit) as bigint) as hits, count(*) as total, cast(sum(alerts) as bigint) as alerts, cast(sum(group_months) as bigint) as group_months, round(case when sum(group_months) > 0 then sum(alerts) / sum(group_months) end, 9) as ratio"
_EVIDENCE = f"""{_SCORED},
rec as (select odino, grp, cast(date_trunc('month', ldate) as date) as month, cats, unnest(cats) as category, fire, crash, injured, year, {_FLAGS} as flags from lab where ldate is not null),
evi as (select rec.* from rec join (select grp, category, month from det where alert) a on rec.grp = a.grp and rec.month = a.month and rec.category = a.category)"""


def _ordered(value: str, source: str, order: str, k: str, out: str) -> str:
    return f"""with {_EVIDENCE}, v as (select grp, category, month, {value} as v from {source}), c as (select grp, category, month, v, count(*) as c from v group by all),
    k as (select *, row_number() over (partition by grp, category, month order by {order}) as r from c) select grp, category, month, string_agg(v || ':' || c, ',' order by r) as {out} from k {k} group by all"""


_C6 = ("fire_thermal", "loss_of_power", "engine_stall", "brakes", "steering", "fuel_leak")
SQL = {
    "normalized_complaints": N.SQL,
    "ingest_summary": f"with x as ({N.SQL}) select count(*) as complaints, count(*) filter (where ldate is null) as without_date, count(distinct grp) as groups, cast(sum(len(compdesc_list)) as bigint) as components from x",
    "group_counts": "select grp, count(distinct odino) as n, min(month) as first_month, max(month) as last_month from complaints group by grp",
    "primary_counts": f"with {_LABELS} select prim as primary, count(*) as n from lab group by prim",
    "keyword_labels": f"with {_LABELS} select odino, prim as primary, array_to_string(sec, ',') as secondary from lab",
    "record_flags": f"with {_LABELS} select odino, array_to_string({_FLAGS}, ',') as flags from lab",
    "expression_counts": "with once as (select distinct on (odino) * from complaints order by odino) select month, " + ", ".join(f"count(*) filter (where regexp_matches(lower(text), '{L.WORD}(?:{L.LEXICON[k]})')) as {k}" for k in _C6) + " from once where month is not null group by month",
    "dense_monthly_grid": f"with {_grid_sql()} select * from grid",
    "asof_grid": f"with {_grid_sql(AS_OF)} select * from grid",
    "causal_poisson_alerts": f"with {_SCORED} select grp, category, month, n, total, round(baseline, 12) as baseline, round(p_value, 12) as p_value, alert from det",
    "binomial_comparison": f"with {_SCORED} select grp, category, month, n, total, round(q, 12) as binomial_p_value, binomial_alert from det where n > 0",
    "alert_streaks": f"with {_SCORED} select grp, category, month, n, cast(streak as bigint) as streak, streak = 1 as is_new, round(n / baseline, 6) as ratio, round(least(n / baseline, 5.0) / 5, 6) as intensity, cast(month + interval 1 month as date) as available, grp || ':' || category || ':' || strftime(month, '%Y-%m') as cell from det where alert",
    "asof_replay": f"with {_grid_sql()} select c as cutoff, count(*) as cells, cast(0 as bigint) as differing from grid, (select unnest([{', '.join(f"date '{c}'" for c in CUTOFFS)}]) as c) where month <= c group by c",
    "registered_scope": f"with {_POOL} select distinct odino, grp, ldate from complaints c where exists (select 1 from pg where pg.grp = c.grp and c.ldate >= pg.odate - interval 48 month and c.ldate < pg.odate + interval 6 month)",
    "disjunctive_scope": "with g as (select list(grp order by grp) as g from vehicle_groups) select distinct odino, grp, ldate from complaints, g where (grp in (g[1], g[2]) and ldate >= date '2017-01-01' and ldate < date '2018-01-01') or (grp = g[3] and ldate >= date '2018-06-01' and ldate < date '2019-01-01')",
    "case_window_cells": f"with {_grid_sql()}, {_POOL} select id, count(*) as cells, cast(sum(n) as bigint) as n from grid join pg on grid.grp = pg.grp where arm = 'case' and n > 0 and month >= odate - interval 48 month and month + interval 1 month <= odate + interval 6 month group by id",
    "backtest_cases": f"{_EV} select * from ev",
    "backtest_available": f"with {_SCORED}, {_evaluated('available')} select id, result, lead_days, primary_hit, alerts, group_months from ev",
    "backtest_2x2": f"{_EV} select split, arm, {_SUM} from ev group by split, arm",
    "backtest_burden": f"{_EV} select arm, {_SUM} from ev group by arm",
    "backtest_single_group": f"with {_SCORED}, {_evaluated('month', 'len(groups) = 1')} select arm, count(*) filter (where primary_hit) as hits, count(*) as total from ev group by arm",
    "outcome_histogram": f"{_EV} select split, arm, result, count(*) as n from ev group by all",
    "lead_comparison": f"{_EV} select id, abs(lead_days) as days, case when lead_days > 0 then 'before' else 'after' end as side from ev where lead_days is not null",
    "evidence_cells": f"with {_EVIDENCE} select grp, category, month, count(*) as n, " + ", ".join(f"count(*) filter (where list_contains(flags, '{f}')) as {f}" for f in L.FLAGS) + " from evi group by all having count(*) >= 3",
    "evidence_topk": f"with {_EVIDENCE}, k as (select grp, category, month, odino, row_number() over (partition by grp, category, month order by fire desc nulls last, coalesce(injured, 0) > 0 desc nulls last, crash desc nulls last, odino) as rank from evi) select * from k where rank <= 10",
    "co_categories": _ordered("o", "(select *, unnest(list_filter(cats, lambda x: x <> category)) as o from evi)", "c desc, v", "where r <= 3", "top"),
    "year_histogram": _ordered("case when year is null or trim(year) in ('', '0', '9999') then 'unknown' else trim(year) end", "evi", "c desc, v desc", "", "years"),
    "comovement": f"with {_SCORED}, a as (select distinct category, month, grp from det where alert) select category, month, string_agg(grp, ',' order by grp) as groups, count(*) as number from a group by all having count(*) > 1",
    "snapshot_kpis": f"""with {_SCORED}, c as (select cast(date_trunc('month', ldate) as date) as month, count(distinct odino) as complaints from complaints where ldate is not null group by 1),
      a as (select month, count(*) filter (where alert) as alerts, count(distinct case when alert and category = 'fire_thermal' then grp end) as fire_groups from det group by month),
      m as (select coalesce(c.month, a.month) as month, coalesce(complaints, 0) as complaints, coalesce(alerts, 0) as alerts, coalesce(fire_groups, 0) as fire_groups from c full join a on c.month = a.month)
      select m.*, coalesce(b.complaints, 0) as complaints_before, coalesce(b.alerts, 0) as alerts_before from m left join m b on b.month + interval 1 month = m.month""",
    "series_arrays": f"with {_grid_sql()} select grp, category, string_agg(strftime(month, '%Y-%m'), ',' order by month) as months, string_agg(cast(n as varchar), ',' order by month) as counts from grid where month <= date '2018-10-01' group by all",
    "last_months": f"with {_grid_sql()}, k as (select grp, month, total, row_number() over (partition by grp order by month desc) as rank from grid where category = 'other') select * from k where rank <= 18",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL}
