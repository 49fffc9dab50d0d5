"""The raw table as one row per consumer complaint (S3 columns, F1-F3, W1, A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import trimmed

# The complaint types of consumers, and the product type of vehicles.
CONSUMER_TYPES = ["IVOQ", "VOQ", "EVOQ", "MIVQ", "MAVQ", "MVOQ", "SVOQ", "LETR", "CAG", "CON", "INS"]
VEHICLE = "V"
_KEPT = ["c01", "c04", "c05", "c06", "c07", "c09", "c10", "c11", "c16", "c17", "c20", "c21"]


def normalized(raw: DataFrame) -> DataFrame:
    """One row per trimmed c02 of consumer complaints of vehicles: that of the smallest c01, and all components of all its rows.

    No window over wide rows: one aggregate with partial sums takes the first row and the set of components, and private columns
    never enter it. Dates that are none become null, numbers that are none 0, a missing text is empty; grp is null if make or
    model is. Null and blank ids are no complaints. Of rows equal in c01 the smallest in the other columns is taken.
    """
    t = F.upper(trimmed("c21"))
    rows = raw.where(t.isin(CONSUMER_TYPES) & (F.upper(trimmed("c46")) == VEHICLE) & (trimmed("c02") != ""))
    one = rows.groupBy(trimmed("c02").alias("odino")).agg(F.min(F.struct(*_KEPT)).alias("r"), F.array_sort(F.collect_set("c12")).alias("compdesc_list")).select("odino", "compdesc_list", "r.*")
    make, model = F.upper(trimmed("c04")), F.upper(trimmed("c05"))
    ldate = F.try_to_date(trimmed("c17"), "yyyyMMdd")
    return one.select(
        "odino", make.alias("make"), model.alias("model"), F.upper(trimmed("c06")).alias("year"), ldate.alias("ldate"), F.try_to_date(trimmed("c16"), "yyyyMMdd").alias("datea"), (F.upper(trimmed("c07")) == "Y").alias("crash"), (F.upper(trimmed("c09")) == "Y").alias("fire"),
        F.coalesce(F.col("c10").try_cast("int"), F.lit(0)).alias("injured"), F.coalesce(F.col("c11").try_cast("int"), F.lit(0)).alias("deaths"), F.coalesce("c20", F.lit("")).alias("text"), F.upper(trimmed("c21")).alias("cmpl_type"), "compdesc_list", F.concat(make, F.lit("|"), model).alias("grp"), F.trunc(ldate, "MM").alias("month"),
    )


SQL = f"""
with f as (
  select *, row_number() over (partition by trim(c02) order by c01) as rn from complaints_raw
  where upper(trim(c21)) in ({', '.join(f"'{t}'" for t in CONSUMER_TYPES)}) and upper(trim(c46)) = '{VEHICLE}' and nullif(trim(c02), '') is not null
), l as (select trim(c02) as k, coalesce(list_sort(list(distinct c12) filter (where c12 is not null)), []) as compdesc_list from f group by 1)
select trim(c02) as odino, upper(trim(c04)) as make, upper(trim(c05)) as model, upper(trim(c06)) as year,
  case when regexp_matches(trim(c17), '^[0-9]{{8}}$') then cast(try_strptime(trim(c17), '%Y%m%d') as date) end as ldate, cast(try_strptime(trim(c16), '%Y%m%d') as date) as datea, upper(trim(c07)) = 'Y' as crash, upper(trim(c09)) = 'Y' as fire,
  coalesce(try_cast(c10 as integer), 0) as injured, coalesce(try_cast(c11 as integer), 0) as deaths, coalesce(c20, '') as text, upper(trim(c21)) as cmpl_type, compdesc_list,
  upper(trim(c04)) || '|' || upper(trim(c05)) as grp, cast(date_trunc('month', case when regexp_matches(trim(c17), '^[0-9]{{8}}$') then try_strptime(trim(c17), '%Y%m%d') end) as date) as month
from f join l on trim(c02) = k where rn = 1
"""
