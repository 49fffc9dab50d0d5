"""Problems 1 and 2 of TESTDATA.md over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.operators.parsing import FIELDS, check_rows, parse_lines
from tidewatch.operators.trailing import trailing_totals
from tidewatch.sources.tables import read

SERIES = ["label_run", "grp", "category"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected records of both tables, each with the first reason that holds."""
    late = parse_lines(read(spark, sf_dir, "complaint_lines"), "line_id", "line", with_fields=False)
    raw = check_rows(read(spark, sf_dir, "complaints_raw"))
    both = late.select(F.lit("complaint_lines").alias("source_table"), "row_key", "reason").unionByName(raw.select(F.lit("complaints_raw").alias("source_table"), "row_key", "reason"))
    return both.where("reason is not null")


def typed(rows: DataFrame) -> DataFrame:
    """Columns c01..c51 as a typed complaint row."""
    make, model, ldate = F.upper(V.filled("c04")), F.upper(V.filled("c05")), V.day("c17")
    columns: dict[str, Column] = {
        "odino": V.complaint_id("c02"), "make": make, "model": model, "year": V.filled("c06"), "ldate": ldate, "datea": V.day("c16"), "faildate": V.day("c08"),
        "crash": V.yes("c07"), "fire": V.yes("c09"), "injured": V.whole("c10"), "deaths": V.whole("c11"), "compdesc": V.component("c12"), "text": F.coalesce("c20", F.lit("")),
        "cmpl_type": F.upper(V.filled("c21")), "product": F.upper(V.filled("c46")), "grp": F.concat(make, F.lit("|"), model), "month": F.trunc(ldate, "MM"),
    }
    return rows.select("source_table", "row_key", *(c.alias(n) for n, c in columns.items()))


def p1_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other record of both tables as a typed complaint row."""
    late = parse_lines(read(spark, sf_dir, "complaint_lines"), "line_id", "line").where("reason is null")
    raw = check_rows(read(spark, sf_dir, "complaints_raw"), keep=tuple(FIELDS)).where("reason is null")
    return typed(late.withColumn("source_table", F.lit("complaint_lines")).unionByName(raw.withColumn("source_table", F.lit("complaints_raw"))))


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_totals(read(spark, sf_dir, "aggregated_kw"), SERIES, ["label_run"], (3, 12))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of each series without a reported n."""
    return _trailing(spark, sf_dir).where("not reported").select(*SERIES, F.date_format("month", "yyyy-MM").alias("month"))


def p2_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of n over the trailing 3 and 12 months, for every month of every series."""
    return _trailing(spark, sf_dir).withColumn("month", F.date_format("month", "yyyy-MM")).drop("reported")


#: A field of a line: quoted by the rule, or unquoted.
_Q = r'"(?:[^"]|"")*"'
_U = r'(?:[^"\t][^\t]*)?'
P1_FOUND = rf"""
with l as (
  select cast(line_id as varchar) as row_key, coalesce(line, '') as line,
    not regexp_matches(coalesce(line, ''), '\A(?:{_Q}|{_U})(?:\t(?:{_Q}|{_U}))*\z') as quoting,
    regexp_replace(chr(9) || coalesce(line, ''), '\t{_Q}', chr(9), 'g') as bare
  from complaint_lines
), f as (
  select row_key, quoting, length(bare) - length(replace(bare, chr(9), '')) as fields,
    regexp_extract(line, '\A(?:(?:{_Q}|{_U})\t){{16}}({_Q}|{_U})', 1) as c17,
    regexp_extract(line, '\A(?:(?:{_Q}|{_U})\t){{19}}({_Q}|{_U})', 1) as c20
  from l
), r as (
  select 'complaint_lines' as source_table, row_key, quoting, fields, trim(c17, '"') as c17, c20 from f
  union all
  select 'complaints_raw', c01, false, 51, coalesce(c17, ''), coalesce(c20, '') from complaints_raw
), s as (select *, regexp_replace(c17, '\A[\s\p{{Z}}]+|[\s\p{{Z}}]+\z', '', 'g') as d from r),
reasons as (
  select source_table, row_key, case
    when quoting then 'quoting' when fields <> 51 then 'field_count'
    when d <> '' and (not regexp_matches(d, '\A[0-9]{{8}}\z') or try_strptime(d, '%Y%m%d') is null) then 'received_date'
    when regexp_matches(c20, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{fffd}}]') then 'narrative' end as reason
  from s
)
select source_table, row_key, reason from reasons where reason is not null
"""
_P2 = """
with r as (
  select label_run, grp, category, year(month) * 12 + month(month) - 1 as m, n, loaded_at from aggregated_kw where month is not null
), c as (
  select label_run, grp, category, m, count(n) as given, coalesce(arg_max(coalesce(n, -1), (loaded_at, coalesce(n, -1))), -1) as latest from r group by all
), e as (select label_run, max(m) as last from r group by all),
s as (select label_run, grp, category, min(m) as first from r group by all),
g as (select s.label_run, grp, category, unnest(range(first, last + 1)) as m from s join e on s.label_run = e.label_run),
t as (
  select g.label_run, g.grp, g.category, g.m, coalesce(greatest(latest, 0), 0) as n, coalesce(given, 0) > 0 as reported
  from g left join c on g.label_run = c.label_run and g.grp = c.grp and g.category = c.category and g.m = c.m
), o as (
  select label_run, grp, category, strftime(make_date(cast(m // 12 as int), cast(m % 12 + 1 as int), 1), '%Y-%m') as month, n, reported,
    sum(n) over (w rows between 2 preceding and current row) as total_3, sum(n) over (w rows between 11 preceding and current row) as total_12
  from t window w as (partition by label_run, grp, category order by m)
)
"""
SQL = {
    "p1_found": P1_FOUND,
    "p2_found": _P2 + "select label_run, grp, category, month from o where not reported",
    "p2_trailing": _P2 + "select label_run, grp, category, month, cast(n as bigint) as n, cast(total_3 as bigint) as total_3, total_3 / 3 as avg_3, cast(total_12 as bigint) as total_12, total_12 / 12 as avg_12 from o",
}
QUERIES = {"p1_found": p1_found, "p1_accepted": p1_accepted, "p2_found": p2_found, "p2_trailing": p2_trailing}
