"""Queries about alerts as they are reviewed: comparison of labelers, inputs of briefs, spans and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import counting as C
from tidewatch.operators import evidence as E
from tidewatch.operators import quotes
from tidewatch.plans import monitor as M
from tidewatch.sources.tables import read


def labeler_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in which two labelers count differently on the complaints that both have labelled."""
    llm = read(spark, sf_dir, "labels_llm").where("status = 'ok'").groupBy("odino").agg(F.min(F.struct(F.col("primary_category").alias("primary"), F.col("secondary_categories").alias("secondary"))).alias("l")).select("odino", "l.*")
    both = read(spark, sf_dir, "complaints").join(llm.select("odino"), "odino", "left_semi")
    a, b = C.dense_grid(both, M.labels(spark, sf_dir)), C.dense_grid(both, llm).withColumnRenamed("n", "n_llm").drop("total")
    return a.join(b, ["grp", "category", "month"]).where("n <> n_llm").select("grp", "category", "month", "n", "n_llm", "total")


def alert_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert cells with their count and the number of records found for them, which must be the same."""
    found = M._evidence(spark, sf_dir).groupBy("grp", "category", "month").agg(F.count("*").alias("records"))
    return M.detections(spark, sf_dir).where("alert").join(found, ["grp", "category", "month"], "left").select("grp", "category", "month", "n", F.coalesce("records", F.lit(0)).alias("records"))


def brief_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each alert cell, the ids of its evidence in order of weight, and a hash that changes with any of them."""
    rows = E.top(M._evidence(spark, sf_dir), ["grp", "category", "month"], E.severity_order(), None)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "odino"))), lambda x: x["odino"])
    packed = rows.groupBy("grp", "category", "month").agg(F.concat_ws(",", ids).alias("ids"))
    return packed.select("grp", "category", "month", F.sha2(F.concat_ws("|", "grp", "category", F.date_format("month", "yyyy-MM"), "ids"), 256).alias("input_hash"))


def reveal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group, the first case by id that it belongs to."""
    cases = M.pool(spark, sf_dir).where("arm = 'case'").select("id", F.explode("groups").alias("grp"))
    return cases.groupBy("grp").agg(F.min("id").alias("case_id"))


def month_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that were added only after their month was taken as known, by month."""
    late = F.col("datea") >= F.add_months(F.trunc("ldate", "MM"), 1)
    return read(spark, sf_dir, "complaints").where("ldate is not null").select("odino", F.trunc("ldate", "MM").alias("month"), late.alias("late")).distinct().groupBy("month").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


def source_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of at most 200 characters that cover each complaint's text, with exact places."""
    return quotes.spans(read(spark, sf_dir, "complaints").select("odino", "text").distinct(), "odino", "text")


def quote_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each evidence snippet stands in its complaint's text."""
    texts = read(spark, sf_dir, "complaints").select("odino", "text").distinct()
    rows = read(spark, sf_dir, "evidence").where("snippet is not null").select("evidence_id", "odino", "snippet").join(texts, "odino")
    return quotes.diagnosed(rows, "text", "snippet").select("evidence_id", "verbatim", "in_any_case", "common").distinct()


_LLM_GRID = M._grid_sql().replace(M._LABELS, """
one as (select distinct on (odino) * from complaints order by odino),
ll as (select distinct on (odino) odino, primary_category as p, secondary_categories as s from labels_llm where status = 'ok' order by odino),
lab as (select one.*, list_distinct(list_concat([p], coalesce(s, []))) as cats from one join ll on one.odino = ll.odino)""")
_KW_GRID = M._grid_sql().replace("where ldate is not null and grp", "where odino in (select odino from labels_llm where status = 'ok') and ldate is not null and grp")
SQL = {
    "labeler_cells": f"with a as (with {_KW_GRID} select * from grid), b as (with {_LLM_GRID} select * from grid) select a.grp, a.category, a.month, a.n, b.n as n_llm, a.total from a join b on a.grp = b.grp and a.category = b.category and a.month = b.month where a.n <> b.n",
    "alert_crosscheck": f"with {M._EVIDENCE}, f as (select grp, category, month, count(*) as records from evi group by all) select det.grp, det.category, det.month, n, coalesce(records, 0) as records from det left join f on det.grp = f.grp and det.category = f.category and det.month = f.month where alert",
    "brief_inputs": f"with {M._EVIDENCE}, bi as (select grp, category, month, string_agg(odino, ',' order by fire desc nulls last, coalesce(injured, 0) > 0 desc nulls last, crash desc nulls last, odino) as ids from evi group by all) select grp, category, month, sha256(grp || '|' || category || '|' || strftime(month, '%Y-%m') || '|' || ids) as input_hash from bi",
    "reveal_lookup": f"with {M._POOL} select grp, min(id) as case_id from (select id, unnest(groups) as grp from pool where arm = 'case') group by grp",
    "month_completeness": "with r as (select distinct odino, cast(date_trunc('month', ldate) as date) as month, datea >= date_trunc('month', ldate) + interval 1 month as late from complaints where ldate is not null) select month, count(*) as n, count(*) filter (where late) as late from r group by month",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL or k in ("source_spans", "quote_diagnostics")}
