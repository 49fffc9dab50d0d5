"""Queries of text, label and set operators over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.values import trimmed
from tidewatch.operators import labels as L
from tidewatch.operators import text as T
from tidewatch.plans import monitor as M
from tidewatch.sources.tables import read

SEED = "seed42:"


def privacy_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complaints").select("odino", T.redacted(F.col("text")).alias("text")).distinct()


def privacy_match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complaints").select("odino", F.concat_ws(",", T.match_names(F.col("text"))).alias("names")).where("names <> ''").distinct()


def public_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of all evidence texts; the limit of 520 characters is the feature."""
    return read(spark, sf_dir, "complaints").select("odino", T.public_excerpt(F.col("text")).alias("excerpt")).distinct()


def sentence_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that each document cites as #digits, and the number of its sentences."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat_ws(",", T.citations(F.col("text"))).alias("cited"))


def known_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The private values of all raw rows of each complaint, the longest first; an empty list where there are none."""
    ids = read(spark, sf_dir, "complaints").select("odino")
    return T.known_values(read(spark, sf_dir, "complaints_raw"), ids).select("odino", F.concat_ws("|", "known").alias("known"))


def denied_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which a known value of their own complaint was replaced."""
    ids = read(spark, sf_dir, "complaints").select("odino")
    known = T.known_values(read(spark, sf_dir, "complaints_raw"), ids)
    rows = read(spark, sf_dir, "complaints").select("odino", "text").distinct().join(known, "odino")
    return rows.select("odino", T.deny(F.col("text"), F.col("known")).alias("denied"), "text").where("denied <> text").drop("text")


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.length(T.collapsed(F.col("text"))).alias("length"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 complaints that come first by the hash of seed and id (O5); the number is the feature."""
    ids = read(spark, sf_dir, "complaints").select("odino").distinct()
    return ids.orderBy(F.sha2(F.concat(F.lit(SEED), "odino"), 256), "odino").limit(60)


def second_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 more by another seed, of those not in the first."""
    ids = read(spark, sf_dir, "complaints").select("odino").distinct().join(hash_sample(spark, sf_dir), "odino", "left_anti")
    return ids.orderBy(F.sha2(F.concat(F.lit("second-1:"), "odino"), 256), "odino").limit(30)


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complaints").select("odino", "grp", "ldate").distinct().orderBy("odino").limit(5)


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of early and of late receipts, once each."""
    rows = read(spark, sf_dir, "complaints").select("odino", "text", "ldate")
    return rows.where("ldate < date '2018-06-01'").select("odino", "text").union(rows.where("ldate >= date '2018-01-01'").select("odino", "text")).distinct()


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints without a label."""
    return read(spark, sf_dir, "complaints").select("odino", "grp").distinct().join(read(spark, sf_dir, "labels_llm").select("odino"), "odino", "left_anti")


def label_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good labels with their distinct categories and the number of hazards."""
    hazards = ["hazard_fire", "hazard_smoke", "hazard_crash", "hazard_injury", "hazard_while_driving", "hazard_while_parked_or_charging"]
    rows = read(spark, sf_dir, "labels_llm").where("status = 'ok'").distinct()
    categories = F.array_distinct(F.concat(F.array("primary_category"), F.coalesce("secondary_categories", F.array().cast("array<string>"))))
    return rows.select("odino", F.concat_ws(",", categories).alias("categories"), sum((F.coalesce(F.col(h), F.lit(False)).cast("int") for h in hazards), F.lit(0)).alias("hazards"), "severity")


def labeler_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of complaints with both labels, how many agree in the first category, by the group of it."""
    llm = read(spark, sf_dir, "labels_llm").where("status = 'ok'").select("odino", "primary_category").distinct()
    return M.labels(spark, sf_dir).join(llm, "odino").groupBy("primary_category").agg(F.count("*").alias("n"), F.count_if(F.col("primary") == F.col("primary_category")).alias("agree"))


def cache_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by whether their key is the hash of their parts, and why not."""
    rows = read(spark, sf_dir, "labels_llm").distinct()
    key = F.sha2(F.concat_ws("|", "odino", "model", "prompt_hash", "input_hash"), 256)
    ids = read(spark, sf_dir, "complaints").select("odino").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("there").isNull(), "unknown id").when(F.col("status") != "ok", "failed").when(F.col("cache_key").isNull() | (F.length("cache_key") != 64), "no key").when(F.col("cache_key") == key, "valid").otherwise("other key")
    return rows.join(ids, "odino", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with labels, by code."""
    rows = read(spark, sf_dir, "labels_llm").where("status = 'ok'").distinct()
    codes = T.label_errors(F.col("summary_ko"), F.col("summary_ko"), F.col("summary_ko"), F.col("primary_category"), F.col("secondary_categories"), L.CATEGORIES)
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def brief_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a document of kind brief can't be used as it stands."""
    rows = read(spark, sf_dir, "documents").where("doc_kind = 'brief'").select("doc_id", "text", T.citations(F.col("text")).alias("supplied"), F.array().cast("array<string>").alias("excluded"))
    return T.checked(rows, "text", "supplied", "excluded", "defect confirmed|is guilty").select("doc_id", F.coalesce("error", F.lit("none")).alias("error"))


def statistics_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.detections(spark, sf_dir).where("alert")
    return rows.select("grp", "category", "month", T.statistics_sentence(F.col("n"), F.col("baseline"), F.col("month")).alias("sentence"))


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records with a flag whose month holds their received date."""
    rows = read(spark, sf_dir, "evidence").where("(fire or crash or injured > 0) and ldate >= trunc(month, 'MM') and ldate < add_months(trunc(month, 'MM'), 1)")
    return rows.groupBy("grp", "category", F.trunc("month", "MM").alias("month")).agg(F.count_distinct("odino").alias("n"))


def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group, how many complaints are cited by keyword, by the labeler, by both and by either."""
    sets = read(spark, sf_dir, "evidence").groupBy("grp", "odino").agg(F.max(F.col("label_source") == "keyword").alias("k"), F.max(F.col("label_source") == "llm").alias("l"))
    return sets.groupBy("grp").agg(F.count_if("k").alias("keyword"), F.count_if("l").alias("llm"), F.count_if(F.col("k") & F.col("l")).alias("both"), F.count("*").alias("either"))


def event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a ledger by type and day, and the share of rows with a value."""
    return read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("with_value"))


def tolerant_parse_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the values of the raw table read: dates, numbers and components (F2, A1)."""
    rows = read(spark, sf_dir, "complaints_raw")
    d = F.try_to_date(F.when(trimmed("c17").rlike("^[0-9]{8}$"), trimmed("c17")), "yyyyMMdd")
    return rows.agg(F.count("*").alias("n"), F.count(d).alias("dates"), F.count(F.col("c10").try_cast("int")).alias("injured"), F.count_if(trimmed("c12") == "").alias("blank_components"), F.count_distinct(trimmed("c02")).alias("ids"))


_BLANK = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))"


def _redact(c: str) -> str:
    for _, p, r in T.PATTERNS:
        c = f"regexp_replace({c}, '{p}', '{r}', 'g')"
    return f"trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g'))"


_NAMES = "list_sort(list_filter([" + ", ".join(f"case when regexp_matches({_BLANK}, '{p}') then '{n}' end" for n, p, _ in T.PATTERNS) + "], lambda x: x is not null))"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_BLANK}, '([^ .][^ .][.!?。！？]+[\"”’)]*) +', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
_HIT = " or ".join(f"regexp_matches(s, '{p}')" for _, p, _ in T.PATTERNS)
_CITED = "list_distinct(regexp_extract_all(text, '#([0-9]+)', 1))"
_KNOWN = "select trim(c02) as k, trim(v) as v from (select c02, unnest([c13, c15, c41, c42, c43, c51]) as v from complaints_raw) where nullif(trim(v), '') is not null"
_SAMPLE = f"select odino from (select distinct odino from complaints) order by sha256('{SEED}' || odino), odino limit 60"
SQL = {
    "privacy_redaction": f"select distinct odino, {_redact(_BLANK)} as text from complaints",
    "privacy_match_names": f"select distinct odino, array_to_string({_NAMES}, ',') as names from complaints where len({_NAMES}) > 0",
    "public_excerpt": f"select distinct odino, substring(array_to_string(list_transform({_SENTENCES}, lambda s: case when {_HIT} then '[withheld]' else s end), ' '), 1, 520) as excerpt from complaints",
    "known_identifiers": f"with v as (select distinct k, v from ({_KNOWN})) select odino, coalesce(string_agg(v, '|' order by length(v) desc, lower(v), v), '') as known from (select distinct odino from complaints) left join v on k = odino group by odino",
    "plain_text": f"select doc_id, length({_BLANK}) as length from documents",
    "hash_sample": _SAMPLE,
    "second_sample": f"select odino from (select distinct odino from complaints where odino not in ({_SAMPLE})) order by sha256('second-1:' || odino), odino limit 30",
    "first_ids": "select distinct odino, grp, ldate from complaints order by odino limit 5",
    "union_distinct": "select odino, text from complaints where ldate < date '2018-06-01' union select odino, text from complaints where ldate >= date '2018-01-01'",
    "coverage_gap": "select distinct odino, grp from complaints c where not exists (select 1 from labels_llm l where l.odino = c.odino)",
    "label_flatten": """with r as (select distinct * from labels_llm where status = 'ok'), u as (select odino, severity, list_concat([primary_category], coalesce(secondary_categories, [])) as a,
      cast(coalesce(hazard_fire, false) as int) + cast(coalesce(hazard_smoke, false) as int) + cast(coalesce(hazard_crash, false) as int) + cast(coalesce(hazard_injury, false) as int) + cast(coalesce(hazard_while_driving, false) as int) + cast(coalesce(hazard_while_parked_or_charging, false) as int) as hazards from r)
      select odino, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') as categories, hazards, severity from u""",
    "labeler_agreement": f"with {M._LABELS}, l as (select distinct odino, primary_category from labels_llm where status = 'ok') select primary_category, count(*) as n, count(*) filter (where prim = primary_category) as agree from lab join l on lab.odino = l.odino group by all",
    "cache_validation": """select case when c.odino is null then 'unknown id' when status <> 'ok' then 'failed' when cache_key is null or length(cache_key) <> 64 then 'no key'
      when cache_key = sha256(l.odino || '|' || model || '|' || prompt_hash || '|' || input_hash) then 'valid' else 'other key' end as state, count(*) as n
      from (select distinct * from labels_llm) l left join (select distinct odino from complaints) c on l.odino = c.odino group by all""",
    "evidence_flags": "select grp, category, cast(date_trunc('month', month) as date) as month, count(distinct odino) as n from evidence where (fire or crash or injured > 0) and ldate >= date_trunc('month', month) and ldate < date_trunc('month', month) + interval 1 month group by all",
    "evidence_sets": "with s as (select grp, odino, bool_or(label_source = 'keyword') as k, bool_or(label_source = 'llm') as l from evidence group by all) select grp, count(*) filter (where k) as keyword, count(*) filter (where l) as llm, count(*) filter (where k and l) as both, count(*) as either from s group by grp",
    "event_usage": "select event_type, cast(ts as date) as day, count(*) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean, count(value) as with_value from events group by all",
    "tolerant_parse_profile": "select count(*) as n, count(try_strptime(case when regexp_matches(trim(c17), '^[0-9]{8}$') then trim(c17) end, '%Y%m%d')) as dates, count(try_cast(c10 as integer)) as injured, count(*) filter (where trim(c12) = '') as blank_components, count(distinct trim(c02)) as ids from complaints_raw",
    "statistics_sentences": f"with {M._SCORED} select grp, category, month, strftime(month, '%Y-%m') || printf(': %d reports against a baseline of %.2f (%.2f times).', cast(n as bigint), baseline, n / baseline) as sentence from det where alert",
    "sentence_citations": f"select doc_id, array_to_string(list_filter(regexp_extract_all(text, '#([0-9]+)', 1), lambda x, i: list_position(regexp_extract_all(text, '#([0-9]+)', 1), x) = i), ',') as cited from documents where text is not null",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in SQL or k in ("denied_texts", "label_check", "brief_check")}
