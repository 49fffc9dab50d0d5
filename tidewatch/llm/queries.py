"""Problems 3 to 10 of TESTDATA.md over their whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import lookalike, packing, sample, sentences, survivor, tokens, truncation
from tidewatch.llm.pii import spans
from tidewatch.sources.tables import read


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all odino: the table as the first batch of a ledger."""
    return sample.sample_batch(read(spark, sf_dir, "complaints"), None).where("chosen").select("odino")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """odino, field and value of complaints.text and labels_llm.summary_ko."""
    texts = read(spark, sf_dir, "complaints").select("odino", F.lit("text").alias("field"), F.col("text").alias("value"))
    return texts.unionByName(read(spark, sf_dir, "labels_llm").select("odino", F.lit("summary_ko").alias("field"), F.col("summary_ko").alias("value")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.kinds(spans.with_spans(fields(spark, sf_dir), "value", ["odino", "field"]), ["odino", "field"])


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts and summaries with typed placeholders."""
    return spans.masked(spans.with_spans(fields(spark, sf_dir), "value", ["odino", "field"]), "value").drop("spans")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(fields(spark, sf_dir), "value", ["odino", "field"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "complaints").select(F.lit("complaints").alias("source_table"), F.col("odino").alias("row_key"), F.col("cmpl_type").alias("kind"), F.col("text").alias("value"))
    return texts.unionByName(read(spark, sf_dir, "evidence").select(F.lit("evidence").alias("source_table"), F.col("evidence_id").cast("string").alias("row_key"), F.col("label_source").alias("kind"), F.col("snippet").alias("value")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(_records(spark, sf_dir)).where("cut").select("source_table", "row_key").distinct()


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut records per cmpl_type of complaints and per label_source of evidence."""
    return truncation.report(_records(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.component_source(read(spark, sf_dir, "complaints_raw"))


def p7_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.merged(read(spark, sf_dir, "complaints_raw"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read(spark, sf_dir, "documents"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))[0]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of which the packing has a second piece."""
    return p9_packed(spark, sf_dir).where("part = 1").select("doc_id")


def p9_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """containers, those fixed by dominance, the least number possible, and the unused share of all room."""
    boxes, figures = packing.packed(read(spark, sf_dir, "documents"))
    room = F.lit(figures["containers"] * packing.CAPACITY)
    return boxes.agg(F.sum("tokens").alias("tokens"), F.countDistinct("container").alias("containers"), F.lit(figures["fixed"]).alias("fixed"), F.lit(figures["least"]).alias("least"), (1 - F.sum("tokens") / room).alias("unused"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.pairs(read(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.classes(read(spark, sf_dir, "documents")).drop("own")


def p10_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.with_form(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "form")


_ID = r"""
  regexp_replace(regexp_replace(regexp_replace(translate(c02, '０１２３４５６７８９', '0123456789'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\.0+$', ''), '[^0-9]', '', 'g')"""
_P7 = rf"""
with r as (
  select {_ID} as d, c01, c12, trim(c16) as added,
    regexp_replace(upper(c12), '[^\p{{L}}\p{{N}}]', '', 'g') as bare from complaints_raw
), i as (
  select case when length(d) > 8 and regexp_matches(d, '^0+[0-9]{{8}}$') then right(d, 8) when length(d) < 8 then lpad(d, 8, '0') else d end as odino, c01, added,
    c12 is not null and bare not in ('', 'NULL', 'NONE', 'NIL', 'NA', 'NOTAVAILABLE', 'NOTAPPLICABLE', 'UNKNOWN', 'UNK', 'TBD', 'UNSPECIFIED') as named
  from r where d <> ''
)
select odino, arg_max(c01, (added, cast(c01 as hugeint))) filter (where named) as c01 from i group by odino having count(*) > 1 and count(*) filter (where named) > 0
"""
SQL = {"p7_found": _P7}
QUERIES = {f.__name__: f for f in (p3_sample, p4_found, p4_masked, p5_found, p6_found, p6_share, p7_found, p7_merged, p8_ids, p9_found, p9_packed, p9_figures, p10_found, p10_classes, p10_form)}
