"""Problem 7: one record of all rows of a complaint, by skylines of completeness, recency and trust.

A row is a point of three measures, each the better the larger:
  completeness  whether it names a component, then how many fields it fills;
  recency       the day it was added (c16), of one day the row id (c01) as a number: the later delivery;
  trust         how many of its checked values are usable: the received date (c17) and the narrative (c20).
A row dominates another if it is no worse in any measure and better in one. Rows that none dominates are layer 1; without
them, the next layer is 2, and so on. In a layer the policy is lexicographic: names a component, recency, trust, completeness.
The first row of layer 1 by this policy survives; a field that it lacks comes from the next row that fills it, by layer and
policy. The latest row that names a component is dominated by none, so c12 comes from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.operators.parsing import FIELDS

NAMES = FIELDS.index("c12")


def points(raw: DataFrame) -> DataFrame:
    """odino, c01 and the measures of each row that has a complaint id; filled: a bit for each field."""
    def bit(i: int, c: str) -> F.Column:
        there = V.component(c).isNotNull() if c == "c12" else F.col(c).rlike(r"(?U)\S")
        return F.when(there, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")

    filled = sum((bit(i, c) for i, c in enumerate(FIELDS)), F.lit(0).cast("bigint"))
    trust = V.day("c17").isNotNull().cast("int") + (~F.coalesce(F.col("c20"), F.lit("�")).rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F�]")).cast("int")
    recency = F.struct(F.coalesce(V.day("c16"), F.lit("0001-01-01").cast("date")).alias("day"), F.coalesce(F.trim("c01").try_cast("decimal(38,0)"), F.lit(-1)).cast("decimal(38,0)").alias("row"), F.coalesce("c01", F.lit("")).alias("c01"))
    return raw.select(V.complaint_id("c02").alias("odino"), filled.alias("filled"), trust.alias("trust"), recency.alias("recency")).where("odino is not null")


def order(rows: list[tuple[int, int, int]]) -> list[int]:
    """Positions of the rows (filled, trust), given from the latest to the earliest, by layer and policy."""
    size = [((f >> NAMES & 1) << 8) + f.bit_count() for f, _ in rows]
    layer: list[int] = []
    for i, (_, t) in enumerate(rows):  # only an earlier position, that is a later row, can dominate
        layer.append(1 + max((layer[j] for j in range(i) if size[j] >= size[i] and rows[j][1] >= t), default=0))
    return sorted(range(len(rows)), key=lambda i: (layer[i], -(size[i] >> 8), i))


def layered(raw: DataFrame) -> DataFrame:
    """odino, rows, and sources: of each row that gives a field to the record, its c01 and the bits of those fields; survivors first.

    Before a complaint's rows meet, those which fill the same fields with the same trust are reduced to the latest, as the
    others can give nothing: the rest is bounded by the ways to fill the fields, whatever the number of copies. Rows
    without a complaint id have no part; null and empty values are fields that aren't filled; repeated rows change nothing but
    the count; an empty table gives an empty result.
    """
    kinds = points(raw).groupBy("odino", "filled", "trust").agg(F.max("recency").alias("recency"), F.count("*").alias("n"))
    group = kinds.groupBy("odino").agg(F.sum("n").alias("n"), F.collect_list(F.struct("recency", "filled", "trust")).alias("of"))
    of = F.reverse(F.array_sort("of"))
    group = group.select("odino", "n", F.transform(of, lambda x: x["recency"]["c01"]).alias("c01"), F.transform(of, lambda x: x["filled"]).alias("filled"), F.transform(of, lambda x: x["trust"]).alias("trust"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = []
            for ids, filled, trust in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                left, own = -1, []
                for i in order(list(zip(filled, trust))) if len(ids) > 1 else [0]:
                    if gives := filled[i] & left or (0 if own else filled[i]):
                        own.append({"c01": ids[i], "gives": gives})
                        left &= ~filled[i]
                sources.append(own)
            kind = pa.list_(pa.struct([("c01", pa.string()), ("gives", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sources, kind)], ["odino", "rows", "sources"])

    return group.mapInArrow(run, "odino string, rows bigint, sources array<struct<c01: string, gives: bigint>>")


def merged(raw: DataFrame) -> DataFrame:
    """One record per complaint: odino, rows, component, and c01..c51 (without c02), each from the row that the layers give."""
    given = layered(raw).select("odino", "rows", F.posexplode("sources").alias("at", "s")).select("odino", F.when(F.col("at") == 0, F.col("rows")).alias("rows"), "s.c01", "s.gives")
    given = given.withColumnRenamed("c01", "_c01").withColumnRenamed("odino", "_odino")
    rows = raw.select(*FIELDS).dropDuplicates(["c01"]).join(given, F.coalesce("c01", F.lit("")) == F.col("_c01"))
    def field(i: int, c: str) -> F.Column:
        return F.max(F.when(F.col("gives").bitwiseAND(F.lit(1 << i)) != 0, F.col(c))).alias(c)

    out = rows.groupBy(F.col("_odino").alias("odino")).agg(F.max("rows").alias("rows"), *(field(i, c) for i, c in enumerate(FIELDS) if c != "c02"))
    return out.withColumn("component", V.component("c12"))


def component_source(raw: DataFrame) -> DataFrame:
    """odino and c01 of the row that gives c12, of complaints with two rows or more of which one names a component."""
    sources = layered(raw).where("rows > 1").select("odino", F.explode("sources").alias("s"))
    return sources.where(F.col("s.gives").bitwiseAND(F.lit(1 << NAMES)) != 0).select("odino", F.col("s.c01").alias("c01"))
