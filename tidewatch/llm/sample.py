"""Problem 3: a sample that is the same however often and in whatever order it is taken, and that only grows: frozen batch bottom-k."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_BITS = 16


def salted_hash(c: Column | str, salt: str) -> Column:
    """64 bits of the salted value, alike on every machine."""
    return F.xxhash64(F.lit(salt), F.col(c) if isinstance(c, str) else c)


def bottom_k(ids: DataFrame, id: str, batch: str, rate: str | Fraction, salt: str) -> DataFrame:
    """The ceil(rate x size) ids with the smallest salted hashes of each batch; ids holds each id of a batch once.

    No batch is sorted: the ids are counted by the first PREFIX_BITS bits of their hashes, the counts of a batch (at most
    2 ** PREFIX_BITS) are added up, and only the ids of the one prefix that holds the k-th are ranked, equal hashes by id.
    """
    rate = Fraction(rate)
    hashed = ids.withColumn("_h", salted_hash(id, salt)).withColumn("_p", F.shiftrightunsigned("_h", 64 - PREFIX_BITS))
    counts = hashed.groupBy(batch, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(batch)
    counts = counts.select(batch, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_before"), "_c", F.sum("_c").over(w).alias("_n"))
    # Whole numbers only: in doubles 0.07 x 100 is more than 7.
    k = F.expr(f"cast((cast(_n as decimal(20, 0)) * {rate.numerator} + {rate.denominator - 1}) div {rate.denominator} as bigint)")
    counts = counts.withColumn("_k", k).where("_before < _k")
    near = hashed.join(counts, [batch, "_p"])
    sure = near.where("_before + _c <= _k").select(batch, id)
    edge = near.where("_before + _c > _k").withColumn("_r", F.row_number().over(Window.partitionBy(batch, "_p").orderBy(F.expr("_h & 281474976710655"), id)))
    return sure.unionByName(edge.where("_before + _r <= _k").select(batch, id))


def sample_batch(records: DataFrame, ledger: DataFrame | None, id: str = "odino", batch: str = "0", rate: str | Fraction = "0.1", salt: str = "sample-1") -> DataFrame:
    """The ledger of the ids (id, batch, chosen) after records have arrived as the named batch.

    The ids of records that the ledger knows are skipped, so a batch never changes once it is written: exactly ceil(rate x size)
    of its ids are chosen, and stay so. The chosen ids of all batches are the sample; it is append-only. Write the result as the
    next ledger. Repeated rows count once; null ids are no records; the empty table adds nothing; other columns don't matter.
    rate is a decimal string or fraction, so that ceil is exact.
    """
    new = records.select(F.col(id)).where(F.col(id).isNotNull()).distinct()
    if ledger is not None:
        new = new.join(ledger.select(id), id, "left_anti")
    new = new.withColumn("batch", F.lit(batch))
    chosen = bottom_k(new, id, "batch", rate, salt).select(id, F.lit(True).alias("chosen"))
    out = new.join(chosen, id, "left").select(id, "batch", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    return out if ledger is None else ledger.select(id, "batch", "chosen").unionByName(out)
