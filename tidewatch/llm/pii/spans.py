"""Spans of private data as a DataFrame operator; the placeholders and the found kinds come from one table of spans."""

from __future__ import annotations

import functools
import io
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.pii import jvm, model

#: Texts whose windows are put in order of length together, so that batches are even.
CHUNK = 2048
SPANS = "array<struct<begin:int,until:int,kind:string>>"


@functools.cache
def trained() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The parameters, read once in each worker from the package, wherever it lies."""
    p = dict(np.load(io.BytesIO(pkgutil.get_data("tidewatch.llm.pii", "model.npz"))))
    return p, model.inputs(p)


def with_spans(df: DataFrame, text: str, keep: list[str], in_jvm: bool | None = None) -> DataFrame:
    """keep, text and spans (begin from 1, until inclusive, kind) of each row.

    Null and empty texts have no spans. The whole text is read, in overlapping windows whose scores are put together before
    one decoding; rows come out as often as they come in; an empty table gives an empty result. in_jvm: by Tagger.java or by
    model.py, which find the same; None: by Tagger.java where it can run.
    """
    rows = df.select(*keep, F.col(text).alias(text))
    n = len(keep)
    schema = "".join(f"`{c}` {t}, " for c, t in rows.dtypes) + f"spans {SPANS}"
    if jvm.there(df) if in_jvm is None else in_jvm:
        return jvm.with_spans(rows, n, StructType.fromDDL(schema), trained)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("until", pa.int32()), ("kind", pa.string())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, projected = trained()
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                found = model.find(p, [t or "" for t in part.column(n).to_pylist()], projected)
                spans = pa.array([[{"begin": a + 1, "until": b, "kind": x} for a, b, x in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, spans], [*keep, text, "spans"])

    return rows.mapInArrow(of, schema)


def kinds(spanned: DataFrame, keep: list[str]) -> DataFrame:
    """keep and kind: each kind that a row's text holds, once for rows alike in keep."""
    return spanned.select(*keep, F.explode(F.array_distinct(F.transform("spans", lambda s: s["kind"]))).alias("kind")).distinct()


def masked(spanned: DataFrame, text: str) -> DataFrame:
    """spanned with each span of text replaced by its kind in brackets; the rest is left as it is."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a, s):
        cut = F.substring(F.col(text), a["at"], s["begin"] - a["at"])
        return F.struct(F.concat(a["out"], cut, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), (s["until"] + 1).alias("at"))

    whole = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"], F.length(text))))
    return spanned.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text)))
