"""Spans that a quote can be chosen from, and how a quote stands in its source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cover(text: str, most: int = 200) -> list[tuple[int, int]]:
    """Begin and end of spans of at most so many characters that hold all of a text but blanks; cut behind a stop or a blank where there is one."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = min(at + most, len(text))
        if end < len(text):
            part = text[at:end]
            stops = [m.end() for m in re.finditer(r"[.!?;。！？]+(?=\s|$)", part)]
            blank = max(part.rfind(" "), part.rfind("\n"))
            end = at + (stops[-1] if stops else blank if blank > 0 else most)
        out.append((at, at + len(text[at:end].rstrip())))
        at = end
    return out


def spans(df: DataFrame, id: str, text: str, most: int = 200) -> DataFrame:
    """id, start (from 1), quote: the spans of each text, which are exact parts of it. Null and empty texts have none."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, a + 1, t[a:z]) for i, t in zip(b[id], b[text]) if t for a, z in cover(t, most)], columns=[id, "start", "quote"])

    return df.select(id, text).mapInPandas(of, f"`{id}` {df.schema[id].dataType.simpleString()}, start int, quote string")


def diagnosed(df: DataFrame, source: str, quote: str) -> DataFrame:
    """df with verbatim, in_any_case (blanks and case aside) and common: the length of the longest part of quote that source holds.

    Where the quote is verbatim its length is the answer; the others are compared in Arrow batches.
    """
    def plain(c: str) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    @F.pandas_udf("int")
    def longest(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size for x, y in zip(a, b)])

    rows = df.withColumn("verbatim", F.coalesce(F.instr(F.col(source), F.col(quote)) > 0, F.lit(False)))
    rows = rows.withColumn("in_any_case", F.coalesce(F.contains(plain(source), plain(quote)), F.lit(False)))
    open_ = F.when(~F.col("verbatim"), F.col(quote))
    return rows.withColumn("common", F.when(F.col("verbatim"), F.length(quote)).otherwise(longest(F.col(source), open_)))


def verbatim_summary(quotes: Column, ids: Column, supplied: Column) -> Column:
    """One to three supplied quotes with their ids, each once; null for any other number or an id that isn't supplied."""
    ok = (F.size(ids).between(1, 3)) & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(ids, supplied)) == 0) & (F.size(ids) == F.size(quotes))
    return F.when(ok, F.array_join(F.zip_with(quotes, ids, lambda q, i: F.concat(F.lit('"'), q, F.lit('" (#'), i, F.lit(")"))), " "))
