"""Redaction, excerpts, citations and checks of generated text (T3-T7, T9, T11-T16, T18, J10, O8, U3, U4), as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import trimmed

# The default patterns of this library, a parameter everywhere: name, pattern, placeholder. Ends are looked at with classes
# of ASCII letters, so an identifier next to a Hangul letter is found too.
PATTERNS: list[tuple[str, str, str]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]"),
    ("vin", r"(?:^|[^A-Za-z0-9])[A-HJ-NPR-Za-hj-npr-z0-9]{11}[0-9]{6}(?:$|[^A-Za-z0-9])", " [vin] "),
    ("phone", r"(?:\+?1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", "[phone]"),
    ("self_name", r"[Mm]y name is [A-Z][a-z]+(?: [A-Z][A-Za-z.]*)*", "[name]"),
]


def collapsed(c: Column) -> Column:
    """One blank for each run of blanks and line breaks, none outside."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def redacted(c: Column, patterns: Sequence[tuple[str, str, str]] = PATTERNS, limit: int | None = None) -> Column:
    """The text with each pattern's placeholder, in order, then cut at limit (None: whole). Null stays null."""
    out = collapsed(c)
    for _, pattern, placeholder in patterns:
        out = F.regexp_replace(out, pattern, placeholder)
    out = collapsed(out)
    return out if limit is None else F.substring(out, 1, limit)


def match_names(c: Column, patterns: Sequence[tuple[str, str, str]] = PATTERNS) -> Column:
    """The names of the patterns that a text holds, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(collapsed(c).rlike(p), F.lit(n)) for n, p, _ in patterns])))


def split_sentences(c: Column) -> Column:
    """The parts of a text behind a stop and a blank; an abbreviation of single letters (U.S.) and a number don't end one."""
    return F.filter(F.transform(F.split(F.regexp_replace(collapsed(c), r"([^ .][^ .][.!?。！？]+[\"”’)]*) +", "$1\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def public_excerpt(c: Column, patterns: Sequence[tuple[str, str, str]] = PATTERNS, limit: int | None = 520, withheld: str = "[withheld]") -> Column:
    """The text with a fixed mark for each sentence that holds a pattern, cut at limit characters (None: whole)."""
    def one(s: Column) -> Column:
        hit = F.lit(False)
        for _, p, _ in patterns:
            hit = hit | s.rlike(p)
        return F.when(hit, F.lit(withheld)).otherwise(s)

    out = F.concat_ws(" ", F.transform(split_sentences(c), one))
    return out if limit is None else F.substring(out, 1, limit)


def known_values(raw: DataFrame, ids: DataFrame, columns: Sequence[str] = ("c13", "c15", "c41", "c42", "c43", "c51")) -> DataFrame:
    """odino and known: the private values of all raw rows of each asked id, the longest first; ids without any have an empty list."""
    wanted = ids.select(F.col("odino").alias("_id")).distinct()
    rows = raw.select(trimmed("c02").alias("_c02"), F.array_compact(F.array(*[F.nullif(trimmed(c), F.lit("")) for c in columns])).alias("_v")).join(wanted, F.col("_c02") == F.col("_id"), "left_semi")
    sets = rows.select("_c02", F.explode("_v").alias("v")).distinct().groupBy("_c02").agg(F.array_sort(F.collect_list(F.struct((-F.length("v")).alias("l"), F.lower("v").alias("k"), "v"))).alias("s"))
    return wanted.join(sets, F.col("_id") == F.col("_c02"), "left").select(F.col("_id").alias("odino"), F.coalesce(F.transform("s", lambda x: x["v"]), F.array().cast("array<string>")).alias("known"))


def deny(c: Column, known: Column, placeholder: str = "[known]") -> Column:
    """The text with each known value, the longest first, replaced wherever no ASCII letter or digit is next to it, in any case.

    Rows without a known value take no pattern at all: a pattern by row is compiled by row.
    """
    quoted = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])(?:"), F.array_join(F.transform(known, lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), "|"), F.lit(")(?![A-Za-z0-9])"))
    return F.when(F.size(known) > 0, F.regexp_replace(c, quoted, F.lit(placeholder))).otherwise(c)


def citations(c: Column) -> Column:
    """The ids cited as #digits, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"#([0-9]+)"), F.lit(1)))


def statistics_sentence(n: Column, baseline: Column, month: Column) -> Column:
    return F.format_string("%s: %d reports against a baseline of %.2f (%.2f times).", F.date_format(month, "yyyy-MM"), n, baseline, n / baseline)


def checked(df: DataFrame, text: str, supplied: str, excluded: str, forbidden: str, patterns: Sequence[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """df with error: the first reason that a generated text can't be used, or null.

    empty, sensitive (a pattern), forbidden (the expression), outside (cites an id not supplied), excluded (cites an excluded
    one), uncited (a sentence without a citation). Ids are compared as text; null lists are empty.
    """
    none = F.array().cast("array<string>")
    cited, ok, out = citations(F.col(text)), F.coalesce(F.col(supplied), none), F.coalesce(F.col(excluded), none)
    body = collapsed(F.coalesce(F.col(text), F.lit("")))
    error = (
        F.when(body == "", "empty")
        .when(F.size(match_names(body, patterns)) > 0, "sensitive")
        .when(body.rlike(forbidden), "forbidden")
        .when(F.size(F.array_except(cited, ok)) > 0, "outside")
        .when(F.arrays_overlap(cited, out), "excluded")
        .when(F.exists(split_sentences(body), lambda s: ~s.rlike("#[0-9]+")), "uncited")
    )
    return df.withColumn("error", error)


def label_errors(summary: Column, source: Column, quote: Column, primary: Column, secondary: Column, categories: Sequence[str], patterns: Sequence[tuple[str, str, str]] = PATTERNS) -> Column:
    """All codes of what is wrong with a label, in fixed order: category, secondary, quote, summary, privacy."""
    tests = {
        "category": ~F.coalesce(primary.isin(*categories), F.lit(False)),
        "secondary": (F.size(F.array_distinct(secondary)) < F.size(secondary)) | (F.size(secondary) > 2) | F.array_contains(secondary, primary),
        "quote": (F.length(quote) > 200) | (F.instr(source, quote) == 0),
        "summary": ~F.length(summary).between(1, 40),
        "privacy": F.size(match_names(summary, patterns)) > 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(k in ("summary",))), F.lit(k)) for k, t in tests.items()]))


