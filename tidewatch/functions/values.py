"""Tolerant readings of the raw table's text values. None of them fails on null, empty or odd text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What c12 holds, without blanks and marks, where it names no component (fixed values).
NO_COMPONENT = ["", "NULL", "NONE", "NIL", "NA", "NOTAVAILABLE", "NOTAPPLICABLE", "UNKNOWN", "UNK", "TBD", "UNSPECIFIED"]
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Blank characters of Unicode (category Zs).
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(c: Column | str) -> Column:
    """Without outer blank characters; tabs and line breaks stay."""
    return F.trim(col(c), F.lit(BLANKS))


def strip(c: Column | str) -> Column:
    """Without outer blanks of any script."""
    return F.regexp_replace(col(c), r"(?U)\A\s+|\s+\z", "")


def filled(c: Column | str) -> Column:
    """Stripped, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def day(c: Column | str) -> Column:
    """The date of eight ASCII digits yyyyMMdd of a real day, outer blanks aside; else null."""
    s = strip(c)
    return F.when(s.rlike(r"\A[0-9]{8}\z") & ~s.startswith("0000"), F.try_to_date(s, "yyyyMMdd"))


def whole(c: Column | str) -> Column:
    """A whole number, rounded where it has decimals; null where it is none."""
    return F.round(F.trim(col(c)).try_cast("double")).try_cast("int")


def yes(c: Column | str) -> Column:
    """True for Y in any case and with blanks, else false."""
    return F.coalesce(F.upper(strip(c)) == "Y", F.lit(False))


def complaint_id(c: Column | str) -> Column:
    """The eight-digit id of c02 however it is written: wide digits, a prefix, marks, a decimal tail, leading zeros; null where no digit is left."""
    s = F.regexp_replace(strip(F.translate(col(c), WIDE_DIGITS, DIGITS)), r"\.0+\z", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^0-9]", ""), r"\A0+(?=[0-9]{8})", "")
    return F.when(F.length(s) > 0, F.lpad(s, F.greatest(F.length(s), F.lit(8)), F.lit("0")))


def component(c: Column | str) -> Column:
    """c12 in one form; null where it names no component."""
    s = F.upper(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), r" ?: ?", ":"))
    return F.when(~F.regexp_replace(s, r"(?U)[^\p{L}\p{N}]", "").isin(NO_COMPONENT), s)


def month_index(c: Column | str) -> Column:
    """Months since year 0, so that months can be subtracted."""
    return F.year(col(c)) * 12 + F.month(col(c)) - 1


def month_of_index(c: Column | str) -> Column:
    """The first day of a month_index."""
    return F.make_date(F.floor(col(c) / 12).cast("int"), (col(c) % 12 + 1).cast("int"), F.lit(1))
