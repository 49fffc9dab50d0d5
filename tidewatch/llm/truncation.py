"""Problem 6: texts that were cut off, by what their last three words usually do, in Spark SQL alone.

All sentences of all texts are counted once each kind, then their word trigrams: inside a sentence, or at its end. A sentence
begins with two marks ^, so a short one has trigrams too; numbers are alike. Characters of scripts without blanks (Thai, kana,
Han) are words of one character each. A full stop ends a sentence at the end of a line and before a capital; in texts of one
case, where that can't be told, a stop in the line counts as neither. So does the last trigram of a text without a stop.

The last trigram of a text is joined to these counts: its own, and those of trigrams whose third word begins with its third,
as a cut can go through a word. A text is cut if its last trigram, so read, is frequent inside sentences but almost never at
their end; a text that ends in a mark of omission is cut unless its last trigram does end sentences.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame

from tidewatch.sources.cut import cut

#: A trigram is frequent from so many occurrences on, and almost never terminal up to this share of ends; at a mark of omission, up to the other share.
FREQUENT, SHARE, OMITTED = 3, 0.015, 0.9

_OMISSION = r"\\s*(?:…|\\.\\.+|[\\[(<]\\s*(?:\\.\\.\\.|…|truncated|cut|more|continued|snip)\\s*[\\])>])\\s*$"
_CLOSERS = r"[\"\\x27”’»」』)\\]）]*"
_OPENERS = r"[\"\\x27“«(¿¡「\\[]*"
_DENSE = r"\\u0E00-\\u0E7F\\u3041-\\u30FF\\u3400-\\u9FFF"
#: The characters of words, those of ASCII one by one and first: they are looked up in a table, without asking for their category.
_WORD = rf"[[{string.ascii_letters}{string.digits}\\$@&+%#_\\x27\\-][[^\\x00-\\x7F{_DENSE}]&&[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}’]]]"

#: Steps, each a query over the step before ({_}). U+0001 is an end of a sentence, U+0002 a stop of unknown meaning. What can
#: only stand at the end of a text (a mark of omission, the last stop) is looked for there alone, and no pattern begins with a
#: look behind, so each pass over a text is one comparison a character. The last sentence has a column of its own, so that the
#: ends are read without the others. Where a pattern stands below, no row is left out by what it finds before it is exploded:
#: Spark would move such a filter, and that of a plain explode, below the pattern's step and the count of equal sentences, with
#: the pattern in it once more.
_PREPARED = [
    rf"select source_table, row_key, kind, value, rlike(right(rtrim(value), 24), '{_OMISSION}') as omitted from {{_}}",
    rf"select source_table, row_key, kind, omitted, case when omitted then regexp_replace(value, '{_OMISSION}', '') else value end as bare from {{_}}",
    r"""select source_table, row_key, kind, omitted, rlike(bare, '\\p{{Lu}}') and rlike(bare, '\\p{{Ll}}') as mixed, octet_length(bare) > length(bare) and rlike(bare, '[\\u0E00-\\u0E7F가-힣]') as unmarked,
      regexp_replace(regexp_replace(bare, '[0-9]+(?:[.,:/\\x27–-]+[0-9]+)*[,:/–-]*', '0'), '[\\r\\n。！？｡]', '\u0001') as s from {_}""",
    rf"""select source_table, row_key, kind, omitted, unmarked, rlike(right(rtrim(s), 12), '[.!?…\u0001]{_CLOSERS}\\s*$') as ended,
      case when mixed then regexp_replace(s, '[.!?…]+(?:{_CLOSERS}(?=\\s+{_OPENERS}\\p{{{{Lu}}}})|(?<=[\\p{{{{Ll}}}}0-9)][.!?…]){_CLOSERS}(?={_OPENERS}\\p{{{{Lu}}}}))', '\u0001')
           else regexp_replace(regexp_replace(s, '[!?]+{_CLOSERS}(?=\\s)', '\u0001'), '[.…]+{_CLOSERS}(?=\\s+{_OPENERS}\\p{{{{L}}}})', '\u0002') end as s from {{_}}""",
    r"""select source_table, row_key, kind, omitted, ended, filter(transform(split(lower(
      case when unmarked then regexp_replace(s, '\\s(?:(?<=[\\u0E00-\\u0E7F]\\s)(?=\\s*[\\u0E00-\\u0E7F])|(?<=(?:니다|까요|어요)\\s))', '\u0001') else s end), '\u0001'), x -> trim(x)), x -> rlike(x, '[^\\s.!?…]')) as sentences from {_}""",
    "select source_table, row_key, kind, omitted, ended, sentences, size(sentences) as many, try_element_at(sentences, -1) as s from {_}",
]
_WORDS = rf"concat(array('^', '^'), regexp_extract_all(s, '{_WORD}+|\u0002|[{_DENSE}]', 0))"
_TRIGRAMS = [
    "select posexplode(sentences) as (i, s), many, ended from {_}",
    "select s, i + 1 < many or ended as complete from {_}",
    "select s, complete, count(*) as n from {_} group by s, complete",
    f"select {_WORDS} as w, complete, n from {{_}}",
    """select explode_outer(case when size(w) > 2 then transform(sequence(0, size(w) - 3), i -> struct(w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, i + 3 = size(w) as last)) end) as t, complete, n
      from {_}""",
    r"""select t.w1 as w1, t.w2 as w2, t.w3 as w3, sum(case when t.last then 0 else n end) as inside, sum(case when t.last and complete then n else 0 end) as final
      from {_} where t.w1 <> '\u0002' and t.w2 <> '\u0002' and t.w3 <> '\u0002' group by t.w1, t.w2, t.w3""",
    "select w1, w2, inside, final, w3, explode(transform(sequence(1, length(w3)), i -> left(w3, i))) as start from {_}",
    """select w1, w2, start as w3, sum(case when start = w3 then inside else 0 end) as inside, sum(case when start = w3 then final else 0 end) as final,
      sum(case when start = w3 then 0 else inside + final end) as longer from {_} group by w1, w2, start""",
]
#: A last trigram with a stop of unknown meaning is read in two ways: as if a sentence began there, and as if there were no stop.
_ENDS = [
    "select source_table, row_key, kind, omitted, ended, s from {_} where many > 0",
    f"select source_table, row_key, kind, omitted, ended, {_WORDS} as w from {{_}}",
    """select source_table, row_key, kind, omitted, ended, slice(w, -3, 3) as whole, slice(filter(w, x -> x <> '\u0002'), -3, 3) as plain,
      array_position(reverse(slice(w, -3, 3)), '\u0002') as at from {_}""",
    """select source_table, row_key, kind, omitted, ended, case at when 0 then array(whole) when 1 then array(plain)
      when 2 then array(plain, array('^', '^', whole[2])) else array(plain, array('^', whole[1], whole[2])) end as readings from {_}""",
    "select source_table, row_key, kind, omitted, ended, explode_outer(readings) as r from {_}",
    "select source_table, row_key, kind, omitted, ended, r[0] as w1, r[1] as w2, r[2] as w3 from {_} where size(r) = 3",
]
_COUNTED = """select k.w1, k.w2, k.w3, coalesce(inside, 0) as inside, coalesce(final, 0) as final, coalesce(longer, 0) as longer
  from {finals} k left join {trigrams} t on k.w1 = t.w1 and k.w2 = t.w2 and k.w3 = t.w3"""
_SUMMED = """select source_table, row_key, kind, omitted, ended, max(struct(e.w1, e.w2, e.w3)) as last, sum(inside) as inside, sum(final) as final, sum(longer) as longer
  from {ends} e join {counted} c on e.w1 = c.w1 and e.w2 = c.w2 and e.w3 = c.w3 group by source_table, row_key, kind, omitted, ended"""
_JUDGED = f"""select source_table, row_key, kind, omitted, ended, last.w1, last.w2, last.w3, inside, final, longer,
  case when omitted then final <= {OMITTED} * (inside + longer + final) else inside + longer >= {FREQUENT} and final <= {SHARE} * (inside + longer + final) end as cut from {{_}}"""
_REPORT = """
select t.source_table, t.kind, count(*) as records, count_if(cut) as cut, count_if(cut) / count(*) as share
from {texts} t left join {judged} j on t.source_table = j.source_table and t.row_key = j.row_key group by t.source_table, t.kind
"""


def steps(df: DataFrame, queries: list[str]) -> DataFrame:
    for q in queries:
        df = df.sparkSession.sql(q, _=df)
    return df


def judged(texts: DataFrame) -> DataFrame:
    """A row for each record of texts (source_table, row_key, kind, value) with a word: its last trigram, its counts, and cut.

    Null and empty texts, and those without a word, are not cut and have no row. Records alike in key and text come out once. All
    texts count, however often they occur; an empty table gives an empty result.
    """
    spark = texts.sparkSession
    prepared = cut(steps(texts.where("value is not null"), _PREPARED))  # read twice, as the ends are
    ends, trigrams = cut(steps(prepared, _ENDS)), steps(prepared, _TRIGRAMS)
    # The distinct last trigrams meet the counts, so that a frequent one is no hot key.
    counted = spark.sql(_COUNTED, finals=ends.select("w1", "w2", "w3").distinct(), trigrams=trigrams)
    return steps(spark.sql(_SUMMED, ends=ends, counted=counted), [_JUDGED])


def report(texts: DataFrame) -> DataFrame:
    """source_table, kind, records, cut and share: how often each kind of source cuts its texts, of all its records."""
    records = texts.select("source_table", "row_key", "kind").distinct()
    cuts = judged(texts).where("cut").select("source_table", "row_key", "cut").distinct()
    return texts.sparkSession.sql(_REPORT, texts=records, judged=cuts)
