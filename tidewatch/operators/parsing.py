"""Problem 1: rows that fail to parse, set apart with the reason, by structural indexing.

A batch of undivided lines is one byte buffer. Masks of quotes and tabs over the whole buffer, and the parity of the quotes
before each byte, say which tabs divide fields and whether a quoted field keeps the rule; no line is walked in Python.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = [f"c{i:02d}" for i in range(1, 52)]
TAB, QUOTE = 9, 34


def buffer_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its items, from 0; a null is an empty item."""
    strings = pc.fill_null(strings.cast(pa.large_string()), "")
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def structure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: whether its quoting is broken, and the number of its fields; and the positions of all dividing tabs.

    Only quotes and tabs are looked at. The parity of the quotes of a line before a position is odd inside a quoted field. A
    quote that would open a field but isn't at its begin is an ordinary character of an unquoted field: it and all others up
    to the next tab leave the mask, and the parity is taken anew, for all lines at once, until none is left.
    """
    lines = len(offsets) - 1
    broken = np.zeros(lines, bool)
    tabs, quotes = np.flatnonzero(data == TAB), np.flatnonzero(data == QUOTE)
    if len(quotes):
        starts, ends = offsets[:-1], offsets[1:]
        padded = np.concatenate([data, [0]])
        while True:
            line = np.searchsorted(starts, quotes, "right") - 1
            before = np.arange(len(quotes)) - np.searchsorted(quotes, starts)[line]
            opens = before % 2 == 0
            follows = np.zeros(len(quotes), bool)
            follows[1:] = (quotes[1:] == quotes[:-1] + 1) & (line[1:] == line[:-1])
            at_begin = (quotes == starts[line]) | (padded[quotes - 1] == TAB)
            bare = np.flatnonzero(opens & ~at_begin & ~follows)
            if not len(bare):
                break
            first = bare[np.unique(line[bare], return_index=True)[1]]  # the first of each line; before it the parity is right
            k = np.searchsorted(tabs, quotes[first])
            until = np.minimum(np.append(tabs, len(data))[k], ends[line[first]])
            edges = np.zeros(len(quotes) + 1, int)
            np.add.at(edges, first, 1)
            np.add.at(edges, np.searchsorted(quotes, until), -1)
            quotes = quotes[np.cumsum(edges[:-1]) == 0]
            if not len(quotes):
                break
        if len(quotes):
            closes = ~opens
            doubled = np.zeros(len(quotes), bool)
            doubled[:-1] = follows[1:]
            ended = (quotes + 1 == ends[line]) | (padded[quotes + 1] == TAB)
            broken[line[closes & ~ended & ~doubled]] = True
            counts = np.bincount(line, minlength=lines)
            broken |= counts % 2 == 1
            inside = (np.searchsorted(quotes, tabs) - np.searchsorted(quotes, starts)[np.searchsorted(starts, tabs, "right") - 1]) % 2 == 1
            tabs = tabs[~inside]
    fields = np.searchsorted(tabs, offsets[1:]) - np.searchsorted(tabs, offsets[:-1]) + 1
    return broken, fields, tabs


def damaged(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each item, whether it holds a control character other than tab, line feed and carriage return, or U+FFFD."""
    low = (data < 32) & (data != 9) & (data != 10) & (data != 13) | (data == 127)
    hits = [np.flatnonzero(low)]
    at = np.flatnonzero(data[:-1] == 0xC2)
    hits.append(at[(data[at + 1] >= 0x80) & (data[at + 1] < 0xA0)])
    at = np.flatnonzero(data[:-2] == 0xEF)
    hits.append(at[(data[at + 1] == 0xBF) & (data[at + 2] == 0xBD)])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(hits), "right") - 1] = True
    return out


def usable_day(s: str | None) -> bool:
    """Nothing, or eight ASCII digits of a real day, outer blanks aside."""
    s = (s or "").strip()
    if not re.fullmatch("[0-9]{8}", s):
        return not s
    try:
        datetime.date(int(s[:4]), int(s[4:6]), int(s[6:]))
    except ValueError:
        return False
    return True


def unusable_days(values: pa.Array) -> np.ndarray:
    """Of each value, whether it is no usable day; each distinct value is looked at once."""
    coded = values.dictionary_encode()
    bad = np.array([not usable_day(x.as_py()) for x in coded.dictionary] + [False])
    return bad[coded.indices.fill_null(len(bad) - 1).to_numpy(zero_copy_only=False)]


REASONS = pa.array(["quoting", "field_count", "received_date", "narrative"])


def _reasons(*checks: np.ndarray) -> pa.Array:
    """The first check, in order, that holds; null where none does."""
    code = np.select(checks, range(len(checks)), -1)
    return REASONS.take(pa.array(code, mask=code < 0))


def _unquoted(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The fields' values: without the quotes of a quoted field, with doubled quotes made one."""
    quoted = (ends - begins >= 2) & (np.append(data, 0)[begins] == QUOTE)
    begins, ends = begins + quoted, ends - quoted
    sizes = np.maximum(ends - begins, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    body = data[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
    out = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return pc.if_else(pa.array(quoted), pc.replace_substring(out, '""', '"'), out)


def parse_lines(df: DataFrame, key: str, line: str, date_field: int = 17, text_field: int = 20, with_fields: bool = True) -> DataFrame:
    """row_key, reason and (with_fields) c01..c51 of each line of df; reason is null for a line that parses.

    The first reason that holds: quoting, field_count, received_date, narrative. Fields of a rejected line are null. A null line is
    an empty one, of one field. Repeated lines come out repeatedly; an empty table gives an empty result; other columns are left
    out, whatever their names.
    """
    names = FIELDS if with_fields else []
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(line).alias("line"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffer_of(batch.column(1))
            broken, fields, tabs = structure(data, offsets)
            short = fields != len(FIELDS)
            good = np.flatnonzero(~broken & ~short)
            k = np.searchsorted(tabs, offsets[:-1])[good]
            bounds = np.concatenate([offsets[:-1][good, None] - 1, tabs[k[:, None] + np.arange(len(FIELDS) - 1)], offsets[1:][good, None]], axis=1)

            def field(i: int) -> pa.Array:
                return _unquoted(data, bounds[:, i - 1] + 1, bounds[:, i])

            date, text = np.zeros(len(broken), bool), np.zeros(len(broken), bool)
            date[good] = unusable_days(field(date_field))
            text[good] = damaged(*buffer_of(field(text_field)))
            reason = _reasons(broken, short, date, text)
            back = np.full(len(broken), -1)
            back[good] = np.arange(len(good))
            at = pa.array(back, mask=(back < 0) | reason.is_valid().to_numpy(zero_copy_only=False))
            columns = [field(i + 1).cast(pa.string()).take(at) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), reason, *columns], ["row_key", "reason", *names])

    return rows.mapInArrow(of, ", ".join(f"{c} string" for c in ["row_key", "reason", *names]))


def check_rows(df: DataFrame, key: str = "c01", date: str = "c17", text: str = "c20", keep: tuple[str, ...] = ()) -> DataFrame:
    """row_key, reason and the columns keep of each row whose fields are divided already; only received_date and narrative can hold.

    Nulls are empty values, which are valid; repeated rows come out repeatedly; an empty table gives an empty result.
    """
    schema = "row_key string, reason string" + "".join(f", {c} {t}" for c, t in df.select(*keep).dtypes)
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(date).alias("_date"), F.col(text).alias("_text"), *keep)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no = np.zeros(batch.num_rows, bool)
            reason = _reasons(no, no, unusable_days(batch.column(1)), damaged(*buffer_of(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), reason, *batch.columns[3:]], ["row_key", "reason", *keep])

    return rows.mapInArrow(of, schema)
