"""Problem 1: lines against a walk by character, and hand-made cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import parsing as P


def walk(line: str) -> tuple[bool, int]:
    """Whether a line's quoting is broken, and the number of its fields, by the rule, a character at a time."""
    i, fields = 0, 1
    while True:
        if line[i : i + 1] == '"':
            i += 1
            while True:
                k = line.find('"', i)
                if k < 0:
                    return True, 0
                if line[k + 1 : k + 2] == '"':
                    i = k + 2
                    continue
                i = k + 1
                break
            if i < len(line) and line[i] != "\t":
                return True, 0
        else:
            while i < len(line) and line[i] != "\t":
                i += 1
        if i >= len(line):
            return False, fields
        i, fields = i + 1, fields + 1


def structure(lines):
    return P.structure(*P.buffer_of(pa.array(lines, pa.string())))


def test_structure_equals_a_walk_by_character():
    r = random.Random(1)
    lines = ["".join(r.choice('a"\t"\té') for _ in range(r.randint(0, 14))) for _ in range(20000)]
    broken, fields, _ = structure(lines)
    for line, b, n in zip(lines, broken, fields):
        want = walk(line)
        assert (b, 0 if b else n) == want, repr(line)


@pytest.mark.parametrize("line,broken,fields", [("", False, 1), ("\t", False, 2), ('a"b\t"c\td"', False, 2), ('"a""b"', False, 1), ('""', False, 1), ('"""', True, 0), ('"a"b\tc', True, 0), ('"a\tb', True, 0), ('5" tire\tx', False, 2)])
def test_cases(line, broken, fields):
    b, n, _ = structure([line])
    assert b[0] == broken and (broken or n[0] == fields)


def test_days_and_damage():
    days = [None, "", "  ", "20180230", "20180228", " 20180228 ", "２０１８0228", "2018022", "2018O228", "00000101", "20180228　"]
    assert P.unusable_days(pa.array(days)).tolist() == [False, False, False, True, False, False, True, True, True, True, False]
    texts = [None, "", "a\tb\r\nc", "a\x07", "é\x85", "�", "\x7f", "ok é 한", "\x00"]
    assert P.damaged(*P.buffer_of(pa.array(texts))).tolist() == [False, False, False, True, True, True, True, False, True]


def test_parse_lines(spark):
    good = ["x"] * 51
    good[16], good[19], good[3] = "20180102", 'He said "no"', '"a\t""b"""'
    lines = ["\t".join(good), "\t".join(good[:50]), None, '"open', "\t".join([*good[:16], "bad", *good[17:]]), "\t".join([*good[:19], "bad\x08", *good[20:]])]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(lines)] + [(0, lines[0], "clash")], "line_id long, line string, reason string")
    rows = P.parse_lines(df, "line_id", "line").collect()
    assert sorted((r["row_key"], r["reason"]) for r in rows) == sorted([("0", None), ("0", None), ("1", "field_count"), ("2", "field_count"), ("3", "quoting"), ("4", "received_date"), ("5", "narrative")], key=str) or {r["row_key"]: r["reason"] for r in rows} == {"0": None, "1": "field_count", "2": "field_count", "3": "quoting", "4": "received_date", "5": "narrative"}
    first = next(r for r in rows if r["row_key"] == "0")
    assert first["c04"] == 'a\t"b"' and first["c20"] == 'He said "no"' and next(r for r in rows if r["row_key"] == "4")["c01"] is None
    assert P.parse_lines(df.limit(0), "line_id", "line").count() == 0


def test_very_long_line_and_empty_batch():
    long = "y" * 1_000_000 + '\t"' + "z\t" * 1000 + '"'
    b, n, _ = structure([long, "a"])
    assert not b[0] and n.tolist() == [2, 1]
    b, n, t = structure([])
    assert len(b) == len(n) == 0 and isinstance(t, np.ndarray)


def test_every_record_is_accepted_or_rejected(spark, sf):
    from tidewatch.plans import problems as Q
    from tidewatch.sources.tables import read

    want = read(spark, sf, "complaint_lines").count() + read(spark, sf, "complaints_raw").count()
    assert Q.p1_found(spark, sf).count() + Q.p1_accepted(spark, sf).count() == want
