"""Problem 5: sentences of texts in any language, script and layout, by a pushdown automaton.

A text is read line by line, as events: openers, closers, quotation marks, stops, and gaps between statements. The automaton
keeps a stack of what is open: quotations, brackets and, over the lines, the levels of a list. An opener that its line never
closes is dropped from the stack as if it were an ordinary character. A stop within something closed later doesn't divide;
one outside, or right before the closer of the outermost, is judged by what stands before it (tries of abbreviations, numbers,
names of hosts) and after it (blanks, case, words that carry on a sentence).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on, those that may end one, and the words that carry one on.
GO_ON = {
    "en": "mr mrs ms dr prof st no nos approx vs e.g i.e cyl hwy rte jan feb mar apr jun jul aug sept sep oct nov dec spec temp fig incl apt ext tel p.o ste rt mt ft ca ref est",
    "es": "sr sra srta n.º nº núm pág págs aprox",
    "de": "bzw z.b",
}
MAY_END = {"en": "inc ltd co corp ave rd blvd ln dr ct st a.m p.m hrs hr min u.s etc sec", "es": "cía", "de": "gmbh", "fr": "llc"}
CARRIES_ON = {*"was were is are when and or but could had has would did in on with for of to from at two sharp model replaced blamed until while that which y o pero cuando en de del con para que".split()}
#: Pairs with which a sentence begins all the same; # stands for a number or a month.
BEGINS = {*"two of|while driving|is this|is that|on #|at #".split("|")}
_NUMBER = re.compile(r"\d|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", re.I)
SAYS = {*"asked said replied answered told says wrote added dijo preguntó respondió contestó".split()}
TOP_LEVEL = {*"com net org edu gov example test invalid io kr es de fr".split()}
OPEN, CLOSE = "([{（［｛「『｢“«【〈《", ")]}）］｝」』｣”»】〉》"
MATE = dict(zip(CLOSE, OPEN))

_LINE = re.compile("[^\n\r\x0b\x0c\x85  ]+")
_STOPS = ".!?…。！？．｡؟।"
_THAI, _HANGUL = "฀-๿", "가-힣"
#: The ends of Korean statements and questions before a blank, where no mark divides them.
_KOREAN_END = rf"(?:니다|[{_HANGUL}]까요|[{_HANGUL}]어요|[았었였했됐갔왔졌렸났혔겼]다)(?=\s+[^\s\"'”’)\]])"
_EVENT = re.compile(rf"(?P<stop>[{re.escape(_STOPS)}]+)|(?P<open>[{re.escape(OPEN)}])|(?P<close>[{re.escape(CLOSE)}])|(?P<quote>\")|(?P<korean>{_KOREAN_END})|(?P<thai>(?<=[{_THAI}])\s+(?=[{_THAI}]))")
_AFTER = re.compile(r"[\"'”’»」』｣)\]}）］｝】〉》]*")
_WORD = re.compile(r"[^\s\"“”()«»「」¿¡]+\Z")
_NEXT = re.compile(r"\s*[\"“«(¿¡'‘]*([^\s.,;:!?\"”)]*)(?:\s+([^\s.,;:!?\"”)]*))?")
_ITEM = re.compile(r"\s*(?:\d{1,2}(?:\.\d{1,2})*|[A-Za-z]|[ivx]{1,4})[.)](?=\s+\S)")
_AT_HOST = re.compile(r"[\w+-]+\s*(?:[\[(]\s*at\b|at\s+[\w-]+\s+dot\b)", re.I)
_STREET = re.compile(r"\d+\S*(?:\s+\S+){1,3}\Z")
_HOUR = re.compile(r"\W*(?:around|at|about|by)\s+[\d:]+\s*[ap]\.m", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]*")
_INITIAL = re.compile(r"(?:\A|\W)[A-Za-z]\Z")


class Trie:
    """Words held from their last character to the first, so that the one before a stop is found by walking back from it."""

    def __init__(self, groups: dict[str, str]):
        self.root: dict = {}
        for words in groups.values():
            for w in words.split():
                node = self.root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node[""] = w

    def holds(self, word: str) -> bool:
        node = self.root
        for c in reversed(word):
            if (node := node.get(c)) is None:
                return False
        return "" in node


GOES, MAY = Trie(GO_ON), Trie(MAY_END)


def enclosed(line: str, events: list[re.Match]) -> list[tuple[int, int]]:
    """The outermost stretches that open and close in the line, by a stack; an inch mark is no quotation."""
    stack: list[int] = []
    out: list[tuple[int, int]] = []
    for m in events:
        i, kind = m.start(), m.lastgroup
        c = line[i]
        mate = -1
        if kind == "open":
            stack.append(i)
            continue
        if kind == "quote":
            mate = next((k for k in range(len(stack) - 1, -1, -1) if line[stack[k]] == '"'), -1)
            if mate < 0:
                if not (i and line[i - 1].isdigit()):
                    stack.append(i)
                continue
        elif kind == "close":
            mate = next((k for k in range(len(stack) - 1, -1, -1) if line[stack[k]] == MATE[c]), -1)
        if mate >= 0:
            a = stack[mate]
            del stack[mate:]  # what stands above was never closed
            while out and out[-1][0] > a:
                out.pop()
            out.append((a, i))
    return out


def divides(line: str, begin: int, at: int, end: int, after: int) -> bool:
    """Whether the stop line[at:end], with the closing marks up to after, ends the sentence that begins at begin."""
    rest = line[after:]
    bare_rest = rest.lstrip()
    if not bare_rest:
        return True
    stop, nxt, spaced = line[at:end], bare_rest[0], rest[0].isspace()
    first, second = (x or "" for x in _NEXT.match(rest).groups())
    low, closed = first.lower(), after > end
    if nxt in ",;:)]}”，、；：" or (nxt == "-" and spaced):
        return False
    if closed and (low in SAYS or (low in CARRIES_ON and low != "two" and stop[0] != ".")):
        return False
    if stop[-1] in "。！？｡।؟" or "!" in stop or "?" in stop:
        if closed and nxt in "とって":
            return False
        return not (closed and first[:1].islower() and (low in SAYS or low in CARRIES_ON or any(c.isupper() for c in line)))
    word = (_WORD.search(line, begin, at) or [""])[0]
    bare = word.lower().rstrip(".").lstrip("'‘[")
    if "…" in stop or len(stop) > 1:
        shouted = word.isupper() and len(word) > 1 and first.isupper()
        return not (first[:1].islower() or shouted or (not first[:1].isalpha() and nxt not in "\"“«(¿¡"))
    goes, may = GOES.holds(bare), MAY.holds(bare)
    if "가" <= nxt <= "힣" and bare.isascii() and (not spaced or may):
        return False
    if not spaced:
        return _divides_unspaced(line, word, bare, rest, first, nxt, after, closed, goes)
    if bare == "no":
        return not nxt.isdigit()
    street = bool(_STREET.search(line, begin, at))
    if goes and bare not in ("dr", "st") or bare in ("nos", "dr", "mr"):
        return bare == "dr" and street and not first[:1].islower()
    if bare == "st" and not street:
        return False
    if may:
        if bare in ("a.m", "p.m") and _HOUR.fullmatch(line, begin, at):
            return False
        if first[:1].isdigit() or not first:
            return nxt in "\"“«(¿¡"
        if first[:1].islower() and any(c.isupper() for c in line):
            return False
        one_case = word.isupper() == first.isupper() and (first.isupper() and len(first) > 1 or first.islower())
        if one_case and low in CARRIES_ON:
            return f"{low} {'#' if _NUMBER.match(second) else second.lower()}" in BEGINS
        return True
    if bare in ("n", "s", "e", "w"):
        return False
    if len(bare) == 1 and bare.isascii() and bare.isalpha() and bare != "i" and not re.search(r"[\dº]\s*\Z", line[begin : at - len(word)]):
        return False
    if re.fullmatch(r"(?:[a-z]\.)+[a-z]", bare):
        return not (first[:1].islower() or low in CARRIES_ON)
    return True


def _divides_unspaced(line: str, word: str, bare: str, rest: str, first: str, nxt: str, after: int, closed: bool, goes: bool) -> bool:
    """The same for a single full stop with no blank behind it."""
    if _AT_HOST.match(rest):
        return False
    if not nxt.isalpha() and nxt not in "\"“«(¿¡":
        return closed and nxt.isdigit()
    if line[after - 1] != ".":
        return True
    token = word + "." + re.match(r"\S*", rest)[0]
    label = (_LABEL.match(rest) or [""])[0].lower()
    if "@" in token:
        return "@" in word and bare.rpartition(".")[2].rpartition("@")[2] in TOP_LEVEL and "." in bare.rpartition("@")[2] and label not in TOP_LEVEL
    if label in TOP_LEVEL and not re.match(r"\w+\s+\w", rest) or "[dot]" in token.lower():
        return False
    if re.match(r"[A-Za-z](?:\.|\b)", rest) and _INITIAL.search(word) or goes and first[:1].islower():
        return False
    return len(first) > 1 or first in {"I", "i", "A", "a", "Y", "y"}


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin (from 0) and end (exclusive) of each sentence in code points, without outer blanks; of a text without a visible character, none."""
    out: list[tuple[int, int]] = []
    levels: list[int] = []  # the indents of the lists that the line is in
    for m in _LINE.finditer(text):
        line = m[0]
        if line.isspace():
            continue
        item = _ITEM.match(line)
        if item:
            indent = len(line) - len(line.lstrip())
            while levels and levels[-1] > indent:
                levels.pop()
            if not levels or levels[-1] < indent:
                levels.append(indent)
        elif levels and not line[0].isspace():
            levels.clear()
        skip = item.end() if item and levels else 0
        events = list(_EVENT.finditer(line))
        spans = enclosed(line, events) if any(e.lastgroup in ("close", "quote") for e in events) else []
        begin, done, k = 0, 0, 0
        for e in events:
            kind = e.lastgroup
            if kind in ("open", "close", "quote") or e.start() < max(done, skip):
                continue
            at, end = e.span()
            if kind == "stop":
                after = _AFTER.match(line, end).end()
                while after > end and line[after - 1] == '"' and not any(b == after - 1 for _, b in spans):
                    after -= 1
            else:
                after = end
            while k < len(spans) and spans[k][1] < at:
                k += 1
            if k < len(spans) and spans[k][0] < at and after <= spans[k][1]:
                continue
            if kind != "stop" or divides(line, begin, at, end, after):
                done = after if kind != "thai" else end
                cut = after if kind != "thai" else at
                _emit(out, m.start(), line, begin, cut)
                begin = cut
        _emit(out, m.start(), line, begin, len(line))
    return out


def _emit(out: list[tuple[int, int]], offset: int, line: str, begin: int, end: int) -> None:
    piece = line[begin:end]
    bare = piece.strip()
    if bare:
        a = begin + len(piece) - len(piece.lstrip())
        out.append((offset + a, offset + a + len(bare)))


def split(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, start_pos and end_pos (from 1, inclusive) of each sentence of text, a row each.

    Null and empty texts, and texts without a visible character, have no sentence; rows alike in keep and text give their
    sentences once; an empty table gives an empty result; a column of df that isn't kept doesn't matter.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = "".join(f"_k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep)) + "start_pos int, end_pos int"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sentences(t) for t in b["_text"]]
            sizes = [len(f) for f in found]
            flat = [s for f in found for s in f]
            out = b.drop(columns="_text")
            out = out.loc[out.index.repeat(sizes)].reset_index(drop=True)
            yield out.assign(start_pos=pd.Series([a + 1 for a, _ in flat], dtype="int32"), end_pos=pd.Series([z for _, z in flat], dtype="int32"))

    out = rows.mapInPandas(of, schema).distinct()
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "start_pos", "end_pos")
