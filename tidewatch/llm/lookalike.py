"""Problem 10: one form of all texts that look alike.

Invisible characters go, wide and narrow forms and blanks become one (NFKC). Then each word is spelled in one script. Every
character has the scripts in which something looks like it; the intersection over a word says in which scripts the whole word
can be written. Of several, the one that the words of the text that leave no choice mostly use is taken, else the first of
SCRIPTS; a word without any (its letters exist in no one script) takes each letter's first spelling. All of this depends on
looks only, so texts that look alike come to the same form, and words that are Greek or Cyrillic indeed stay so.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.cut import cut

# Letters of other scripts that look like a Latin letter, from the Unicode charts; each line is a script's letters
# and the Latin ones in the same order. Accented ones need no entry: their bases and marks are looked at apart.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu"]
LOOKS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХУԚԜԌѴаеѕіјорсухԛԝһԁѵӏ", "ABESIJKMHOPCTXYQWGVaesijopcyxqwhdvl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοανριγϲϳ", "ABEZHIKMNOPTYXCJoavpiycj"),
    "Armenian": ("ՏՕԼՍօոսհզցյ", "SOLUonuhqgj"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
#: Letters of the same script that look alike, and marks that do; the first is taken.
SAME = ["iıɩ", "aɑ", "gɡ", "'’‘‛′ʼʹˈ`´", '"“”„‟″', "-‐‑‒–−˗⁃", "/⁄∕", ":∶꞉", ".․", ",‚", "*∗", "|ǀ∣", "!ǃ", "~∼˜", "·‧∙•"]
#: Characters of Japanese that differ by script only; folded for comparison, not in the form.
KANA = str.maketrans("ヘベペニエロカトハタ", "へべぺ二工口力卜八夕")

_BLANK = re.compile(r"\r\n|[^\S\n]")
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​‌‎‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_JOINER = regex.compile(r"(?<!\p{Extended_Pictographic})‍|‍(?!\p{Extended_Pictographic})")
_ALPHABETS = regex.compile("[" + "".join(rf"\p{{Script={s}}}" for s in SCRIPTS) + r"\p{M}]+")
_FOREIGN = regex.compile("[" + "".join(rf"\p{{Script={s}}}" for s in SCRIPTS[1:]) + "]")
_SAME = {ord(c): group[0] for group in SAME for c in group[1:]}
_SAME[0x0E41] = "เเ"


@functools.cache
def spellings(c: str) -> dict[str, str] | None:
    """The scripts in which c, or a letter that looks like it, is written, with that letter; None if every script has it."""
    latin = next((b[a.index(c)] for a, b in LOOKS.values() if c in a), c)
    out = {s: a[b.index(latin)] for s, (a, b) in LOOKS.items() if latin in b}
    if out:
        return {"Latin": latin} | out
    own = next((s for s in SCRIPTS if regex.match(rf"\p{{Script={s}}}", c)), None)
    return {own: c} if own else None


def _scripts(word: str) -> tuple[list[dict[str, str] | None], list[str]]:
    spelled = [spellings(c) for c in word]
    shared = set(SCRIPTS).intersection(*(s for s in spelled if s))
    return spelled, [s for s in SCRIPTS if s in shared]


def form(text: str) -> str:
    """The one form of all texts that look like this one, character by character."""
    if text.isascii() and "\t" not in text and "\r" not in text and "`" not in text:
        return text
    text = unicodedata.normalize("NFKC", _UNSEEN.sub("", _BLANK.sub(lambda m: "\n" if m[0][0] in "\r\x0b\x0c\x85  " else " ", text)))
    text = _JOINER.sub("", text).translate(_SAME)
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFD", text)
        words = {w: _scripts(w) for w in set(_ALPHABETS.findall(text))}
        firm = Counter(s[0] for m in _ALPHABETS.finditer(text) if len(s := words[m[0]][1]) == 1)
        favoured = sorted(SCRIPTS, key=lambda s: (-firm[s], SCRIPTS.index(s)))

        def spell(m: re.Match) -> str:
            spelled, shared = words[m[0]]
            script = next((s for s in favoured if s in shared), None)
            return "".join(c if s is None else s[script] if script else next(iter(s.values())) for c, s in zip(m[0], spelled))

        text = _ALPHABETS.sub(spell, text)
    return unicodedata.normalize("NFC", text)


def key(text: str | None) -> str | None:
    """A hash that texts have in common exactly if they look alike; None for null and for texts without a visible character."""
    seen = form(text) if text else ""
    return hashlib.sha256(seen.translate(KANA).encode("utf-8", "surrogatepass")).hexdigest() if seen.strip() else None


def with_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """df with the form of text; null stays null, an empty text empty."""
    @F.pandas_udf("string")
    def forms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(form, na_action="ignore")

    return df.withColumn(out, forms(text))


def classes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, class (the smallest id of all that look alike), own (a hash of the text itself), texts (different ones in the class).

    A row per row of df with a visible character; ids are kept as they are, repeated rows repeatedly. Classes come from one
    aggregate of hashes with partial sums, so a class that a third of the rows belongs to is gathered nowhere.
    """
    @F.pandas_udf("string")
    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(key, na_action="ignore")

    # Hashes only, made once: they are read for the classes, for their rows, and by both sides of pairs.
    hashed = cut(df.where(F.col(text).isNotNull()).select(id, keys(text).alias("_key"), F.sha2(text, 256).alias("own"))).where("_key is not null")
    firsts = hashed.groupBy("_key", "own").agg(F.min(id).alias("_first")).groupBy("_key").agg(F.min("_first").alias("class"), F.count("*").alias("texts"))
    return hashed.join(firsts, "_key").select(id, "class", "own", "texts")


def pairs(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b, the smaller first: rows that look alike but aren't the same string. Exact copies make no pair with each other."""
    of = classes(df, id, text).where("texts > 1")
    a, b = of.select(F.col(id).alias("doc_id_a"), "class", F.col("own").alias("_a")), of.select(F.col(id).alias("doc_id_b"), "class", F.col("own").alias("_b"))
    return a.join(b, "class").where("doc_id_a < doc_id_b and _a <> _b").select("doc_id_a", "doc_id_b").distinct()
