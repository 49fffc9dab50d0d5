"""Problem 8: texts as ids of a public tokenizer, long texts by tree concatenation.

A long text is halved until its parts are short; the parts are rows of their own, encoded wherever there is room. Then halves
are joined pairwise up the tree. Around a join a window is encoded anew. Its begin is a piece (a unit that the tokenizer's
pattern cuts before any merge) of the left half, and pieces depend on what follows only; so as soon as a piece of the window
and one of the right half begin at the same place, both agree from there on, and the window gives the ids in between. Until
then the window grows; in the end it holds the whole right half. So the ids never depend on where a text was cut.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
LEAF, WINDOW, BATCH = 8192, 64, 256


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file; its special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Part(NamedTuple):
    """The ids of text[begin:end], with the begin of each piece and the number of ids before it."""

    begin: int
    end: int
    starts: np.ndarray
    before: np.ndarray
    ids: np.ndarray


def encode_part(path: str, text: str, begin: int) -> Part:
    """A text that stands at begin of a longer one."""
    t = tokenizer(path)
    e = t.encode(text, add_special_tokens=False)
    starts = np.array([a for _, (a, _) in t.pre_tokenizer.pre_tokenize_str(text)], np.int64) + begin
    words = np.array(e.word_ids, np.int64)
    return Part(begin, begin + len(text), starts, np.searchsorted(words, np.arange(len(starts) + 1)), np.array(e.ids, np.int32))


def join(path: str, text: str, left: Part, right: Part, window: int = WINDOW) -> Part:
    """The ids of both parts as if they had never been cut."""
    if left.begin == left.end or right.begin == right.end:
        return right if left.begin == left.end else left
    while True:
        i = max(int(np.searchsorted(left.starts, left.end - window, "right")) - 1, 0)
        a, b = int(left.starts[i]), min(right.begin + window, right.end)
        w = encode_part(path, text[a:b], a)
        if b == right.end:
            k, j = len(w.starts), len(right.starts)
        common = np.intersect1d(w.starts, right.starts[: np.searchsorted(right.starts, b)])
        if len(common):
            k, j = int(np.searchsorted(w.starts, common[0])), int(np.searchsorted(right.starts, common[0]))
        if len(common) or b == right.end:
            break
        window *= 2
    ids = np.concatenate([left.ids[: left.before[i]], w.ids[: w.before[k]], right.ids[right.before[j] :]])
    counts = np.concatenate([np.diff(left.before)[:i], np.diff(w.before)[:k], np.diff(right.before)[j:]])
    return Part(left.begin, right.end, np.concatenate([left.starts[:i], w.starts[:k], right.starts[j:]]), np.concatenate([[0], np.cumsum(counts)]), ids)


def tree(path: str, text: str, parts: list[Part]) -> Part:
    """All parts joined, halves first."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return join(path, text, tree(path, text, parts[:half]), tree(path, text, parts[half:]))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{TOKENIZER}", leaf: int = LEAF) -> DataFrame:
    """id and ids (array<int>) of each row, without special tokens.

    A null, empty or missing text has the empty list; a row that occurs twice comes out twice; an empty table gives an empty
    result; ids may be null; other columns don't matter. A text of any length is encoded whole: leaf, the number of characters
    above which it is halved, changes no id.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.length(text).alias("_n"))
    short, long = rows.where(f"coalesce(_n, 0) <= {leaf}").select("_id", "_t"), rows.where(f"_n > {leaf}")

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.iloc[k : k + BATCH]
                yield pd.DataFrame({"_id": part["_id"], "ids": [e.ids for e in t.encode_batch(part["_t"].tolist(), add_special_tokens=False)]})

    parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("_n") / leaf))).cast("bigint")
    cuts = long.withColumn("_key", F.sha2("_t", 256)).withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    a, b = F.expr("_n * _k div _parts"), F.expr("_n * (_k + 1) div _parts")
    leaves = cuts.select("_id", "_key", "_k", a.alias("_a"), F.substring("_t", (a + 1).cast("int"), (b - a).cast("int")).alias("_t"))
    leaves = leaves.repartition(F.xxhash64("_id", "_key", "_k"))  # so that halves of one text are several tasks' work
    schema = f"_id {kind}, _key string, _k bigint, _a bigint, _t string, _s array<bigint>, _b array<bigint>, _ids array<int>"

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [encode_part(path, t, a) for t, a in zip(b["_t"], b["_a"])]
            yield b.assign(_s=[x.starts for x in p], _b=[x.before for x in p], _ids=[x.ids for x in p])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        copies = int((group["_k"] == 0).sum())
        g = group.drop_duplicates("_k").sort_values("_k")
        full = "".join(g["_t"])
        p = tree(path, full, [Part(a, a + len(t), np.asarray(s), np.asarray(b), np.asarray(i)) for a, t, s, b, i in zip(g["_a"], g["_t"], g["_s"], g["_b"], g["_ids"])])
        return pd.DataFrame({"_id": list(g["_id"].iloc[:1]) * copies, "ids": [p.ids] * copies}).astype({"_id": group["_id"].dtype})

    # A group is one text, so it is no larger than the row it gives.
    joined = leaves.mapInPandas(encode_leaves, schema).groupBy("_id", "_key").applyInPandas(whole, f"_id {kind}, ids array<int>")
    return short.mapInPandas(direct, f"_id {kind}, ids array<int>").unionByName(joined).withColumnRenamed("_id", id)
