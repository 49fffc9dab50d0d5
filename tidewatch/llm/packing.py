"""Problem 9: texts into containers of fixed capacity, by Martello-Toth dominance and best fit.

Sizes are whole numbers up to the capacity, so all of the instance is a histogram of at most capacity rows, whatever the
number of texts. The containers are planned on it; then each text finds its place by its rank among those of its size.

Dominance: a set F of items that contains item j dominates another set that contains j, if the items of the other can be
divided so that each part fits into an item of F. If F dominates every feasible set that holds j, some best packing holds F
as a container, so F is fixed and the instance shrinks. Sets of up to three items are tried, for each j from the largest:
  {j}        no other item fits beside j;
  {j, a}     a is the largest that fits, and either fills the container, or no two items fit beside j;
  {j, a, b}  three items don't fit beside j, a is the largest that fits, b the largest beside both, and no pair that fits
             has a smaller item above b.
The others may be larger than j. Items for which there is no such set are left for best fit.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.tokens import encode
from tidewatch.sources.cut import cut

CAPACITY = 2048
SALTS = 256


class Stock:
    """A histogram of sizes, with the largest size not above a bound in a few steps."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for s, c in counts.items():
            self.n[s] = c

    def largest(self, bound: int, less: Counter = Counter()) -> int:
        """The largest size up to bound of which more than less[size] are left; 0 if there is none."""
        if bound < 1:
            return 0
        there = np.flatnonzero(self.n[1 : bound + 1])[::-1] + 1
        return next((int(s) for s in there if self.n[s] > less[int(s)]), 0)

    def smallest_above(self, s: int, less: Counter) -> int:
        """The smallest size above s of which more than less[size] are left; more than any container holds if there is none."""
        above = np.flatnonzero(self.n[s + 1 :]) + s + 1
        return next((int(x) for x in above if self.n[x] > less[int(x)]), len(self.n) * 2)

    def smallest(self, k: int, less: Counter) -> list[int]:
        """The k smallest items, without those in less."""
        out: list[int] = []
        for s in np.flatnonzero(self.n):
            out += [int(s)] * int(min(self.n[s] - less[int(s)], k - len(out)))
            if len(out) == k:
                break
        return out


def dominating(stock: Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set of up to three items that holds j and dominates all others that do."""
    room, own = capacity - j, Counter([j])
    a = stock.largest(room, own)
    if not a:
        return (j,)
    small = stock.smallest(3, own)
    if j + a == capacity or len(small) < 2 or sum(small[:2]) > room:
        return (j, a)
    if len(small) == 3 and sum(small) <= room:
        return None
    b = stock.largest(room - a, own + Counter([a]))
    if not b:
        return None
    # The largest smaller item of any pair that fits.
    y = stock.largest(room // 2, own)
    while y > b:
        if stock.n[y] - own[y] > 1 or stock.smallest_above(y, own) + y <= room:
            return None
        y = stock.largest(y - 1, own)
    return (j, a, b)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], dict[str, int]]:
    """Rows (size, lo, hi, box, each): the items of that size with ranks lo to hi - 1 go into the containers from box on, each to one.

    And figures: containers, the containers fixed by dominance, and the least number that the sum of sizes allows.
    """
    stock, used, out, boxes = Stock({s: c for s, c in counts.items() if s > 0 and c > 0}, capacity), Counter(), [], 0

    def place(size: int, items: int, box: int, each: int) -> None:
        out.append((size, used[size], used[size] + items, box, each))
        used[size] += items
        stock.n[size] -= items

    for j in [int(s) for s in np.flatnonzero(stock.n)[::-1]]:
        while stock.n[j]:
            found = dominating(stock, j, capacity)
            if found is None:
                break
            need = Counter(found)
            # The same set dominates again and again while its sizes last: fewer other items leave fewer other sets.
            times = min(int(stock.n[s]) // m for s, m in need.items()) if len(found) < 3 else 1
            for s, m in need.items():
                place(s, times * m, boxes, m)
            boxes += times
    fixed = boxes
    open_boxes: dict[int, list[tuple[int, int]]] = {}  # by room left: runs of (first container, number)
    for s in [int(s) for s in np.flatnonzero(stock.n)[::-1]]:
        for room in sorted(r for r in open_boxes if r >= s):
            if not stock.n[s]:
                break
            each, rest = room // s, []
            for box, number in open_boxes.pop(room):
                full = min(number, int(stock.n[s]) // each)
                if full:
                    place(s, full * each, box, each)
                    open_boxes.setdefault(room - each * s, []).append((box, full))
                    box, number = box + full, number - full
                if number and stock.n[s]:
                    m = int(stock.n[s])  # fewer than each: they share one container
                    place(s, m, box, m)
                    open_boxes.setdefault(room - m * s, []).append((box, 1))
                    box, number = box + 1, number - 1
                if number:
                    rest.append((box, number))
            if rest:
                open_boxes.setdefault(room, []).extend(rest)
        if m := int(stock.n[s]):
            each = capacity // s
            if full := m // each:
                place(s, full * each, boxes, each)
                open_boxes.setdefault(capacity - each * s, []).append((boxes, full))
                boxes += full
            if last := m % each:
                place(s, last, boxes, last)
                open_boxes.setdefault(capacity - last * s, []).append((boxes, 1))
                boxes += 1
    total = sum(s * c for s, c in counts.items() if s > 0)
    return out, {"containers": boxes, "fixed": fixed, "least": -(-total // capacity)}


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and tokens of each row, by the tokenizer of problem 8; 0 for null and empty texts."""
    return encode(docs, id, text).select(id, F.size("ids").alias("tokens"))


def pieces(sized: DataFrame, id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """id, part, start (from 0) and tokens of the items: a row above the capacity is several, all but the last of them full."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(capacity))
    return sized.select(id, F.col("tokens").alias("_n"), F.posexplode(starts).alias("part", "start")).select(id, "part", "start", F.least(F.col("_n") - F.col("start"), F.lit(capacity)).alias("tokens"))


def pack(items: DataFrame, id: str = "doc_id", capacity: int = CAPACITY) -> tuple[DataFrame, dict[str, int]]:
    """container, id, part, start and tokens of each piece, and the figures of the plan.

    Items without a token take no room; they are in container 0. Repeated rows are items of their own. The driver gets the
    histogram, at most capacity rows. Ranks within a size are counted per salt, so a size that a third of the items has is no
    hot key; the plan is joined by broadcast while it has at most 100,000 rows, and else by size and salt.
    """
    spark: SparkSession = items.sparkSession
    histogram = {r["tokens"]: r["count"] for r in items.where("tokens > 0").groupBy("tokens").count().collect()}
    rows, figures = plan(histogram, capacity)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(id, "part"), F.lit(SALTS)))
    counts = salted.groupBy("tokens", "_salt").agg(F.count("*").alias("_c"))
    offsets = counts.select("tokens", "_salt", (F.sum("_c").over(Window.partitionBy("tokens").orderBy("_salt")) - F.col("_c")).alias("_before"))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("tokens", "_salt").orderBy(id, "part")) - 1).join(offsets, ["tokens", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_r"))
    planned = spark.createDataFrame(rows, "size int, lo bigint, hi bigint, box bigint, each bigint")
    if len(rows) <= 100_000:
        planned = F.broadcast(planned)
    fit = (ranked["tokens"] == planned["size"]) & (ranked["_rank"] >= planned["lo"]) & (ranked["_rank"] < planned["hi"])
    out = ranked.join(planned, fit, "left").select(F.coalesce(F.expr("box + (_rank - lo) div each"), F.lit(0)).alias("container"), id, "part", "start", "tokens")
    return out, figures


def packed(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The pieces of all documents in their containers. The sizes are counted once and kept in the shared folder."""
    return pack(cut(pieces(sizes(docs))))
