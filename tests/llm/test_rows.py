"""Problems 3, 7 and 9: samples, survivors and packing, against brute force and on edge cases."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import packing, sample, survivor


def ledger_of(spark, rows, ledger=None, batch="0", rate="0.07"):
    df = spark.createDataFrame([(i, "x") for i in rows], "odino string, chosen string")
    return sample.sample_batch(df, ledger, batch=batch, rate=rate)


def state(ledger):
    return {r["odino"]: (r["batch"], r["chosen"]) for r in ledger.collect()}


def test_sample_keeps_exactly_the_ceiling_and_only_grows(spark):
    ids = [f"{i:08d}" for i in range(3000)]
    first = ledger_of(spark, [*ids[:100], *ids[:40], None])
    a = state(first)
    assert len(a) == 100 and sum(c for _, c in a.values()) == 7  # 0.07 x 100, not one more
    shuffled = random.Random(1).sample(ids[:100], 100)
    assert state(sample.sample_batch(spark.createDataFrame([(i,) for i in shuffled], "odino string").repartition(13), None, rate="0.07")) == a
    kept = spark.createDataFrame([(k, *v) for k, v in a.items()], "odino string, batch string, chosen boolean")
    b = state(ledger_of(spark, ids[50:1000], kept, "1"))
    assert {k: v for k, v in b.items() if v[0] == "0"} == a and sum(c for x, c in b.values() if x == "1") == math.ceil(Fraction("0.07") * 900)
    again = spark.createDataFrame([(k, *v) for k, v in b.items()], "odino string, batch string, chosen boolean")
    assert state(ledger_of(spark, ids[:1000], again, "2")) == b
    c = state(ledger_of(spark, ids, again, "2"))
    assert {k for k, v in b.items() if v[1]} <= {k for k, v in c.items() if v[1]}


def test_sample_equals_a_sort(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("odino"), F.lit("b").alias("batch"))
    want = [r["odino"] for r in ids.orderBy(F.expr("xxhash64('s', odino) < 0"), F.expr("xxhash64('s', odino)")).limit(50).collect()]
    assert {r["odino"] for r in sample.bottom_k(ids, "odino", "batch", "0.01", "s").collect()} == set(want)


def test_sample_of_nothing(spark):
    assert state(ledger_of(spark, [])) == {} and state(ledger_of(spark, ["1"])) == {"1": ("0", True)}


def test_sample_grows_over_the_tables(spark):
    from tidewatch.sources.tables import read

    small, large = (read(spark, f"/root/testdata/{d}", "complaints") for d in ("sf0.001", "sf0.01"))
    first = sample.sample_batch(small, None).cache()
    grown = sample.sample_batch(large, first, batch="1")
    chosen = {r["odino"] for r in grown.where("chosen").collect()}
    assert {r["odino"] for r in first.where("chosen").collect()} <= chosen and grown.count() == large.select("odino").distinct().count()


def raw(spark, rows):
    columns = [f"c{i:02d}" for i in range(1, 52)]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


def test_survivor(spark):
    rows = [
        {"c01": "1", "c02": "ODI-00000007", "c12": "BRAKES", "c16": "20180101", "c13": "Gull", "c10": "2"}, {"c01": "9", "c02": "7", "c12": "unknown", "c16": "20180301", "c04": "M"}, {"c01": "10", "c02": "０0000007", "c12": "Tires", "c16": "20180201"},
        {"c01": "2", "c02": "8", "c12": None, "c16": "20180101"}, {"c01": "3", "c02": "8", "c12": " - ", "c16": "20180101"},
        {"c01": "4", "c02": None, "c12": "A", "c16": "20180101"}, {"c01": "5", "c02": " ", "c12": "A", "c16": "20180101"}, {"c01": "6", "c02": "11", "c12": "A", "c16": "20180101"},
        {"c01": "20", "c02": "12", "c12": "A", "c16": "20180101"}, {"c01": "100", "c02": "12", "c12": "B", "c16": "20180101"},
    ]
    df = raw(spark, rows)
    assert {(r["odino"], r["c01"]) for r in survivor.component_source(df).collect()} == {("00000007", "10"), ("00000012", "100")}
    one = {r["odino"]: r for r in survivor.merged(df).collect()}
    assert set(one) == {"00000007", "00000008", "00000011", "00000012"} and (one["00000007"]["rows"], one["00000007"]["c12"], one["00000007"]["c13"], one["00000007"]["c10"], one["00000007"]["c04"]) == (3, "Tires", "Gull", "2", "M")
    assert survivor.component_source(df.limit(0)).count() == 0


def test_layers_equal_peeling():
    r = random.Random(2)
    for _ in range(300):
        rows = [(r.getrandbits(6) << 8, r.randint(0, 2)) for _ in range(r.randint(1, 9))]
        size = [((f >> survivor.NAMES & 1) << 8) + f.bit_count() for f, _ in rows]
        point = [(size[i], rows[i][1], -i) for i in range(len(rows))]
        left, layer, n = set(range(len(rows))), {}, 0
        while left:
            n += 1
            front = {i for i in left if not any(j != i and all(a >= b for a, b in zip(point[j], point[i])) for j in left)}
            layer.update(dict.fromkeys(front, n))
            left -= front
        assert survivor.order(rows) == sorted(range(len(rows)), key=lambda i: (layer[i], -(size[i] >> 8), i))


def filled(plan):
    boxes = Counter()
    for size, lo, hi, box, each in plan:
        for i in range(lo, hi):
            boxes[box + (i - lo) // each] += size
    return boxes


def best(items, capacity):
    """The least number of containers, by trying everything."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for room in {x for x in rooms if x >= items[i]}:
            k = rooms.index(room)
            go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return found[0]


def test_dominance_keeps_a_best_packing():
    r = random.Random(3)
    for _ in range(400):
        capacity = r.randint(6, 24)
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        stock = packing.Stock(Counter(items), capacity)
        j = r.choice(items)
        if f := packing.dominating(stock, j, capacity):
            rest = list((Counter(items) - Counter(f)).elements())
            assert sum(f) <= capacity and best(items, capacity) == 1 + best(rest, capacity), (capacity, items, f)


def test_plan_places_every_item_once():
    r = random.Random(4)
    for _ in range(200):
        counts = Counter(r.randint(1, 100) for _ in range(r.randint(0, 300)))
        rows, figures = packing.plan(counts, 100)
        placed = Counter()
        for size, lo, hi, *_ in rows:
            assert lo == placed[size]
            placed[size] = hi
        boxes = filled(rows)
        assert placed == counts and len(boxes) == figures["containers"] and max(boxes.values(), default=0) <= 100 and figures["least"] <= figures["containers"] <= figures["least"] * 1.25 + 1


def test_pack(spark):
    sized = spark.createDataFrame([(1, 5000), (2, 0), (3, 2048), (4, 904), (4, 904), (5, 240), (None, 10)], "doc_id long, tokens int")
    out, figures = packing.pack(packing.pieces(sized))
    rows = out.collect()
    assert sorted((r["part"], r["start"], r["tokens"]) for r in rows if r["doc_id"] == 1) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    total = Counter()
    for r in rows:
        total[r["container"]] += r["tokens"]
    assert max(total.values()) <= 2048 and len(total) == figures["containers"] and len(rows) == 9
    empty, figures = packing.pack(packing.pieces(sized.limit(0)))
    assert empty.count() == 0 and figures["containers"] == 0


def test_only_long_documents_are_split(spark, sf):
    from tidewatch.llm import queries as Q

    out = Q.p9_packed(spark, sf).cache()
    per = out.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("parts"))
    assert per.where("parts > 1 and n <= 2048").count() == 0
    assert out.groupBy("container").agg(F.sum("tokens").alias("n")).where("n > 2048").count() == 0
    assert {r["doc_id"] for r in Q.p9_found(spark, sf).collect()} == {r["doc_id"] for r in per.where("n > 2048").collect()}
