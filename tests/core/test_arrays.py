"""Searches in arrays against plain Python."""

import random

from pyspark.sql import functions as F

from shroudline.functions import arrays


def test_ranks_and_membership(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.choices(range(40), k=n)), x) for n in (0, 1, 2, 3, 7, 8, 9, 100) for x in (-1, 0, 5, 20, 39, 41)]
    df = spark.createDataFrame(rows, "a array<int>, x int")
    got = df.select("a", "x", arrays.rank(F.col("a"), F.col("x")).alias("r"), arrays.contains_sorted(F.col("a"), F.col("x")).alias("c")).collect()
    assert [(r["r"], r["c"]) for r in got] == [(sum(v < x for v in a), x in a) for a, x in rows]


def test_merged_ranges_cover_what_any_range_covers(spark):
    rng = random.Random(2)
    rows = [([(a, a + rng.choice([-1, 0, 1, 3, 30])) for a in rng.choices(range(60), k=n)],) for n in (0, 1, 2, 5, 6, 33)]
    df = spark.createDataFrame(rows, "r array<struct<s:int,e:int>>")
    points = F.sequence(F.lit(-2), F.lit(95))
    got = df.select(arrays.bind(arrays.merged(F.col("r"), "s", "e"), lambda m: F.transform(points, lambda x: arrays.covered_by(m, x))).alias("hit")).collect()
    assert [r["hit"] for r in got] == [[any(s <= x <= e for s, e in ranges) for x in range(-2, 96)] for (ranges,) in rows]


def test_prefix_maxima(spark):
    rows = [([],), ([3],), ([1, 5, 2, 7, 7, 0, 9, 1],)]
    got = spark.createDataFrame(rows, "a array<int>").select(arrays.prefix_max(F.col("a")).alias("m")).collect()
    assert [r["m"] for r in got] == [[], [3], [1, 5, 5, 7, 7, 7, 9, 9]]
