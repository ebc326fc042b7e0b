"""Range joins against loops, with intervals of every length."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan.operators import ranges


def drawn(seed, n):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        lo = draw.choice([draw.randint(-(10**6), 10**6), 60_000 * draw.randint(-20, 20), draw.randint(0, 1 << 41)])
        out.append((k, draw.randint(0, 2), lo, lo + draw.choice([-7, 0, 1, 500, 59_999, 60_000, 60_001, 960_000, 10**7, 1 << 40])))
    return out


@pytest.mark.parametrize("width", [1_000, 60_000])
def test_points(spark, width):
    spans = drawn(1, 150) + [(900, 1, -(1 << 62), 1 << 62), (901, 0, 5, (1 << 63) - 1)]
    draw = random.Random(2)
    points = [(k, draw.randint(0, 2), draw.choice([draw.randint(-(10**6), 2 * 10**6), draw.choice(spans)[2], draw.choice(spans)[3]])) for k in range(150)] + [(999, 1, None)]
    p = spark.createDataFrame(points, "p bigint, key int, t bigint")
    s = spark.createDataFrame(spans, "s bigint, key int, lo bigint, hi bigint")
    got = sorted((r.p, r.s) for r in ranges.points_in(p, s, "key", F.col("t"), F.col("lo"), F.col("hi"), width).collect())
    short = s.where("s < 900 and hi - lo between -10 and 3000000")  # many times longer than what is promised
    hinted = sorted((r.p, r.s) for r in ranges.points_in(p, short, "key", F.col("t"), F.col("lo"), F.col("hi"), width, longest_ms=700).collect())
    assert hinted == [x for x in got if x[1] in {r.s for r in short.collect()}]
    assert got == sorted((a, b) for a, k, t in points for b, q, lo, hi in spans if k == q and t is not None and lo <= t < hi) and got


@pytest.mark.parametrize("width", [1_000, 60_000])
def test_touching(spark, width):
    one, two = drawn(3, 120), drawn(4, 120) + [(900, 1, -(1 << 61), 1 << 61)]
    a = spark.createDataFrame(one, "a bigint, key int, a_lo bigint, a_hi bigint")
    b = spark.createDataFrame(two, "b bigint, key int, b_lo bigint, b_hi bigint")
    got = sorted((r.a, r.b) for r in ranges.touching(a, b, "key", F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), width).collect())
    want = sorted((i, j) for i, k, lo, hi in one for j, q, low, high in two if k == q and hi >= low and lo <= high and max(lo, low) <= min(max(lo, hi), max(low, high)))
    assert got == want and got


def test_long_intervals_have_few_copies(spark):
    spans = spark.createDataFrame([(k, 0, 1 << k) for k in range(1, 62)], "s int, lo bigint, hi bigint")
    level = ranges.level_of(ranges._length(F.col("lo"), F.col("hi")), 60_000)
    cells = spans.withColumn("level", level).select("s", (ranges.cell(F.col("hi") - 1, F.col("level"), 60_000) - ranges.cell(F.col("lo"), F.col("level"), 60_000) + 1).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 2
    many = spark.range(500).select(F.lit(0).alias("key"), (F.col("id") * 1000).alias("lo"), F.lit(1 << 40).alias("hi"))
    points = spark.range(500).select(F.lit(0).alias("key"), (F.col("id") * 1000).alias("t"))
    assert ranges.points_in(points, many, "key", F.col("t"), F.col("lo"), F.col("hi")).count() == 500 * 501 // 2


def test_empty_sides(spark):
    p = spark.createDataFrame([], "key int, t bigint")
    s = spark.createDataFrame([], "key int, lo bigint, hi bigint")
    assert ranges.points_in(p, s, "key", F.col("t"), F.col("lo"), F.col("hi")).count() == 0
    b = s.withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"})
    assert ranges.touching(s, b, "key", F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi")).count() == 0
