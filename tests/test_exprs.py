"""Exact rounding helpers against Python's Decimal arithmetic."""

import random
from decimal import ROUND_HALF_UP, Decimal as D

from pyspark.sql import functions as F

from assetlens.functions.exprs import exact_avg, pct, round_ratio


def _want(a, b, digits):
    if b == 0:
        return None
    # exact: the quotient of two integers, scaled, rounded half away from zero
    exact = D(a) * 10 ** digits / D(b)
    return exact.to_integral_value(rounding=ROUND_HALF_UP).scaleb(-digits)


def test_round_ratio_signs_and_halves(spark):
    rnd = random.Random(3)
    pairs = [(5, 2), (-5, 2), (5, -2), (-5, -2), (1, 8), (-1, 8), (0, 7), (7, 0), (15, 200), (-15, 200)]
    pairs += [(rnd.randint(-10**9, 10**9), rnd.choice([-1, 1]) * rnd.randint(1, 10**6)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for digits in (0, 1, 2, 3):
        got = df.select("a", "b", round_ratio("a", "b", digits).alias("r")).collect()
        for r in got:
            assert r.r == _want(r.a, r.b, digits), (r.a, r.b, digits, r.r)


def test_decimal_scales(spark):
    df = spark.createDataFrame([(D("1.00"), 1), (D("1.01"), 1), (D("-2.50"), 1)],
                               "c decimal(12,2), g int")
    r = df.groupBy("g").agg(exact_avg("c", 2, scale=2).alias("avg"),
                            exact_avg("c", 1, scale=2).alias("avg1")).first()
    # (1.00 + 1.01 - 2.50) / 3 = -0.1633...
    assert (r.avg, r.avg1) == (D("-0.16"), D("-0.2"))
    half = spark.createDataFrame([(D("1.00"), D("1.01"))], "x decimal(12,2), y decimal(12,2)")
    # (1.00 + 1.01) / 2 = 1.005 exactly -> 1.01
    assert half.select(round_ratio(F.col("x") + F.col("y"), F.lit(2), 2, num_scale=2).alias("r")).first().r == D("1.01")
    assert half.select(pct("x", "y", 3, scale=2).alias("p")).first().p == D("99.010")
