"""Rounding by exact binary values, against Python's own."""

import random

from pyspark.sql import functions as F

from tallyforge.operators.rules import half_even


def test_rounds_as_python_does(spark):
    rng = random.Random(2)
    values = [2.5, 0.5, 1.5, -2.5, 2.675, 1.005, 0.125, 0.375, -0.375, 1234.5, 99999.5, 0.285, 1.115, 0.045, 3.0, 0.0, 1e9 + 0.25, 1e30, None]
    values += [rng.choice([1, -1]) * (rng.randrange(10**5) + 0.5) / 10 ** rng.randrange(4) for _ in range(300)] + [rng.uniform(-1000, 1000) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(2)
    for digits in (0, 1, 2, 4):
        got = df.select("x", half_even(F.col("x"), digits).alias("y")).collect()
        for r in got:
            if r.x is None:
                assert r.y is None
            elif 0.01 < abs(r.x) < 1e6:
                assert r.y == round(r.x, digits), (r.x, digits)
