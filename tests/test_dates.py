"""Dates read day first against the parser that this grammar stands for."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.dates import coerced_date, free_date

parser = pytest.importorskip("dateutil.parser")


def texts():
    rng = random.Random(10)
    months = ["Jan", "february", "MAR", "April", "may", "Sept", "Dec"]
    out = []
    for _ in range(40):
        d, m, y = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1990, 2060)
        name = rng.choice(months)
        sep = rng.choice(["-", "/", ".", " "])
        out += [f"{d} {name} {y}", f"{name} {d}, {y}", f"{y} {name} {d}", f"{d}{sep}{name}{sep}{y}", f"{d}th of {name} {y}", f"Monday, {d} {name} {y}", f"{d:02d}{sep}{m:02d}{sep}{y % 100:02d}",
                f"{y}{m:02d}{d:02d}", f"{y}-{m:02d}-{d:02d} 10:20:30", f"{y}-{m:02d}-{d:02d}T10:20", f"{d}/{m}/{y} 7:05 PM", f"{d:02d}.{m:02d}.{y} at 23:59", f"{m}/{d}/{y % 100:02d} 1:00", f"{d} {name} {y % 100:02d}", f"{name}-{y}-{d}"]
    out += ["2024-02-30 10:00", "31/12/2024 24:00", "13:61 1/2/2024", "32 Jan 2024", "x 1 Jan 2024", "99-Jan-05", "05-99-Jan", "Fri 7 mar 2025 10:00:00 UTC", "2025-03-07T10:00:00Z", "2025-03-07T10:00:00+07:00", "20250307T101112", "250307", "7/3/25"]
    return list(dict.fromkeys(out))


def test_agrees_with_the_general_parser(spark):
    said = texts()
    assert len(said) >= 300
    got = {r.x: r.d for r in spark.createDataFrame([(t,) for t in said], "x string").select("x", F.date_format(free_date(F.col("x")), "yyyy-MM-dd").alias("d")).collect()}
    wrong = []
    for t in said:
        try:
            want = parser.parse(t, dayfirst=True).strftime("%Y-%m-%d")
        except (ValueError, OverflowError):
            want = None
        if got[t] != want:
            wrong.append((t, got[t], want))
    assert not wrong, wrong[:20]


def test_what_lacks_a_part_is_no_date(spark):
    said = ["March 2024", "12/5", "10:30", "next week", "5", "a b c", "1.5.2.3", "1 2 3 2024", "Jan Feb 2024", ""]
    got = spark.createDataFrame([(t,) for t in said], "x string").select(free_date(F.col("x")).alias("d")).collect()
    assert [r.d for r in got] == [None] * len(said)


def test_in_a_lambda(spark):
    row = spark.createDataFrame([(["7 mar 2025", "?"],)], "x array<string>").select(F.transform("x", lambda t: coerced_date(t)["value"]).alias("v")).first()
    assert row.v == ["07/03/2025", "?"]
