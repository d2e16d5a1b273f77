"""Functions and operators on small cases."""

from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text
from tallyforge.operators.lifecycle import retriable
from tallyforge.operators.merge import first_of, signature
from tallyforge.operators.rules import derive_additive
from tallyforge.sources.versioned import merged


def values(spark, items, make):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(make(F.col("x")).alias("y")).collect()]


def test_coercions_disagree(spark):
    assert [float(v) for v in values(spark, ["1,500", "1,500,000", None, " 12.5 "], numbers.garbage_number)] == [1.5, 0, 0, 12.5]
    assert values(spark, ["1,500", "-2.9", "x"], numbers.int_or_null) == [1, -2, None]
    assert values(spark, ["12.5", "1,500", "x"], numbers.int_or_zero) == [125, 1500, 0]
    assert values(spark, ["1.500.000", "1,500,000.50", "1.500,5", "12,5", "5 kg", "mười", "?"], numbers.measured_number) == [1500000, 1500000.5, 1500.5, 12.5, 5, 10, None]
    assert values(spark, ["Có", "không", "", "?"], numbers.boolean) == [True, False, False, None]


def test_dates(spark):
    assert values(spark, ["29/02/2025", "31/04/2026", "1/4/2026", "01/13/2026", "01/04/2019"], dates.date_code) == [None, "date_day_exceeds_month", "invalid_date_format", "date_month_out_of_range", "date_year_out_of_range"]
    assert values(spark, ["1 / 3 / 2026"], dates.clean_date) == ["01/03/2026"]


def test_text(spark):
    assert values(spark, ["Đội  cháy\nnổ"], text.fold) == ["ĐOI CHAY NO"]
    assert values(spark, ["cháyTổng3vụ,Nổ"], text.restore_spaces) == ["cháy Tổng 3 vụ, Nổ"]
    assert values(spark, ["công văn 12/CV và báo cáo 34/BC, kế hoạch 75/KV 30"], text.document_codes) == [["12/CV", "34/BC", "75/KV30"]]


def test_additive(spark):
    rows = spark.createDataFrame([(7, None, 0, 0), (None, 1, 2, 1), (3, 5, None, 2), (9, None, None, 3)], "t int, a int, b int, i int")
    out = derive_additive(rows, [("t", ["a", "b"])]).orderBy("i").collect()
    assert [(r.t, r.a, r.b) for r in out] == [(7, 7, 0), (3, 1, 2), (3, 5, 0), (9, None, None)]


def test_first_wins_in_any_input_order(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else " a") for i in range(20)] + [(50, "")], "o int, s string")
    for n in (1, 7):
        out = first_of(rows.repartition(n), signature([F.col("s")]), [F.col("o")]).collect()
        assert [r.o for r in out] == [0]


def test_upsert_keeps_creator(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "k int, n int, by string")
    new = spark.createDataFrame([(1, 9, "z"), (3, 1, "w")], "k int, n int, by string")
    assert sorted(map(tuple, merged(old, new, ["k"], keep=("by",)).collect())) == [(1, 9, "x"), (2, 6, "y"), (3, 1, "w")]


def test_retry(spark):
    assert values(spark, ["Timeout", "429 too many requests timeout", "boom"], retriable) == [True, False, False]
