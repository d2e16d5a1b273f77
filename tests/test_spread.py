"""Work that is long for a row is dealt to many tasks, even where a table is one file of one row group."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import narrative as N
from tallyforge.operators import stats, validate
from tallyforge.operators.variants import nested
from tallyforge.plans import assembly, shapes

SF = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_reports_are_dealt(spark):
    assert tasks(assembly.reports(spark, SF).select("text")) > 1


@pytest.mark.parametrize("text", [None, "", "\n \n", "1. Công tác đảm bảo an ninh: 2. Công tác tham mưu: 3 công văn", "Thủ Đức, ngày 5 / 06 / 1995", "ngày 5 tháng 6 năm 1995\nngày 7/08/1996"])
def test_parts_from_shared_forms(spark, text):
    x = F.col("x")
    df = spark.createDataFrame([(text,)], "x string").select("x", N.lines(x).alias("l"), N.collapse(x).alias("f"))
    same = [(N.security_text(x), N.security_of(F.col("f"))), (N.advisory_section(x), N.advisory_of(F.col("f"))), (N.other_tasks(x), N.tasks_of(F.col("l"))), (N.header(x), N.header_of(F.col("l")))]
    row = df.select(*(a.eqNullSafe(b) for a, b in same), N.security_text(x).alias("security"), N.report_date(x).alias("day")).first()
    assert all(row[:4])
    assert row.day == {"T": "05/06/1995", "n": "05/06/1995"}.get((text or " ")[0], "")
    assert row.security == (None if text is None else "")


def test_forms_are_dealt_and_bound_once(spark):
    assert tasks(shapes.forms(spark, SF)) > 1
    spec = {"name": "a", "type": "number"}
    for _ in range(8):
        spec = {"name": "a", "type": "object", "fields": [spec]}
    # a value that was not bound stood in its warnings some 3 times a level
    plan = spark.sql("select '1' as j").select(nested(F.try_parse_json("j"), spec, F.lit("a")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get") <= 40


def test_invariants_read_period_once_and_repeats_in_order(spark):
    kinds = "h struct<thoi_gian_tu_den:string,ngay_bao_cao:string>, t struct<tong_so_vu_chay:long,tong_so_vu_no:long,tong_so_vu_cnch:long,tong_xe_hu_hong:long,tong_cong_van:long,tong_bao_cao:long,tong_ke_hoach:long,cong_tac_an_ninh:string>, s array<struct<stt:string,ket_qua:long>>, i array<struct<thoi_gian:string,ngay_xay_ra:string,dia_diem:string,noi_dung_tin_bao:string>>, d array<struct<so_ky_hieu:string>>, x array<string>"
    case = lambda *xs: [(None, day, place, None) for day, place in xs]
    rows = [
        (("1/6/1995 30/6/1995", "5/6/1995"), (0, 0, 0, 0, 0, 1, 0, ""), [("31", 4), (" 2 ", 1), ("31", 9), ("", 5), ("2", 0)], case(("1/7/1995", "b"), ("2/6/1995", "a"), ("1/7/1995", "b"), (None, " "), (None, ""), ("1/7/1995", "b"), ("2/6/1995", "a")), [("1/BC",), (" ",)], None),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kinds).withColumn("values", validate.stat_values(F.col("s")))
    out = df.select("values", validate.invariant_codes(*map(F.col, ("h", "t", "values", "i", "d", "x"))).alias("codes"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    got, none = out.collect()
    assert got["values"] == {"31": 9, "2": 0} and none["values"] == {}
    assert [c for c in got["codes"] if not c.startswith(("missing", "formula"))] == [f"date_mismatch:danh_sach_cnch[{k}].ngay_xay_ra_outside_period" for k in (1, 3, 6)] + [f"duplicate_incident_signature:{k}" for k in (3, 6, 7)]
    assert all(c.startswith("missing_stt:") for c in none["codes"])


def test_named_stats_hold_one_code_at_a_time(spark):
    rows = spark.createDataFrame([(1, 2, " 14 ", 5), (1, 1, "14", None), (1, 3, "x", 7), (2, 1, "99", 1), (2, 2, None, 1), (None, 5, "8", 3), (3, None, "8", 4)], "job int, place long, stt string, ket_qua long")
    named = stats.named_stats(rows, ["job"], F.col("place"))
    assert named._jdf.queryExecution().optimizedPlan().toString().count("min_by") == 1
    got = {r.job: {c: v for c, v in r.asDict().items() if c != "job" and v is not None} for r in named.collect()}
    assert got == {1: {"stt_14_tong_cnch": 0}, 2: {}, None: {"stt_08_tong_no": 3}, 3: {}}


def test_synced_rows_meet_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 5, " 17", 2, "a"), (1, 1, "16", 3, "b"), (None, 3, None, 1, "c")], "job int, place long, stt string, ket_qua long, noi_dung string")
    named = spark.createDataFrame([(1, 5, 3, 9), (None, None, 4, None), (7, 1, None, None)], "job int, stt_15_cnch_cuu_nguoi int, stt_16_cnch_truc_tiep int, stt_17_cnch_tu_thoat int")
    out = stats.synced(rows, named, "job", "place", {c: stats.STAT_FIELDS[c] for c in (15, 16, 17)})
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, out.collect()), key=repr)
    label = stats.STAT_LABELS[15]
    assert got == sorted([(1, 0, "15", 5, label), (1, 1, "16", 3, "b"), (1, 2, " 17", 2, "a"), (None, 0, "16", 4, "STT 16"), (None, 1, None, 1, "c"), (7, 0, "15", 1, label)], key=repr)
