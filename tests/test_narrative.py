"""Narrative patterns on small reports."""

from pyspark.sql import functions as F

from tallyforge.functions import narrative as N


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x")).alias("y")).first().y


def rows(items):
    return [tuple(r) for r in items]


HEAD = "\n\nĐỘI CC&CNCH KHU VỰC 30\nSố: 201/BC-KV 30\n(Từ 07h30' ngày 31/03/2026 đến 07h30' ngày 01/04/2026)\nThủ Đức, ngày 1 / 04 / 2026\n"


def test_header(spark):
    head = lambda f: lambda x: f(N.header(x))
    assert one(spark, HEAD, head(N.report_number)) == "201/BC-KV30"
    assert one(spark, HEAD, head(N.report_date)) == "01/04/2026"
    assert one(spark, "ngày 1 tháng 4 năm 2026", head(N.report_date)) == "01/04/2026"
    assert one(spark, HEAD, head(N.reporting_unit)) == "ĐỘI CC&CNCH KHU VỰC 30"
    assert one(spark, HEAD, head(N.reporting_period)) == "Từ 07h30' ngày 31/03/2026 đến 07h30' ngày 01/04/2026)"
    assert one(spark, "Từ 7 giờ\nđến - 8 giờ sáng", head(N.reporting_period)) == "Từ 7 giờ đến - 8 giờ sáng"
    assert one(spark, "(Từ 7 giờ)", head(N.reporting_period)) == "Từ 7 giờ"
    for f in (N.report_number, N.report_date, N.reporting_unit, N.reporting_period):
        assert one(spark, "", head(f)) == "" and one(spark, None, head(f)) == ""


def test_counts(spark):
    count = lambda name: lambda x: N.counted(N.fold(x), name)
    assert one(spark, "Tình hình cháy: Không. Xảy ra 2 vụ cháy", count("tong_so_vu_chay")) == 2
    assert one(spark, "Tình hình nổ: 3", count("tong_so_vu_no")) == 3
    assert one(spark, "không có gì", count("tong_so_vu_cnch")) == 0
    assert one(spark, "+ Quân số trực: 25 đồng chí.", count("quan_so_truc")) == 25


def test_sections(spark):
    text = "I. KẾT QUẢ\n3. Tình hình cứu nạn: có 1 vụ\nchi tiết\n5. khác\nII. CÔNG TÁC\n1. Công tác đảm bảo an ninh: CCC: PCCC: Không\n2. Công tác tham mưu: 3 công văn\n3. Công tác khác: trực gác đêm; vệ sinh xe; a\n"
    assert one(spark, text, N.rescue_details) == "3. Tình hình cứu nạn: có 1 vụ\nchi tiết\n5. khác"
    assert one(spark, "trời đẹp\nmột vụ tai nạn\nsự cố nhỏ", N.rescue_details) == "một vụ tai nạn\nsự cố nhỏ"
    assert one(spark, text, N.security_text) == "Không"
    assert one(spark, "an ninh: tốt.", N.security_text) == "tốt"
    assert one(spark, text, N.advisory_section) == "3 công văn"
    assert one(spark, text, N.other_tasks) == ["trực gác đêm", "vệ sinh xe"]
    assert one(spark, "", N.other_tasks) == [] and one(spark, None, N.other_tasks) is None
    assert one(spark, "CCC:", N.scrub_prefix) == "CCC:" and one(spark, " pccc: tốt", N.scrub_prefix) == "tốt"
    assert one(spark, "Kết quả: Thiệt hại: Kết quả: đã dập tắt.", N.result_text) == "đã dập tắt"
    assert one(spark, "Kết quả: ", lambda x: N.result_text(x, F.lit(" thiet hai: nhẹ;"), F.lit("z"))) == "nhẹ"


def test_vehicles(spark):
    text = "Xe chữa cháy 61 A-003.52, xe thang 61CD-002.85\như hỏng (đang sửa chữa và xe bồn 61A-001.11 hết kiểm định"
    assert rows(one(spark, text, N.damaged_vehicles)) == [("chữa cháy 61A-003.52", "hư hỏng (đang sửa chữa)"), ("thang 61CD-002.85", "hư hỏng (đang sửa chữa)"), ("bồn 61A-001.11", "hết kiểm định")]
    assert rows(one(spark, "Có máy bơm số 3 hư hỏng.", N.damaged_vehicles)) == [("máy bơm số 3 hư hỏng", "")]
    assert one(spark, "", N.damaged_vehicles) == []


CASE = "Vào lúc 16 giờ 33 phút ngày 2/4/2026, nhận tin báo từ người dân, cháy cỏ xảy ra tại địa chỉ: khu đất trống đường số 5. Đội xuất 2 xe chữa cháy, 12 CBCS. Thiệt hại: Không."


def test_incidents(spark):
    got = one(spark, f"3. Tình hình cứu nạn 5.1 {CASE} 5.2 {CASE}", N.incidents)
    assert [r.stt for r in got] == [1, 2]
    r = got[0]
    assert (r.thoi_gian, r.ngay_xay_ra, r.dia_diem) == ("16:33 ngày 02/04/2026", "02/04/2026", "khu đất trống đường số 5")
    assert (r.noi_dung_tin_bao, r.luc_luong_tham_gia, r.ket_qua_xu_ly, r.thiet_hai) == ("cháy cỏ", "2 xe chữa cháy, 12 CBCS", "Không", "")
    assert len(one(spark, f"{CASE} {CASE}", N.incidents)) == 2
    assert one(spark, "trời đẹp", N.incidents) is None
    found = one(spark, f"{CASE} {CASE}", N.summary_incidents)
    assert [r.thoi_gian for r in found] == ["16:33 ngày 2/4/2026"] * 2 and found[1].dia_diem == "khu đất trống đường số 5"
    assert one(spark, "x" * 81, lambda x: N.plausible(x, "noi_dung_tin_bao")) == "" and one(spark, "đang đi", lambda x: N.plausible(x, "ket_qua_xu_ly")) == ""


def test_vehicles_are_looked_for_once(spark):
    """A lambda's expressions are worked out at each place that names them: the sentence was searched again for each vehicle."""
    df = spark.createDataFrame([("Xe thang 61CD-002.85, xe bồn 61A-001.11 và xe 61A-001.12 (nhỏ hỏng",)], "x string").select(N.damaged_vehicles(F.col("x")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("chờ thanh lý") == 1
    assert [tuple(v) for v in df.first().v] == [("thang 61CD-002.85", "(nhỏ hỏng)"), ("bồn 61A-001.11", "(nhỏ hỏng)"), ("61A-001.12", "(nhỏ hỏng)")]
