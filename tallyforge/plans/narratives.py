"""Report narratives read back by pattern. Role: an order is a report, its text made of its own columns."""

from pyspark.sql import functions as F

from tallyforge.functions import narrative as N
from tallyforge.functions.text import fold
from tallyforge.plans.registry import query, read


def said(spark, sf_dir, text: str):
    """(o_orderkey, o_orderdate, text) of every order; ``text`` is a Spark SQL expression."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.expr(text).alias("text"))


_HEAD = (
    r"concat('ĐỘI CC&CNCH SỐ ', o_orderkey % 7, '\nSố: ', o_orderkey % 1000, '/BC-KV 30\n(Từ 07h30 ngày ', date_format(date_sub(o_orderdate, 1), 'dd/MM/yyyy'), ' đến 07h30 ngày ', date_format(o_orderdate, 'dd/MM/yyyy'), ')\n',"
    r" if(o_orderkey % 2 = 0, concat('Thủ Đức, ngày ', day(o_orderdate), ' tháng ', month(o_orderdate), ' năm ', year(o_orderdate)), concat('Thủ Đức, ngày ', date_format(o_orderdate, 'd / MM / yyyy'))), '\nI. KẾT QUẢ')"
)


@query("SELECT o_orderkey, (o_orderkey % 1000) || '/BC-KV30' AS number, strftime(o_orderdate, '%d/%m/%Y') AS day, 'ĐỘI CC&CNCH SỐ ' || (o_orderkey % 7) AS unit, 'Từ 07h30 ngày ' || strftime(o_orderdate - INTERVAL 1 DAY, '%d/%m/%Y') || ' đến 07h30 ngày ' || strftime(o_orderdate, '%d/%m/%Y') || ')' AS period FROM orders")
def header_fields(spark, sf_dir):
    """T7-T10."""
    head = F.col("head")
    rows = said(spark, sf_dir, _HEAD).select("o_orderkey", N.header(F.col("text")).alias("head"))
    return rows.select("o_orderkey", N.report_number(head).alias("number"), N.report_date(head).alias("day"), N.reporting_unit(head).alias("unit"), N.reporting_period(head).alias("period"))


_COUNTS = "concat('Tình hình cháy: Không. Xảy ra ', o_orderkey % 5, ' vụ cháy.\n Tình hình nổ: ', o_orderkey % 3, '. Tình hình công tác cứu nạn, cứu hộ: ', if(o_orderkey % 4 = 0, 'Không', string(o_orderkey % 4)), '. Quân số trực là ', o_orderkey % 40)"


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS tong_so_vu_chay, CAST(o_orderkey % 3 AS INTEGER) AS tong_so_vu_no, CAST(o_orderkey % 4 AS INTEGER) AS tong_so_vu_cnch, CAST(o_orderkey % 40 AS INTEGER) AS quan_so_truc FROM orders")
def narrative_counts(spark, sf_dir):
    """T11."""
    rows = said(spark, sf_dir, _COUNTS).select("o_orderkey", fold(F.col("text")).alias("folded"))
    return rows.select("o_orderkey", *(N.counted(F.col("folded"), name).alias(name) for name in N.COUNTS))


_SECTIONS = r"concat('I. KẾT QUẢ\n3. Tình hình cứu nạn: ', o_orderkey % 9, ' vụ\nII. CÔNG TÁC\n1. Công tác đảm bảo an ninh: ', if(o_orderkey % 2 = 0, 'CCC: PCCC: ', ''), 'Không\n2. Công tác tham mưu: ', o_orderkey % 8, ' công văn\n3. Công tác khác: trực gác ', o_orderkey % 6, '; vệ sinh; a')"


@query("SELECT o_orderkey, '3. Tình hình cứu nạn: ' || (o_orderkey % 9) || ' vụ' AS rescue, 'Không' AS security, (o_orderkey % 8) || ' công văn' AS advisory, 'trực gác ' || (o_orderkey % 6) || '|vệ sinh' AS tasks FROM orders")
def narrative_sections(spark, sf_dir):
    """T12, T14, T15, T17, T20."""
    x = F.col("text")
    rows = said(spark, sf_dir, _SECTIONS)
    return rows.select("o_orderkey", N.rescue_details(x).alias("rescue"), N.security_text(x).alias("security"), N.advisory_section(x).alias("advisory"), F.array_join(N.other_tasks(x), "|").alias("tasks"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'đã dập tắt ' || o_orderkey WHEN 1 THEN 'nhẹ' ELSE '' END AS result FROM orders")
def result_labels(spark, sf_dir):
    """The first of three fields with text besides its labels."""
    k = F.col("o_orderkey") % 3
    first = F.when(k == 0, F.concat(F.lit("Kết quả: Thiệt hại: đã dập tắt "), F.col("o_orderkey").cast("string"), F.lit(".;"))).when(k == 1, "ket qua : ")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.result_text(first, F.lit(" "), F.when(k == 1, "thiệt hại: nhẹ,")).alias("result"))


_PLATE = "(10 + o_orderkey % 80) || 'A-' || (100 + o_orderkey % 900) || '.52'"


@query(f"SELECT o_orderkey, unnest(['chữa cháy ' || p, 'thang 61CD-002.85', 'bồn 61A-001.11']) AS bien_so, unnest(['hư hỏng (đang sửa)', 'hư hỏng (đang sửa)', 'hết kiểm định']) AS tinh_trang FROM (SELECT o_orderkey, {_PLATE} AS p FROM orders)")
def vehicle_list(spark, sf_dir):
    """T19, W3."""
    rows = said(spark, sf_dir, rf"concat('Xe chữa cháy ', {_PLATE}, ', xe thang 61 CD-002.85\như hỏng (đang sửa và xe bồn 61A-001.11 hết kiểm định')")
    return rows.select("o_orderkey", F.explode(N.damaged_vehicles(F.col("text"))).alias("v")).select("o_orderkey", "v.bien_so", "v.tinh_trang")


_CASE = "'Vào lúc ', lpad(o_orderkey % 24, 2, '0'), ' giờ 33 phút ngày ', date_format(o_orderdate, 'd/M/yyyy'), ', nhận tin báo từ dân, cháy cỏ xảy ra tại địa chỉ: khu đất số ', o_orderkey, '. Đội xuất 2 xe chữa cháy, 12 CBCS. Thiệt hại: Không.'"
_TIME = "lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':33 ngày '"


@query(f"SELECT o_orderkey, CAST(stt AS INTEGER) AS stt, {_TIME} || strftime(o_orderdate, '%d/%m/%Y') AS thoi_gian, strftime(o_orderdate, '%d/%m/%Y') AS ngay_xay_ra, 'khu đất số ' || o_orderkey AS dia_diem, 'cháy cỏ' AS noi_dung_tin_bao, '2 xe chữa cháy, 12 CBCS' AS luc_luong_tham_gia, '' AS thong_tin_nan_nhan, 'Không' AS ket_qua_xu_ly, '' AS thiet_hai FROM orders, (VALUES (1), (2)) t(stt) WHERE o_orderkey % 5 < 4 AND (stt = 1 OR o_orderkey % 5 < 3)")
def incident_records(spark, sf_dir):
    """One or two incidents a report, told apart by number or by time."""
    texts = f"CASE o_orderkey % 5 WHEN 4 THEN 'trời đẹp' WHEN 3 THEN concat({_CASE}) WHEN 2 THEN concat({_CASE}, ' ', {_CASE}) ELSE concat('3. cứu nạn 5.1 ', {_CASE}, '\n5.2 ', {_CASE}) END"
    return said(spark, sf_dir, texts).select("o_orderkey", F.explode(N.incidents(F.col("text"))).alias("r")).select("o_orderkey", "r.*")


@query(f"SELECT o_orderkey, {_TIME} || CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/' || strftime(o_orderdate, '%Y') AS thoi_gian, 'khu đất số ' || o_orderkey AS dia_diem, count(*) AS n FROM orders, (VALUES (1), (2)) t(i) GROUP BY ALL")
def summary_incident_list(spark, sf_dir):
    """Contexts overlap."""
    rows = said(spark, sf_dir, f"concat({_CASE}, ' ', {_CASE})").select("o_orderkey", F.explode(N.summary_incidents(F.col("text"))).alias("r"))
    return rows.groupBy("o_orderkey", "r.thoi_gian", "r.dia_diem").agg(F.count("*").alias("n"))
