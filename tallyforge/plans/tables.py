"""Stat tables read from cells and text. Role: an order is a report; its cells and lines are made of its key."""

from pyspark.sql import functions as F

from tallyforge.operators import cells
from tallyforge.plans.registry import query, read

_TABLES = "array(array(array('TT', 'Kết quả', 'Nội dung'), array('31', string(o_orderkey % 50), 'Kiểm tra'), array('33', string(o_orderkey % 7), ' Đột xuất :'), array('31', '9', 'lặp lại')))"
_TEXT = (
    r"CASE o_orderkey % 3 WHEN 1 THEN '31 Khác biệt 5\n55 Tổng số 20\n56 Sĩ quan 1\n57 Hạ sĩ quan 2\n58 Chuyên nghiệp 3\n59 Nghĩa vụ 4\n61 Công nhân 5'"
    r" WHEN 2 THEN concat('14. Tổng số vụ tai nạn: ', o_orderkey % 5, '\n14) khác') END"
)
_GRID = "('55', 'Tổng số', 20), ('56', 'Sĩ quan', 1), ('57', 'Hạ sĩ quan', 2), ('58', 'Chuyên nghiệp', 3), ('59', 'Nghĩa vụ', 4), ('61', 'Công nhân', 5), ('60', 'Chiến sĩ nghĩa vụ (hợp đồng lao động)', 5)"


def stat_reports(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 < 2, F.expr(_TABLES)).alias("tables"), F.expr(_TEXT).alias("text"))


@query(
    "SELECT o_orderkey, '31' AS stt, 'Kiểm tra' AS noi_dung, o_orderkey % 50 AS ket_qua FROM orders WHERE o_orderkey % 3 < 2"
    " UNION ALL SELECT o_orderkey, '33', 'Đột xuất', o_orderkey % 7 FROM orders WHERE o_orderkey % 3 < 2"
    " UNION ALL SELECT o_orderkey, '32', 'Kiểm tra định kỳ', greatest(0, o_orderkey % 50 - o_orderkey % 7) FROM orders WHERE o_orderkey % 3 < 2"
    f" UNION ALL SELECT o_orderkey, c, l, v FROM orders, (VALUES {_GRID}) t(c, l, v) WHERE o_orderkey % 3 = 1"
    " UNION ALL SELECT o_orderkey, '14', 'Tổng số vụ tai nạn', o_orderkey % 5 FROM orders WHERE o_orderkey % 3 = 2"
    " UNION ALL SELECT o_orderkey, '14', 'khác', 0 FROM orders WHERE o_orderkey % 3 = 2"
)
def stat_table_cascade(spark, sf_dir):
    """Tables first, then the grid's missing codes, else lines; swallowed rows computed."""
    return cells.cascade(stat_reports(spark, sf_dir), "o_orderkey", "tables", "text")


@query("SELECT o_orderkey, o_orderkey % 5 AS tong_so_vu_cnch FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 5 > 0")
def incident_count_from_table(spark, sf_dir):
    """X7."""
    rows = cells.cascaded(stat_reports(spark, sf_dir), "o_orderkey", "tables", "text")
    return rows.select("o_orderkey", F.explode(F.filter(F.array(cells.first_incidents(F.col("_rows"))), lambda n: n.isNotNull())).alias("tong_so_vu_cnch"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 5 ELSE 99 END AS cnch FROM orders")
def table_over_narrative(spark, sf_dir):
    """The table's value where it has the code, else the narrative's (here 99)."""
    reports = stat_reports(spark, sf_dir)
    values = cells.overriding(cells.parse_lines(reports, "o_orderkey", "text"), "o_orderkey", {"14": "tabled"})
    return reports.select("o_orderkey").join(values, "o_orderkey", "left").select("o_orderkey", F.coalesce("tabled", F.lit(99)).alias("cnch"))
