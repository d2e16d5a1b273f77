"""Whole payloads of whole reports. Role: an order is a report; its text is made of its own columns, its table of its lines."""

from pyspark.sql import functions as F

from tallyforge.operators.assemble import assembled
from tallyforge.plans.narratives import _COUNTS, _HEAD, _SECTIONS
from tallyforge.plans.registry import query, read, spread



def reports(spark, sf_dir):
    """(o_orderkey, text, tables, table_text): head, counts and sections as text; the lines' codes and quantities as a table's cells, 14 and 31 for the first two kinds of line."""
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", F.expr(f"concat({_HEAD}, '\\n', {_COUNTS}, '\\n', {_SECTIONS})").alias("text"))
    code = F.when(F.col("l_linenumber") == 1, "14").when(F.col("l_linenumber") == 2, "31").otherwise((F.col("l_linenumber") + 40).cast("string"))
    cell = F.array(code, F.concat(F.lit("Mục "), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("long").cast("string"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", cell.alias("cell")))), lambda x: x["cell"]).alias("cells"))
    head = F.array(F.array(*map(F.lit, ("TT", "Nội dung", "Kết quả"))))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "text", F.when(F.col("cells").isNotNull(), F.array(F.concat(head, "cells"))).alias("tables"), F.lit("").alias("table_text"))


@query("""WITH t AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, arg_min(CAST(l_quantity AS BIGINT), row(l_partkey, l_suppkey, l_quantity)) FILTER (l_linenumber = 1) AS v14 FROM lineitem GROUP BY 1)
SELECT o_orderkey, (o_orderkey % 1000) || '/BC-KV30' AS so_bao_cao, strftime(o_orderdate, '%d/%m/%Y') AS ngay_bao_cao, o_orderkey % 5 AS tong_so_vu_chay, o_orderkey % 3 AS tong_so_vu_no, coalesce(v14, o_orderkey % 4) AS tong_so_vu_cnch, CAST(o_orderkey % 8 AS INTEGER) AS tong_cong_van, 'Không' AS cong_tac_an_ninh, CAST(coalesce(n, 0) AS INTEGER) AS stat_rows, 'trực gác ' || (o_orderkey % 6) || '|vệ sinh' AS tasks FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def assembled_payload(spark, sf_dir):
    """Header, counts, lists and table of each report in one payload."""
    p = assembled(reports(spark, sf_dir), "o_orderkey", "text", "tables", "table_text")
    n = F.col("nghiep_vu")
    return p.select("o_orderkey", "header.so_bao_cao", "header.ngay_bao_cao", *(n[f].alias(f) for f in ("tong_so_vu_chay", "tong_so_vu_no", "tong_so_vu_cnch", "tong_cong_van", "cong_tac_an_ninh")), F.greatest(F.coalesce(F.size("bang_thong_ke"), F.lit(0)), F.lit(0)).alias("stat_rows"), F.array_join("danh_sach_cong_tac_khac", "|").alias("tasks"))
