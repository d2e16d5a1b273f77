"""One payload of one report (survey rows X11, P21), put together of what the narrative and the table tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import narrative as N
from tallyforge.functions.text import collapse, counter, document_codes, document_type, folded, spaced
from tallyforge.operators import cells

#: Counts that the table's totals replace, by code, and nouns of documents that the advisory section counts.
TABLED = {"2": "tong_so_vu_chay", "8": "tong_so_vu_no", "14": "tong_so_vu_cnch"}
NOUNS = {"tong_cong_van": "công văn", "tong_bao_cao": "báo cáo", "tong_ke_hoach": "kế hoạch"}


def narrative_arrays(joined, upper, tasks, advisory, rescue):
    """X11: incidents (by rules from the rescue section), damaged vehicles, documents and other tasks of a report: its lines ``joined`` by blanks, its collapsed text in ``upper`` case, the part with its ``tasks``."""
    documents = F.transform(document_codes(advisory), lambda c: F.struct(c.alias("so_ky_hieu"), document_type(c).alias("loai")))
    return N.incidents(rescue), N.vehicles_of(joined, upper), documents, N.tasks_in(tasks)


def assembled(reports: DataFrame, key: str, text: str, tables: str, table_text: str) -> DataFrame:
    """Per report (``key``, ``text``, ``tables``: its tables' cells, ``table_text``: its table as text): header, counts, arrays and stat rows.

    A count that the table has a total for is the table's (X8); a count of rescues that neither tells is the first row's that speaks of incidents (P21).
    Rows of the table are gathered by one grouped pass and joined by the key; all else is a projection of the report's row, whose parts are columns before what is read from them.
    """
    listed = cells.cascaded(reports.select(key, F.col(tables).alias("tables"), F.col(table_text).alias("text")), key, "tables", "text")
    number = lambda r: F.coalesce(r["stt"].try_cast("int"), F.lit(9999)).alias("n")
    sorted_ = F.sort_array(F.transform("_rows", lambda r: F.struct(number(r), r["stt"].alias("stt"), r["noi_dung"].alias("noi_dung"), r["ket_qua"].alias("ket_qua"))))
    stats = F.when(F.size("_rows") > 0, F.transform(sorted_, lambda r: F.struct(r["stt"].alias("stt"), r["noi_dung"].alias("noi_dung"), r["ket_qua"].alias("ket_qua"))))
    total = lambda code: F.array_max(F.transform(F.filter("_rows", lambda r: r["stt"] == code), lambda r: r["ket_qua"]))
    tabled = listed.select(key, stats.alias("bang_thong_ke"), *(total(c).alias(f"_{f}") for c, f in TABLED.items()), cells.first_incidents(F.col("_rows")).alias("_listed"))
    x, held, joined, flat, upper = map(F.col, ("_x", "_lines", "_joined", "_flat", "_upper"))
    cut = reports.select(key, F.col(text).alias("_x"), spaced(F.col(text)).alias("_wide"))
    cut = cut.select(key, "_x", "_wide", N.lines(x, F.col("_wide")).alias("_lines"))
    cut = cut.select(key, "_x", "_wide", "_lines", F.array_join(held, " ").alias("_joined"))
    cut = cut.select(key, "_x", "_lines", "_joined", F.when(F.col("_wide"), collapse(joined)).otherwise(joined).alias("_flat"))
    cut = cut.select(key, "_x", "_lines", "_joined", "_flat", F.upper(flat).alias("_upper"))
    # where both have the same length, places in the upper case are those in the text
    tasked = F.when((F.length(upper) == F.length(flat)) & (joined == flat), N.tasks_part(joined, upper)).otherwise(joined)
    parts = cut.select(key, "_joined", "_flat", "_upper", N.header_of(held).alias("_head"), folded(upper).alias("_folded"), N.advisory_of(flat).alias("_advisory"), N.rescue_of(x, held).alias("_rescue"), tasked.alias("_tasks"))
    head, advisory, rescue = F.col("_head"), F.col("_advisory"), F.col("_rescue")
    incidents, vehicles, documents, tasks = narrative_arrays(joined, upper, F.col("_tasks"), advisory, rescue)
    told = parts.select(
        key, F.struct(N.report_number(head).alias("so_bao_cao"), N.report_date(head, upper).alias("ngay_bao_cao"), N.reporting_unit(head).alias("don_vi_bao_cao"), N.reporting_period(head).alias("thoi_gian_tu_den")).alias("header"),
        N.security_of(flat).alias("cong_tac_an_ninh"), rescue.alias("chi_tiet_cnch"), *(counter(advisory, noun).alias(f) for f, noun in NOUNS.items()),
        incidents.alias("danh_sach_cnch"), vehicles.alias("danh_sach_phuong_tien_hu_hong"), documents.alias("danh_sach_cong_van_tham_muu"), tasks.alias("danh_sach_cong_tac_khac"), *(N.counted(F.col("_folded"), name).alias(f"said_{name}") for name in N.COUNTS),
    )
    both = told.join(tabled, key, "left")
    count = {f: F.coalesce(f"_{f}", f"said_{f}") for f in TABLED.values()}
    count["tong_so_vu_cnch"] = F.when(count["tong_so_vu_cnch"] == 0, F.coalesce("_listed", F.lit(0))).otherwise(count["tong_so_vu_cnch"])
    others = {name: F.col(f"said_{name}") for name in N.COUNTS if name not in count}
    counts = F.struct(*(c.cast("bigint").alias(f) for f, c in (count | others).items()), *NOUNS, F.size("danh_sach_phuong_tien_hu_hong").alias("tong_xe_hu_hong"), "cong_tac_an_ninh", "chi_tiet_cnch")
    return both.select(key, "header", counts.alias("nghiep_vu"), "bang_thong_ke", "danh_sach_cnch", "danh_sach_phuong_tien_hu_hong", "danh_sach_cong_van_tham_muu", "danh_sach_cong_tac_khac")
