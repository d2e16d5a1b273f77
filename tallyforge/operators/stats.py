"""Stat tables and what reports make of many of them (survey rows P6, P7, P9, A13, A17, A18, A20, A21, A25-A27, A29).

Tables are normalised: one row a stat row, incident or vehicle of a job, with its place. What a payload nests is joined by grouped
aggregates with map-side partial results, so no report is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import dates_in
from tallyforge.functions.narrative import result_text
from tallyforge.functions.numbers import int_or_zero, stripped
from tallyforge.functions.text import let
from tallyforge.operators.rules import EQUATIONS, derive_additive

#: The named field of each stat code.
STAT_FIELDS = {
    2: "stt_02_tong_chay", 3: "stt_03_chay_chet", 4: "stt_04_chay_thuong", 5: "stt_05_chay_cuu_nguoi", 6: "stt_06_chay_thiet_hai", 7: "stt_07_chay_cuu_tai_san",
    8: "stt_08_tong_no", 9: "stt_09_no_chet", 10: "stt_10_no_thuong", 11: "stt_11_no_cuu_nguoi", 12: "stt_12_no_thiet_hai", 13: "stt_13_no_cuu_tai_san",
    14: "stt_14_tong_cnch", 15: "stt_15_cnch_cuu_nguoi", 16: "stt_16_cnch_truc_tiep", 17: "stt_17_cnch_tu_thoat", 18: "stt_18_cnch_thi_the", 19: "stt_19_cnch_cuu_tai_san",
    22: "stt_22_tt_mxh_tong", 23: "stt_23_tt_mxh_tin_bai", 24: "stt_24_tt_mxh_hinh_anh", 25: "stt_25_tt_mxh_video", 27: "stt_27_tt_so_cuoc", 28: "stt_28_tt_so_nguoi", 29: "stt_29_tt_to_roi",
    31: "stt_31_kiem_tra_tong", 32: "stt_32_kiem_tra_dinh_ky", 33: "stt_33_kiem_tra_dot_xuat", 34: "stt_34_vi_pham_phat_hien", 35: "stt_35_xu_phat_tong", 36: "stt_36_xu_phat_canh_cao",
    37: "stt_37_xu_phat_tam_dinh_chi", 38: "stt_38_xu_phat_dinh_chi", 39: "stt_39_xu_phat_tien_mat", 40: "stt_40_xu_phat_tien", 43: "stt_43_pa_co_so_duyet", 44: "stt_44_pa_co_so_thuc_tap",
    46: "stt_46_pa_giao_thong_duyet", 47: "stt_47_pa_giao_thong_thuc_tap", 49: "stt_49_pa_cong_an_duyet", 50: "stt_50_pa_cong_an_thuc_tap", 52: "stt_52_pa_cnch_ca_duyet",
    53: "stt_53_pa_cnch_ca_thuc_tap", 55: "stt_55_hl_tong_cbcs", 56: "stt_56_hl_chi_huy_phong", 57: "stt_57_hl_chi_huy_doi", 58: "stt_58_hl_can_bo_tieu_doi", 59: "stt_59_hl_chien_sy",
    60: "stt_60_hl_lai_xe", 61: "stt_61_hl_lai_tau",
}
#: Labels of codes that are added to a table.
STAT_LABELS = {
    15: "Số người cứu được (=STT 16+STT 17)", 32: "Kiểm tra định kỳ", 33: "Kiểm tra đột xuất theo chuyên đề", 35: "Tổng số cơ sở bị xử phạt VPHC về PCCC (=STT 36+…+STT 39)",
    55: "Tổng số CBCS tham gia huấn luyện (=STT 56+…+STT 61)", 60: "Lái xe CC và CNCH",
}


def code_of(stt: Column) -> Column:
    """A stat code as a number; null where the text is none."""
    return stripped(stt).try_cast("int")


def named_stats(rows: DataFrame, keys: list[str], order: Column, fields: dict[int, str] = STAT_FIELDS) -> DataFrame:
    """(stt, ket_qua) rows to named columns. The first row of a code counts, by ``order``; no value is 0; a code that doesn't occur is null.

    The first row of each code is found by code, then a report's codes (one value each) become its columns: a buffer of all columns for each
    report that a task reads would grow with columns and rows.
    """
    code = code_of(F.col("stt"))
    coded = rows.select(*keys, code.alias("_all"), F.coalesce("ket_qua", F.lit(0)).alias("_value"), order.alias("_order"))
    coded = coded.withColumn("_code", F.when(F.col("_all").isin(list(fields)), F.col("_all")))
    first = coded.groupBy(*keys, "_code").agg(F.min_by("_value", "_order").alias("_value"))
    held = first.groupBy(*keys).agg(F.collect_list(F.when(F.col("_code").isNotNull(), F.struct("_code", "_value"))).alias("_held"))
    # in a lambda, since as many look-ups in generated code are a method too long for the JVM to compile
    found = held.select(*keys, let(F.map_from_entries("_held"), lambda m: F.struct(*(F.try_element_at(m, F.lit(c)).alias(name) for c, name in fields.items()))).alias("_found"))
    return found.select(*keys, "_found.*")


def derived(named: DataFrame, fields: dict[int, str] = STAT_FIELDS) -> DataFrame:
    """A19 over named columns: totals and single missing parts by the fixed equations."""
    return derive_additive(named, [(fields[t], [fields[p] for p in parts]) for t, parts in EQUATIONS.items()])


def label_of(code: Column) -> Column:
    out = F.concat(F.lit("STT "), code.cast("string"))
    for c, label in STAT_LABELS.items():
        out = F.when(code == c, label).otherwise(out)
    return out


def synced(rows: DataFrame, named: DataFrame, key: str, place: str, fields: dict[int, str] = STAT_FIELDS) -> DataFrame:
    """Stat rows (key, place, stt, ket_qua, noi_dung) with those that named columns have and the table lacks.

    The result has ``place`` anew: where something was added, by code (what is no number comes last), else as it was.
    """
    item = lambda n, late, at, stt, ket_qua, noi_dung: F.struct(n.alias("n"), late.alias("late"), at.alias("at"), stt.alias("stt"), ket_qua.alias("ket_qua"), noi_dung.alias("noi_dung"))
    number = F.when(stripped(F.col("stt")).rlike(r"^\d+$"), code_of(F.col("stt"))).otherwise(9999)
    old = item(number, F.lit(False), F.col(place).cast("long"), F.col("stt"), F.col("ket_qua").cast("long"), F.col("noi_dung"))
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("code"), F.col(n).cast("long").alias("ket_qua")) for c, n in fields.items())), lambda x: x["ket_qua"].isNotNull())
    # a report's rows and what its named columns offer meet in one shuffle
    both = rows.select(key, old.alias("_old"), F.lit(None).cast("array<struct<code:int,ket_qua:bigint>>").alias("_pairs"))
    both = both.unionByName(named.select(key, F.lit(None).cast("struct<n:int,late:boolean,at:bigint,stt:string,ket_qua:bigint,noi_dung:string>").alias("_old"), pairs.alias("_pairs")))
    met = both.groupBy(key).agg(F.collect_list("_old").alias("_old"), F.flatten(F.collect_list("_pairs")).alias("_pairs"))
    held = met.select(key, "_old", "_pairs", F.array_compact(F.transform("_old", lambda x: stripped(x["stt"]))).alias("_held"))
    lacked = F.filter("_pairs", lambda x: ~F.array_contains("_held", x["code"].cast("string")))
    new = F.transform(lacked, lambda x: item(x["code"], F.lit(True), F.lit(None).cast("long"), x["code"].cast("string"), x["ket_qua"], label_of(x["code"])))
    listed = held.select(key, "_old", new.alias("_new")).select(key, (F.size("_new") > 0).alias("_any"), F.concat("_old", "_new").alias("_rows"))
    by_code = F.array_sort("_rows")
    as_was = F.array_sort(F.transform("_rows", lambda x: F.struct(x["at"].alias("at"), x["stt"].alias("stt"), x["ket_qua"].alias("ket_qua"), x["noi_dung"].alias("noi_dung"))))
    short = lambda xs: F.transform(xs, lambda x: F.struct(x["stt"].alias("stt"), x["ket_qua"].alias("ket_qua"), x["noi_dung"].alias("noi_dung")))
    return listed.select(key, F.posexplode(F.when(F.col("_any"), short(by_code)).otherwise(short(as_was))).alias(place, "x")).select(key, place, "x.*")


def window_of(rows: DataFrame, keys: list[str], ends: list[Column], reports: list[Column], fallback: list[Column]) -> DataFrame:
    """First and last date of the first kind of date that any of a report's rows has: ends of periods, dates of reports, dates in texts. No row, where none has any."""
    kinds = [F.array_compact(F.flatten(F.array(*(F.coalesce(dates_in(c), F.array().cast("array<date>")) for c in cs)))) for cs in (ends, reports, fallback)]
    found = rows.select(*keys, *(x.alias(f"_{i}") for i, x in enumerate(kinds)))
    spans = found.groupBy(*keys).agg(*(f(g(f"_{i}")).alias(f"_{i}{n}") for i in range(3) for n, f, g in (("a", F.min, F.array_min), ("b", F.max, F.array_max))))
    pick = lambda n: F.date_format(F.coalesce(*(F.col(f"_{i}{n}") for i in range(3))), "dd/MM/yyyy")
    return spans.select(*keys, pick("a").alias("tu_ngay"), pick("b").alias("den_ngay")).where("tu_ngay is not null")


def empty_detail(text: Column) -> Column:
    """Whether a last text says nothing, or that there was nothing."""
    t = F.lower(stripped(F.coalesce(text, F.lit(""))))
    return (t == "") | t.contains("cứu nạn, cứu hộ: không")


def detail_text(items: Column) -> Column:
    """Numbered sentences for an ordered array of incidents (thoi_gian, noi_dung_tin_bao, dia_diem, and three texts of results)."""
    said = lambda x, word: F.when(stripped(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit(word), stripped(x)))

    def sentence(x: Column, i: Column) -> Column:
        begun = F.concat_ws(" ", F.concat(F.lit("3."), (i + 1).cast("string"), F.lit(".")), said(x["thoi_gian"], "Vào lúc "), said(x["noi_dung_tin_bao"], "nhận tin báo "), said(x["dia_diem"], "tại "))
        closed = F.when(begun.endswith("."), begun).otherwise(F.concat(begun, F.lit(".")))
        result = result_text(x["ket_qua_xu_ly"], x["mo_ta"], x["thiet_hai"])
        return F.concat(closed, F.when(result != "", F.concat(F.lit(" Kết quả: "), result, F.lit("."))).otherwise(""))

    first = F.concat(F.lit("3. Tình hình công tác cứu nạn, cứu hộ: Trong kỳ xảy ra "), F.size(items).cast("string"), F.lit(" vụ."))
    return F.concat_ws("\n", first, F.array_join(F.transform(items, sentence), "\n"))


def merged_stats(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of equal code, or else of equal label in any case, as one: values summed as N3 reads them, the first label that isn't blank. Rows with neither are left out."""
    stt, label = stripped(F.coalesce("stt", F.lit(""))), stripped(F.coalesce("noi_dung", F.lit("")))
    key = F.when(stt != "", F.concat(F.lit("stt:"), stt)).when(label != "", F.concat(F.lit("noi_dung:"), F.lower(label)))
    keyed = rows.select(*keys, key.alias("key"), stt.alias("stt"), F.nullif(label, F.lit("")).alias("label"), int_or_zero(F.col("ket_qua").cast("string")).alias("value"), order.alias("_order")).where("key is not null")
    return keyed.groupBy(*keys, "key").agg(F.max("stt").alias("stt"), F.sum("value").alias("ket_qua"), F.coalesce(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("_order"))), F.lit("")).alias("noi_dung"))


#: The counts of a day's incidents, by code and by the field of the narrative.
INCIDENT_COUNTS = {"chay": ("2", "tong_so_vu_chay"), "no": ("8", "tong_so_vu_no"), "cnch": ("14", "tong_so_vu_cnch")}


def daily_kpis(stats: DataFrame, narrative: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Per report the counts of incidents (the table's total where it has the code, else the narratives' sum) and their sum, and the sizes of merged lists.

    ``stats``: (keys, stt, ket_qua) merged; ``narrative``: (keys, tong_so_vu_...) a job; ``lists``: (keys, list, n).
    """
    codes = stats.groupBy(*keys).agg(*(F.sum(F.when(F.col("stt") == code, F.col("ket_qua"))).alias(f"_{n}") for n, (code, _) in INCIDENT_COUNTS.items()))
    said = narrative.groupBy(*keys).agg(*(F.sum(int_or_zero(F.col(f).cast("string"))).alias(f"said_{n}") for n, (_, f) in INCIDENT_COUNTS.items()))
    sizes = lists.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("list") == x, F.col("n"))), F.lit(0)).alias(f"listed_{x}") for x in ("cnch", "vehicles", "tasks")))
    out = said.join(codes, keys, "left").join(sizes, keys, "left")
    count = {n: F.coalesce(f"_{n}", f"said_{n}") for n in INCIDENT_COUNTS}
    return out.select(*keys, *(c.alias(f"total_{n}") for n, c in count.items()), (count["chay"] + count["no"] + count["cnch"]).alias("total_incidents"), *(F.coalesce(f"listed_{x}", F.lit(0)).alias(f"listed_{x}") for x in ("cnch", "vehicles", "tasks")))


def daily_dataset(jobs: DataFrame, keys: list[str], order: Column) -> tuple[DataFrame, DataFrame]:
    """The jobs that count (the first of each ``row_hash``; each without one), and per report how many there were, were skipped and were partial, and the count of each status."""
    keyed = jobs.withColumn("_key", F.when(stripped(F.coalesce("row_hash", F.lit(""))) != "", F.concat(F.lit("row_hash:"), stripped(F.col("row_hash")))).otherwise(F.concat(F.lit("job_id:"), F.col("job").cast("string"))))
    best = keyed.groupBy(*keys, "_key").agg(F.min_by(F.struct("job", "row_status"), order).alias("x"), F.count("*").alias("_n"))
    status = F.upper(stripped(F.coalesce("row_status", F.lit("UNKNOWN"))))
    selected = best.select(*keys, "x.*", "_n").withColumn("row_status", F.when(status == "", "UNKNOWN").otherwise(status))
    by_status = selected.groupBy(*keys, "row_status").agg(F.count("*").alias("n"), F.sum("_n").alias("seen"))
    counts = by_status.groupBy(*keys).agg(F.sum("seen").alias("jobs_total"), F.sum("n").alias("jobs_selected"), (F.sum("seen") - F.sum("n")).alias("duplicates_skipped"), F.coalesce(F.sum(F.when(F.col("row_status") == "PARTIAL", F.col("n"))), F.lit(0)).alias("partial_rows"), F.array_join(F.array_sort(F.collect_list(F.concat("row_status", F.lit(":"), F.col("n").cast("string")))), ",").alias("status_counts"))
    return selected.drop("_n"), counts


def summed_numbers(jobs: DataFrame, keys: list[str], fields: list[str], nested: str = "nested_", top: str = "top_") -> DataFrame:
    """Each field summed over jobs as N3 reads it, the nested one where a job has it, else the one at the top; null where no job has either."""
    value = lambda f: F.coalesce(F.col(f"{nested}{f}"), F.col(f"{top}{f}"))
    return jobs.groupBy(*keys).agg(*(F.sum(F.when(value(f).isNotNull(), int_or_zero(value(f).cast("string")))).alias(f) for f in fields))


def weekly(days: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """days' rows to weeks from Monday: every numeric column summed, the days that have data counted."""
    numeric = [f.name for f in days.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "double", "float", "decimal") and f.name not in keys]
    week = F.date_sub(day, F.weekday(day))
    return days.groupBy(*keys, week.alias("week_start")).agg(F.countDistinct(day).alias("daily_reports_count"), *(F.sum(c).alias(c) for c in numeric)).withColumn("week_end", F.date_add("week_start", 6))


def audited(jobs: DataFrame, source: Column, keys: list[str]) -> DataFrame:
    """Per report how many jobs speak from each source, and whether some but not all were enriched."""
    rows = jobs.select(*keys, source.alias("_source"))
    n = lambda x: F.count_if(F.col("_source") == x)
    some = n("stage1+stage2")
    return rows.groupBy(*keys).agg(F.count("*").alias("jobs"), n("reviewed").alias("reviewed"), some.alias("enriched"), n("stage1_only").alias("stage1_only"), ((some > 0) & (some < F.count("*"))).alias("partial"))
