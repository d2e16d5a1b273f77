"""Validation of records and payloads (survey rows V1-V3, V5-V8, B2, B3). Each check is a projection of one row to an array of codes: nothing is shuffled.

A payload has the columns ``header`` and ``nghiep_vu`` (structs, null if absent), ``bang_thong_ke`` (array of stt, ket_qua, noi_dung),
``danh_sach_cnch`` (array of thoi_gian, ngay_xay_ra, dia_diem, noi_dung_tin_bao), ``danh_sach_cong_van_tham_muu`` (array of so_ky_hieu,
noi_dung), ``danh_sach_phuong_tien_hu_hong`` and ``danh_sach_cong_tac_khac``. A field that is null counts as absent, an array that is null as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates, text
from tallyforge.functions.numbers import boolean, measured_note, measured_number, noted, stripped
from tallyforge.functions.text import let

#: Thresholds and fields of the standing template.
YEARS, MOST_KET_QUA, TOLERANCE = (2020, 2035), 100000, 3
NON_NEGATIVE = ("stt_02_tong_chay", "stt_08_tong_no", "stt_14_tong_cnch")
REPORT_NUMBER = r"^\d+/BC-.+"


def codes(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def business_codes(r: dict[str, Column]) -> Column:
    """V1 over a record's columns; those that it lacks are absent. ``incidents``: array of (nguon, so_luong), ``bang_thong_ke_raw``: array of (ket_qua)."""
    c = lambda name, kind="string": r.get(name, F.lit(None).cast(kind))
    number, day, period = c("so_bao_cao"), F.when(~blank(c("ngay_bao_cao")), c("ngay_bao_cao")).otherwise(F.coalesce(c("ngay"), F.lit(""))), c("thoi_gian_tu_den")
    told = reduce(lambda a, b: a + b, (F.coalesce(c(f"tong_so_vu_{n}", "bigint"), F.lit(0)) for n in ("chay", "no", "cnch")))
    listed = F.aggregate(F.filter(F.coalesce(c("incidents", "array<struct<nguon:string,so_luong:bigint>>"), F.array()), lambda i: i["nguon"] == "bang_thong_ke"), F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(i["so_luong"], F.lit(0)))
    large = F.exists(F.coalesce(c("bang_thong_ke_raw", "array<struct<ket_qua:bigint>>"), F.array()), lambda i: F.coalesce(F.abs(i["ket_qua"]) > MOST_KET_QUA, F.lit(False)))
    return codes(
        F.when(blank(number), "missing_so_bao_cao"), F.when(day == "", "missing_ngay"), F.when(blank(c("don_vi")), "missing_don_vi"), F.when(~blank(number) & ~number.rlike(REPORT_NUMBER), "invalid_so_bao_cao_format"),
        F.when(day != "", dates.date_code(day, *YEARS)), F.when(~blank(period) & ~period.rlike(r"\d{1,2}/\d{2}/\d{4}"), "invalid_thoi_gian_tu_den"),
        *(F.when(c(f, "bigint") < 0, f"negative_{f}") for f in NON_NEGATIVE), F.when((told > 0) & (listed > 0) & (listed > told * TOLERANCE), "cross_field_incident_total_mismatch"), F.when(large, "ket_qua_out_of_range"),
    )


def ruled(rows: DataFrame, fields: list[str], fallback: str) -> DataFrame:
    """V2: ``rows`` with ``fields`` (columns), and the columns of the struct ``fallback``: if there are errors, blank fields take the fallback's values, and the record is checked again;
    then it is normalised. ``errors`` and ``confidence`` (1.0 without errors, else 0.6) come with it."""
    first = business_codes({f: F.col(f) for f in fields})
    merged = rows.withColumn("_first", first).withColumns({f: F.when((F.size("_first") > 0) & blank(F.col(f).cast("string")) & ~blank(F.col(fallback)[f].cast("string")), F.col(fallback)[f]).otherwise(F.col(f)) for f in fields})
    errors = F.when(F.size("_first") > 0, business_codes({f: F.col(f) for f in fields})).otherwise(F.col("_first"))
    clean = {"so_bao_cao": lambda x: F.regexp_replace(x, r"(?U)\s+", ""), "don_vi": text.collapse, "ngay_bao_cao": dates.clean_date, "ngay": dates.clean_date, "thoi_gian_tu_den": text.clean_period, "chi_tiet_cnch": text.clean_detail, "summary_text": text.clean_detail}
    out = merged.withColumn("errors", errors).withColumn("confidence", F.when(F.size("errors") == 0, 1.0).otherwise(0.6))
    return out.withColumns({f: clean[f](F.col(f)) for f in fields if f in clean}).drop("_first", fallback)


def gate_error(header: Column, stats: Column) -> Column:
    """V3: why an extraction may not pass; null if it may."""
    said = lambda f: stripped(F.coalesce(header[f], F.lit(""))) != ""
    return F.when(header.isNull(), "header is missing").when(~(said("so_bao_cao") | said("ngay_bao_cao") | said("don_vi_bao_cao")), "header metadata is empty").when(F.coalesce(F.size(stats), F.lit(0)) <= 0, "bang_thong_ke is empty")


#: Codes that a table must have, sums that must hold, counts that must agree with a code.
REQUIRED = ["14", "15", "16", "17", "31", "32", "33", "35", "36", "37", "38", "39", "55", "56", "57", "58", "59", "60", "61"]
FORMULAS = {"formula_mismatch:stt15!=stt16+stt17": ("15", ("16", "17")), "formula_mismatch:stt31!=stt32+stt33": ("31", ("32", "33")), "formula_mismatch:stt35!=sum(stt36..stt39)": ("35", ("36", "37", "38", "39")),
            "formula_mismatch:stt55!=sum(stt56..stt61)": ("55", ("56", "57", "58", "59", "60", "61"))}
ROOTS = {"tong_so_vu_chay": "2", "tong_so_vu_no": "8", "tong_so_vu_cnch": "14"}


def stat_values(stats: Column) -> Column:
    """A stat table as a map of its codes; the last row of a code counts. Make it a column of its own: many checks read it."""
    named = F.transform(stats, lambda r, i: F.struct(stripped(F.coalesce(r["stt"], F.lit(""))).alias("k"), i.alias("i"), F.coalesce(r["ket_qua"].cast("bigint"), F.lit(0)).alias("v")))
    rows = F.filter(F.coalesce(named, F.array().cast("array<struct<k:string,i:int,v:bigint>>")), lambda r: r["k"] != "")
    last = lambda xs: F.filter(xs, lambda r, j: (j == F.size(xs) - 1) | (F.get(xs, j + 1)["k"] != r["k"]))
    return F.map_from_entries(F.transform(let(F.array_sort(rows), last), lambda r: F.struct(r["k"], r["v"])))


#: Counts of documents by kind.
COUNTED = ("tong_cong_van", "tong_bao_cao", "tong_ke_hoach")


def _first_date(x: Column) -> Column:
    return F.try_to_date(F.regexp_extract(F.coalesce(x, F.lit("")), r"(\d{1,2}/\d{1,2}/\d{4})", 1), "d/M/yyyy")


def _same(word: str):
    return lambda x: x == word


def invariant_codes(header: Column, told: Column, values: Column, incidents: Column, documents: Column, vehicles: Column) -> Column:
    """V5: required codes, sums, roots, counts of lists, dates within the period, repeated incidents, text hygiene. ``values``: see ``stat_values``."""
    size = lambda xs: F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0))
    code = F.transform(documents, lambda d: F.upper(F.regexp_replace(F.coalesce(d["so_ky_hieu"], F.lit("")), r"\s+", "")))
    # what is read more than once is bound once: an expression in a lambda is worked out for each element
    kinds = F.transform(code, lambda c: F.when(c.rlike("(^|/)BC(?:[-/]|$)"), "tong_bao_cao").when(c.rlike("(^|/)KH(?:[-/]|$)"), "tong_ke_hoach").when(c != "", "tong_cong_van"))
    spans = let(dates.dates_in(F.coalesce(header["thoi_gian_tu_den"], F.lit(""))), lambda d: F.when(F.size(d) >= 2, F.struct(F.array_min(d).alias("start"), F.array_max(d).alias("end"))))
    sized = let(kinds, lambda ks: F.struct(*(size(F.filter(ks, _same(f))).alias(f) for f in COUNTED)))
    return let(F.struct(spans.alias("span"), sized.alias("sized")), lambda b: _invariant_codes(header, told, values, incidents, vehicles, b["span"], b["sized"]))


def _invariant_codes(header: Column, told: Column, values: Column, incidents: Column, vehicles: Column, span: Column, sized: Column) -> Column:
    v = lambda k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(0))
    n = lambda f: F.coalesce(told[f].cast("bigint"), F.lit(0))
    size = lambda xs: F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0))
    outside = lambda d: let(d, lambda x: (x < span["start"]) | (x > span["end"]))
    places = lambda found, name: F.transform(F.filter(F.transform(incidents, lambda x, i: F.when(found(x, i), i + 1)), lambda i: i.isNotNull()), name)
    late = places(lambda x, i: outside(_first_date(x["ngay_xay_ra"])), lambda i: F.concat(F.lit("date_mismatch:danh_sach_cnch["), i.cast("string"), F.lit("].ngay_xay_ra_outside_period")))
    part = lambda x, f: stripped(F.coalesce(x[f], F.lit("")))
    sig = F.transform(incidents, lambda x, i: F.struct(F.concat_ws("\u0001", *(part(x, f) for f in ("thoi_gian", "ngay_xay_ra", "dia_diem", "noi_dung_tin_bao"))).alias("s"), (i + 1).alias("i")))
    # in order of signature and place a repeated one stands behind its like
    like = lambda xs: F.filter(xs, lambda x, j: (j > 0) & (F.get(xs, j - 1)["s"] == x["s"]) & (F.translate(x["s"], "\u0001", "") != ""))
    again = F.transform(F.array_sort(F.transform(let(F.array_sort(sig), like), lambda x: x["i"])), lambda i: F.concat(F.lit("duplicate_incident_signature:"), i.cast("string")))
    fixed = codes(
        *(F.when(~F.coalesce(F.map_contains_key(values, F.lit(k)), F.lit(False)), f"missing_stt:{k}") for k in REQUIRED), *(F.when(v(t) != reduce(lambda a, b: a + b, map(v, parts)), name) for name, (t, parts) in FORMULAS.items()),
        *(F.when(n(f) != v(k), f"root_mismatch:{f}!=stt{k}") for f, k in ROOTS.items()), F.when(n("tong_xe_hu_hong") != size(vehicles), "count_mismatch:tong_xe_hu_hong!=len(danh_sach_phuong_tien_hu_hong)"),
        *(F.when(n(f) != sized[f], f"count_mismatch:{f}") for f in COUNTED), F.when(outside(_first_date(header["ngay_bao_cao"])), "date_mismatch:ngay_bao_cao_outside_period"),
        F.when(stripped(F.coalesce(told["cong_tac_an_ninh"], F.lit(""))).rlike(r"(?i)^(?:P?CCC)\s*:\s*"), "text_hygiene:cong_tac_an_ninh_has_prefix"),
    )
    return F.concat(fixed, F.coalesce(late, F.array()), F.coalesce(again, F.array()))


#: Words that stand for a value, fields that must be there.
PLACEHOLDERS = ["unknown", "n/a", "na", "none", "null"]
MUST_HEADER, MUST_TOLD = ("so_bao_cao", "ngay_bao_cao", "don_vi_bao_cao"), ("tong_so_vu_chay", "tong_so_vu_no", "tong_so_vu_cnch")


def safety_codes(header: Column, told: Column, incidents: Column, documents: Column) -> Column:
    """V6: placeholder words, totals without evidence, documents without a code or with one that has no digit, required fields."""
    n = lambda f: F.coalesce(told[f].cast("bigint"), F.lit(0))
    empty = lambda xs: F.coalesce(F.size(xs), F.lit(0)) <= 0
    detail = F.lower(stripped(F.coalesce(told["chi_tiet_cnch"], F.lit(""))))
    part = lambda d, f: stripped(F.coalesce(d[f], F.lit("")))
    name = lambda word, i: F.concat(F.lit(word), (i + 1).cast("string"))
    items = F.flatten(F.transform(documents, lambda d, i: F.array(F.when((part(d, "noi_dung") != "") & (part(d, "so_ky_hieu") == ""), name("invalid_document_item_missing_code:", i)), F.when((part(d, "so_ky_hieu") != "") & ~part(d, "so_ky_hieu").rlike(r"\d"), name("invalid_document_item_code_no_digit:", i)))))
    fixed = codes(
        *(F.when(F.lower(stripped(header[f])).isin(PLACEHOLDERS), f"hallucination_placeholder:{f}") for f in MUST_HEADER), F.when((n("tong_cong_van") > 0) & empty(documents), "hallucination_total_without_evidence:tong_cong_van"),
        F.when((n("tong_so_vu_cnch") > 0) & empty(incidents) & (detail.contains("khong") | detail.contains("không")), "hallucination_total_without_evidence:tong_so_vu_cnch"),
        *(F.when(header[f].isNull(), f"missing_required_field:header.{f}") for f in MUST_HEADER), *(F.when(told[f].isNull(), f"missing_required_field:phan_I_va_II_chi_tiet_nghiep_vu.{f}") for f in MUST_TOLD),
    )
    return F.concat(fixed, F.coalesce(F.filter(items, lambda c: c.isNotNull()), F.array()))


#: The parts of a payload and what each is, and the fields of its header.
CONTRACT = {"header": "{", "bang_thong_ke": "[", "danh_sach_cnch": "[", "danh_sach_cong_tac_khac": "[", "danh_sach_cong_van_tham_muu": "[", "danh_sach_phuong_tien_hu_hong": "[", "phan_I_va_II_chi_tiet_nghiep_vu": "{"}
CONTRACT_HEADER = ("so_bao_cao", "ngay_bao_cao", "don_vi_bao_cao", "thoi_gian_tu_den")


def contract_codes(payload: Column) -> Column:
    """V7 over a JSON text: parts that are missing, then header fields, then parts of another kind."""
    keys_of = lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
    is_kind = lambda x, k: F.coalesce(x.startswith(CONTRACT[k]), F.lit(False))
    short = lambda k: "nghiep_vu" if k.startswith("phan_I") else k

    def of_header(header: Column) -> Column:
        inner = F.when(is_kind(header, "header"), keys_of(header))
        return F.concat(codes(F.when(~is_kind(header, "header"), "invalid_header_type")), let(inner, lambda ks: codes(*(F.when(~F.array_contains(ks, k), f"missing_header:{k}") for k in sorted(CONTRACT_HEADER)))))

    def told(p: Column) -> Column:
        top = let(keys_of(p), lambda ks: codes(*(F.when(~F.array_contains(ks, k), f"missing_top_level:{k}") for k in sorted(CONTRACT))))
        kinds = codes(*(F.when(~is_kind(F.get_json_object(p, f"$.{k}"), k), f"invalid_{short(k)}_type") for k in sorted(CONTRACT) if k != "header"))
        return F.concat(top, let(F.get_json_object(p, "$.header"), of_header), kinds)

    return let(payload, told)


def snapshot(header: Column, told: Column, stats: Column, values: Column, lists: dict[str, Column]) -> Column:
    """V8: a payload's stable part: header fields, sizes of lists, key numbers. ``values``: see ``stat_values``."""
    size = lambda xs: F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0))
    return F.struct(
        F.struct(*(F.coalesce(header[f], F.lit("")).alias(f) for f in CONTRACT_HEADER)).alias("header"), F.struct(size(stats).alias("bang_thong_ke"), *(size(xs).alias(name) for name, xs in lists.items())).alias("sizes"),
        F.struct(*(F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(0)).alias(f"stt_{k}") for k in REQUIRED), *(F.coalesce(told[f].cast("bigint"), F.lit(0)).alias(f) for f in MUST_TOLD)).alias("key_metrics"),
    )


#: Words of a name that tell a text field that holds a date.
DATE_WORDS = ("ngay", "date", "thoi_gian", "time")


def coerced(x: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A value of a declared type, and whether it had to be changed or couldn't be read."""
    if kind == "number":
        return measured_number(x), measured_note(x).isNotNull()
    if kind == "boolean":
        return boolean(x), F.lit(True)
    if kind == "string" and any(w in name for w in DATE_WORDS):
        found = dates.coerced_date(x)
        return found["value"], found["note"].isNotNull()
    return x, F.lit(False)


def coerced_once(x: Column, name: str, kind: str) -> Column:
    """``coerced`` as a struct (value, changed) for use in lambdas, where each mention of an expression is worked out anew."""
    pair = lambda value, changed: F.struct(value.alias("value"), changed.alias("changed"))
    if kind == "number":
        return let(stripped(x), lambda raw: let(measured_number(raw), lambda n: pair(n, noted(n, raw).isNotNull())))
    if kind == "string" and any(w in name for w in DATE_WORDS):
        return let(dates.coerced_date(x), lambda found: pair(found["value"], found["note"].isNotNull()))
    return pair(*coerced(x, name, kind))


def validated(raw: Column, fields: dict[str, str]) -> Column:
    """B2 over a map of texts: ``clean`` (a field of each declared type), and the report: valid, completeness in percent, corrected, missing and extra fields, sorted."""
    raw = F.coalesce(raw, F.create_map().cast("map<string,string>"))

    def field(x: Column, name: str, kind: str) -> Column:
        value, changed = coerced(x, name, kind)
        return F.struct(value.alias("value"), changed.alias("changed"), x.isNull().alias("missing"))

    values = lambda m: F.struct(*(let(F.try_element_at(m, F.lit(f)), (lambda f, kind: lambda x: field(x, f, kind))(f, kind)).alias(f) for f, kind in fields.items()))
    return let(raw, lambda m: let(values(m), lambda v: _report(m, v, fields)))


def _report(raw: Column, made: Column, fields: dict[str, str]) -> Column:
    corrected = codes(*(F.when(~made[f]["missing"] & made[f]["changed"], f) for f in sorted(fields)))
    extra = F.array_sort(F.array_except(F.map_keys(raw), F.array(*map(F.lit, fields))))
    clean = F.struct(*(made[f]["value"].alias(f) for f in fields))
    done = lambda missing: F.round((len(fields) - F.size(missing)) * 100.0 / len(fields), 1).cast("double")
    return let(codes(*(F.when(made[f]["missing"], f) for f in sorted(fields))), lambda missing: F.struct(clean.alias("clean"), (F.size(missing) == 0).alias("is_valid"), done(missing).alias("completeness_pct"), corrected.alias("corrected"), missing.alias("missing"), extra.alias("extra")))


def validated_array(raw: Column, fields: dict[str, str]) -> Column:
    """B3 over a JSON text: ``items`` (a struct of the declared fields each) and ``warnings``: a value that is no array is wrapped, items that are no objects are left out, with a warning each."""
    whole = stripped(raw)
    wrapped = F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    parts = F.coalesce(F.from_json(wrapped, "array<string>"), F.array().cast("array<string>"))
    is_object = lambda p: F.coalesce(p.startswith("{"), F.lit(False))
    objects = F.transform(F.filter(parts, is_object), lambda p: F.from_json(p, "map<string,string>"))
    items = F.transform(objects, lambda m: F.struct(*(coerced(F.try_element_at(m, F.lit(f)), f, kind)[0].alias(f) for f, kind in fields.items())))
    odd = F.filter(F.transform(parts, lambda p, i: F.when(~is_object(p), F.concat(F.lit("expected object at "), i.cast("string")))), lambda w: w.isNotNull())
    return F.struct(items.alias("items"), F.concat(codes(F.when(~whole.startswith("["), "expected array")), odd).alias("warnings"))
