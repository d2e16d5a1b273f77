"""Validation of records and payloads. Roles: a customer's orders and their lines make a report's payload: header, counts, stat table, incidents, documents, vehicles."""

from pyspark.sql import functions as F

from tallyforge.operators import validate as V
from tallyforge.operators.payload import normalised
from tallyforge.plans.registry import query, read

_CODES = [*V.REQUIRED, "2", "8"]
_PICK = "CASE " + " ".join(f"WHEN (l_linenumber * 3 + l_suppkey) % {len(_CODES)} = {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
_DMY = "concat(CAST(day(l_shipdate) AS VARCHAR(20)), '/', CAST(month(l_shipdate) AS VARCHAR(20)), '/', CAST(year(l_shipdate) AS VARCHAR(20)))"
#: Expressions that Spark and DuckDB read alike, over lines with their orders.
_LINE = ["o_custkey AS report", "((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS place", f"{_PICK} AS stt", "CAST(l_quantity AS BIGINT) % 3 AS ket_qua", "CAST(l_quantity AS BIGINT) AS q", "l_returnflag AS flag", "l_linestatus AS st",
         f"CASE WHEN l_partkey % 9 = 0 THEN 'không rõ' ELSE {_DMY} END AS ngay", "concat('kho ', CAST(l_partkey % 2 AS VARCHAR(20))) AS dia_diem", "concat(CAST(l_suppkey % 2 AS VARCHAR(20)), ' giờ ') AS gio",
         "CASE WHEN l_partkey % 6 = 0 THEN ' ' WHEN l_partkey % 6 = 1 THEN '12/BC-KV30' WHEN l_partkey % 6 = 2 THEN '7 / KH' WHEN l_partkey % 6 = 3 THEN 'CV' ELSE concat(CAST(l_partkey AS VARCHAR(20)), '/CV') END AS ky_hieu"]
_LINES = f"SELECT {', '.join(_LINE)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_HEAD = ["c_custkey AS report", "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN ' N/A' ELSE concat(CAST(c_custkey AS VARCHAR(20)), '/BC-KV30') END AS so_bao_cao", "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('15/6/', CAST(1995 + c_nationkey % 4 AS VARCHAR(20))) END AS ngay_bao_cao",
         "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE c_mktsegment END AS don_vi_bao_cao", "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 8 = 0 THEN 'trong ngày' ELSE 'từ 1/6/1995 đến 30/6/1997' END AS thoi_gian_tu_den",
         "c_custkey % 3 AS tong_so_vu_chay", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 2 END AS tong_so_vu_no", "c_custkey % 4 AS tong_so_vu_cnch", "c_custkey % 5 AS tong_xe_hu_hong", "c_custkey % 6 AS tong_cong_van", "c_nationkey % 6 AS tong_bao_cao", "c_nationkey % 3 AS tong_ke_hoach",
         "CASE WHEN c_custkey % 9 = 0 THEN ' PCCC : tốt' ELSE 'yên' END AS cong_tac_an_ninh", "CASE WHEN c_custkey % 2 = 0 THEN 'Không xảy ra' ELSE 'có' END AS chi_tiet_cnch"]
_HEADS = f"SELECT {', '.join(_HEAD)} FROM customer"
_TOLD = ["tong_so_vu_chay", "tong_so_vu_no", "tong_so_vu_cnch", "tong_xe_hu_hong", "tong_cong_van", "tong_bao_cao", "tong_ke_hoach", "cong_tac_an_ninh", "chi_tiet_cnch"]


def payloads(spark, sf_dir):
    """One payload a customer: lines are gathered by one grouped pass."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_LINE)
    ordered = lambda where, *cols: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("place", "q", F.struct(*cols).alias("x"))))), lambda p: p["x"])
    incident = F.struct(F.col("gio").alias("thoi_gian"), F.col("ngay").alias("ngay_xay_ra"), "dia_diem", F.lit("cháy").alias("noi_dung_tin_bao"))
    gathered = lines.groupBy("report").agg(
        ordered(F.lit(True), "stt", "ket_qua", F.lit("").alias("noi_dung")).alias("bang_thong_ke"), F.transform(F.array_sort(F.collect_list(F.when(F.col("flag") == "A", F.struct("place", "q", incident.alias("x"))))), lambda p: p["x"]).alias("danh_sach_cnch"),
        ordered(F.col("flag") == "R", F.col("ky_hieu").alias("so_ky_hieu"), F.lit("về việc").alias("noi_dung")).alias("danh_sach_cong_van_tham_muu"), ordered((F.col("st") == "O") & (F.col("q") > 45), "dia_diem").alias("danh_sach_phuong_tien_hu_hong"),
    )
    heads = read(spark, sf_dir, "customer").selectExpr(*_HEAD)
    header = F.when(F.col("ngay_bao_cao").isNotNull(), F.struct("so_bao_cao", "ngay_bao_cao", "don_vi_bao_cao", "thoi_gian_tu_den"))
    return heads.select("report", header.alias("header"), F.struct(*_TOLD).alias("nghiep_vu")).join(gathered, "report", "left")


_STT_MAP = f"SELECT report, stt, arg_max(ket_qua, row(place, q)) AS v FROM ({_LINES}) GROUP BY 1, 2"
_INCIDENTS = f"SELECT report, gio, ngay, dia_diem, row_number() OVER (PARTITION BY report ORDER BY place, q) AS i, TRY_STRPTIME(nullif(regexp_extract(ngay, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), ''), '%d/%m/%Y') AS d FROM ({_LINES}) WHERE flag = 'A'"
_V = lambda k: f"coalesce(sum(v) FILTER (stt = '{k}'), 0)"
_SPAN = "h.thoi_gian_tu_den LIKE 'từ%'"
_DOCS = f"SELECT report, CASE WHEN regexp_matches(upper(replace(ky_hieu, ' ', '')), '(^|/)BC([-/]|$)') THEN 'tong_bao_cao' WHEN regexp_matches(upper(replace(ky_hieu, ' ', '')), '(^|/)KH([-/]|$)') THEN 'tong_ke_hoach' WHEN trim(ky_hieu) <> '' THEN 'tong_cong_van' END AS kind FROM ({_LINES}) WHERE flag = 'R'"


@query(
    f"WITH h AS ({_HEADS}), m AS ({_STT_MAP}), i AS ({_INCIDENTS}), d AS (SELECT report, kind, count(*) AS n FROM ({_DOCS}) GROUP BY 1, 2), c AS (SELECT report, count(*) AS n FROM ({_LINES}) WHERE st = 'O' AND q > 45 GROUP BY 1), "
    "w AS (SELECT h.report, " + ", ".join(f"{_V(k)} AS v{k}" for k in _CODES) + " FROM h LEFT JOIN m USING (report) GROUP BY h.report) "
    + " UNION ALL ".join(
        [f"SELECT report, 'missing_stt:{k}' AS code FROM h WHERE report NOT IN (SELECT report FROM m WHERE stt = '{k}')" for k in V.REQUIRED]
        + [f"SELECT report, '{name}' FROM w WHERE v{t} <> {' + '.join(f'v{p}' for p in parts)}" for name, (t, parts) in V.FORMULAS.items()]
        + [f"SELECT report, 'root_mismatch:{f}!=stt{k}' FROM h JOIN w USING (report) WHERE coalesce({f}, 0) <> v{k}" for f, k in V.ROOTS.items()]
        + ["SELECT report, 'count_mismatch:tong_xe_hu_hong!=len(danh_sach_phuong_tien_hu_hong)' FROM h LEFT JOIN c USING (report) WHERE tong_xe_hu_hong <> coalesce(n, 0)"]
        + [f"SELECT h.report, 'count_mismatch:{f}' FROM h LEFT JOIN d ON d.report = h.report AND kind = '{f}' WHERE {f} <> coalesce(n, 0)" for f in ("tong_cong_van", "tong_bao_cao", "tong_ke_hoach")]
        + [f"SELECT report, 'date_mismatch:ngay_bao_cao_outside_period' FROM h WHERE {_SPAN} AND TRY_STRPTIME(ngay_bao_cao, '%d/%m/%Y') NOT BETWEEN DATE '1995-06-01' AND DATE '1997-06-30'"]
        + [f"SELECT i.report, 'date_mismatch:danh_sach_cnch[' || i || '].ngay_xay_ra_outside_period' FROM i JOIN h ON h.report = i.report WHERE {_SPAN} AND d NOT BETWEEN DATE '1995-06-01' AND DATE '1997-06-30'"]
        + ["SELECT report, 'duplicate_incident_signature:' || i FROM (SELECT *, row_number() OVER (PARTITION BY report, gio, ngay, dia_diem ORDER BY i) AS k FROM i) WHERE k > 1"]
        + ["SELECT report, 'text_hygiene:cong_tac_an_ninh_has_prefix' FROM h WHERE report % 9 = 0"]
    )
)
def payload_invariants(spark, sf_dir):
    """V5, whole."""
    p = payloads(spark, sf_dir).withColumn("values", V.stat_values(F.col("bang_thong_ke")))
    found = V.invariant_codes(*(F.col(c) for c in ("header", "nghiep_vu", "values", "danh_sach_cnch", "danh_sach_cong_van_tham_muu", "danh_sach_phuong_tien_hu_hong")))
    return p.select("report", F.explode(found).alias("code"))


@query(
    f"WITH h AS ({_HEADS}), d AS (SELECT report, ky_hieu, row_number() OVER (PARTITION BY report ORDER BY place, q) AS i FROM ({_LINES}) WHERE flag = 'R'), a AS (SELECT DISTINCT report FROM ({_LINES}) WHERE flag = 'A') "
    + " UNION ALL ".join(
        [f"SELECT report, 'hallucination_placeholder:{f}' AS code FROM h WHERE lower(trim({f})) IN ('unknown', 'n/a', 'na', 'none', 'null')" for f in V.MUST_HEADER]
        + ["SELECT report, 'hallucination_total_without_evidence:tong_cong_van' FROM h WHERE tong_cong_van > 0 AND report NOT IN (SELECT report FROM d)", "SELECT report, 'hallucination_total_without_evidence:tong_so_vu_cnch' FROM h WHERE tong_so_vu_cnch > 0 AND report NOT IN (SELECT report FROM a) AND report % 2 = 0"]
        + ["SELECT report, 'invalid_document_item_missing_code:' || i FROM d WHERE trim(ky_hieu) = ''", "SELECT report, 'invalid_document_item_code_no_digit:' || i FROM d WHERE trim(ky_hieu) = 'CV'"]
        + [f"SELECT report, 'missing_required_field:header.{f}' FROM h WHERE {f} IS NULL" for f in V.MUST_HEADER] + [f"SELECT report, 'missing_required_field:phan_I_va_II_chi_tiet_nghiep_vu.{f}' FROM h WHERE {f} IS NULL" for f in V.MUST_TOLD]
    )
)
def payload_safety(spark, sf_dir):
    """V6, whole."""
    p = payloads(spark, sf_dir)
    return p.select("report", F.explode(V.safety_codes(F.col("header"), F.col("nghiep_vu"), F.col("danh_sach_cnch"), F.col("danh_sach_cong_van_tham_muu"))).alias("code"))


@query(f"SELECT report, CASE WHEN ngay_bao_cao IS NULL THEN 'header is missing' WHEN NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = report) THEN 'bang_thong_ke is empty' END AS error FROM ({_HEADS})")
def output_gate(spark, sf_dir):
    """V3."""
    return payloads(spark, sf_dir).select("report", V.gate_error(F.col("header"), F.col("bang_thong_ke")).alias("error"))


@query(f"WITH h AS ({_HEADS}), m AS ({_STT_MAP}), l AS (SELECT report, count(*) AS n, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'R') AS r FROM ({_LINES}) GROUP BY 1) SELECT report, coalesce(so_bao_cao, '') AS so_bao_cao, CAST(coalesce(n, 0) AS INTEGER) AS bang_thong_ke, CAST(coalesce(a, 0) AS INTEGER) AS danh_sach_cnch, CAST(coalesce(r, 0) AS INTEGER) AS cong_van, CAST(coalesce((SELECT sum(v) FROM m WHERE m.report = h.report AND stt = '31'), 0) AS BIGINT) AS stt_31, CAST(coalesce(tong_so_vu_no, 0) AS BIGINT) AS tong_so_vu_no FROM h LEFT JOIN l USING (report)")
def payload_snapshot(spark, sf_dir):
    """V8."""
    p = payloads(spark, sf_dir).withColumn("values", V.stat_values(F.col("bang_thong_ke")))
    s = V.snapshot(F.col("header"), F.col("nghiep_vu"), F.col("bang_thong_ke"), F.col("values"), {"danh_sach_cnch": F.col("danh_sach_cnch"), "danh_sach_cong_van_tham_muu": F.col("danh_sach_cong_van_tham_muu")})
    return p.select("report", s.alias("s")).select("report", "s.header.so_bao_cao", "s.sizes.bang_thong_ke", "s.sizes.danh_sach_cnch", F.col("s.sizes.danh_sach_cong_van_tham_muu").alias("cong_van"), "s.key_metrics.stt_31", "s.key_metrics.tong_so_vu_no")


@query(f"SELECT report, s.so_bao_cao AS s_header_so_bao_cao, s.n AS s_sizes_n, s.n * 2 AS s_deep_inner_twice, tong_so_vu_chay AS top FROM (SELECT h.report, tong_so_vu_chay, {{'so_bao_cao': coalesce(so_bao_cao, ''), 'n': CAST(coalesce(n, 0) AS INTEGER)}} AS s FROM ({_HEADS}) h LEFT JOIN (SELECT report, count(*) AS n FROM ({_LINES}) GROUP BY 1) USING (report))")
def payload_columns(spark, sf_dir):
    """Nested fields, however deep, as columns named by their path."""
    p = payloads(spark, sf_dir)
    n = F.greatest(F.coalesce(F.size("bang_thong_ke"), F.lit(0)), F.lit(0))
    nested = F.struct(F.struct(F.coalesce("header.so_bao_cao", F.lit("")).alias("so_bao_cao")).alias("header"), F.struct(n.alias("n")).alias("sizes"), F.struct(F.struct((n * 2).alias("twice")).alias("inner")).alias("deep"))
    return normalised(p.select("report", nested.alias("s"), F.col("nghiep_vu.tong_so_vu_chay").alias("top")))


_JSON = """concat('{', CASE WHEN event_id % 5 = 0 THEN '"header": "x", ' WHEN event_id % 5 = 1 THEN '' ELSE concat('"header": {"so_bao_cao": "', CAST(user_id AS VARCHAR(20)), '", "ngay_bao_cao": ""', CASE WHEN event_id % 3 = 0 THEN ', "don_vi_bao_cao": "k"' ELSE '' END, ', "thoi_gian_tu_den": null}, ') END,
CASE WHEN event_id % 7 < 5 THEN '"bang_thong_ke": [{"stt": "1"}], ' ELSE '"bang_thong_ke": {}, ' END, CASE WHEN event_type = 'view' THEN '' ELSE '"danh_sach_cnch": [], ' END, '"danh_sach_cong_tac_khac": [], "danh_sach_cong_van_tham_muu": ', CASE WHEN event_type = 'click' THEN '5' ELSE '[]' END,
', "danh_sach_phuong_tien_hu_hong": [], "phan_I_va_II_chi_tiet_nghiep_vu": {}', CASE WHEN event_id % 11 = 0 THEN ' broken' ELSE '}' END)""".replace("\n", " ")


@query(f"""WITH t AS (SELECT event_id, {_JSON} AS x FROM events), j AS (SELECT event_id, CASE WHEN json_valid(x) THEN x::JSON END AS x FROM t) SELECT event_id, code FROM ({' UNION ALL '.join(
    [f"SELECT event_id, 'missing_top_level:{k}' AS code FROM j WHERE NOT coalesce(list_contains(json_keys(x), '{k}'), false)" for k in sorted(V.CONTRACT)]
    + ["SELECT event_id, 'invalid_header_type' FROM j WHERE coalesce(json_type(x, '$.header'), '') <> 'OBJECT'"]
    + [f"SELECT event_id, 'missing_header:{k}' FROM j WHERE json_type(x, '$.header') = 'OBJECT' AND NOT list_contains(json_keys(x, '$.header'), '{k}')" for k in V.CONTRACT_HEADER]
    + [f"SELECT event_id, 'invalid_{'nghiep_vu' if k.startswith('phan_I') else k}_type' FROM j WHERE coalesce(json_type(x, '$.{k}'), '') <> '{'ARRAY' if v == '[' else 'OBJECT'}'" for k, v in V.CONTRACT.items() if k != 'header'])})""")
def schema_contract(spark, sf_dir):
    """V7; a text that isn't JSON has nothing."""
    payload = F.expr(_JSON)
    valid = F.when(F.json_object_keys(payload).isNotNull(), payload)
    return read(spark, sf_dir, "events").select("event_id", F.explode(V.contract_codes(valid)).alias("code"))


_RECORD = ["o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'BC 12' ELSE concat(CAST(o_orderkey AS VARCHAR(20)), '/BC-KV 30') END AS so_bao_cao", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(lpad(CAST(o_orderkey % 33 AS VARCHAR(20)), 2, '0'), '/', lpad(CAST(o_custkey % 14 AS VARCHAR(20)), 2, '0'), '/', CAST(2018 + o_custkey % 20 AS VARCHAR(20))) END AS ngay_bao_cao",
           "CASE WHEN o_custkey % 6 = 0 THEN '' ELSE concat(o_orderpriority, '  đội') END AS don_vi", "CASE WHEN o_custkey % 7 = 0 THEN 'cả ngày' WHEN o_custkey % 7 = 1 THEN NULL ELSE 'từ 1 / 02/2024 đến 02/02/2024' END AS thoi_gian_tu_den", "CAST(o_custkey % 5 AS BIGINT) - 1 AS stt_02_tong_chay", "CAST(o_custkey % 3 AS BIGINT) AS tong_so_vu_chay"]
_RECORDS = f"SELECT {', '.join(_RECORD)} FROM orders"
_DAY_CODE = "CASE WHEN CAST({0}[4:5] AS INTEGER) NOT BETWEEN 1 AND 12 THEN 'date_month_out_of_range' WHEN CAST({0}[1:2] AS INTEGER) NOT BETWEEN 1 AND 31 THEN 'date_day_out_of_range' WHEN CAST({0}[7:10] AS INTEGER) NOT BETWEEN 2020 AND 2035 THEN 'date_year_out_of_range' WHEN CAST({0}[1:2] AS INTEGER) > CASE CAST({0}[4:5] AS INTEGER) WHEN 2 THEN 29 WHEN 4 THEN 30 WHEN 6 THEN 30 WHEN 9 THEN 30 WHEN 11 THEN 30 ELSE 31 END THEN 'date_day_exceeds_month' END"


def _business_sql(so: str, ngay: str, don_vi: str) -> str:
    return f"""[c FOR c IN [CASE WHEN coalesce({so}, '') = '' THEN 'missing_so_bao_cao' END, CASE WHEN {ngay} IS NULL THEN 'missing_ngay' END, CASE WHEN coalesce({don_vi}, '') = '' THEN 'missing_don_vi' END, CASE WHEN {so} <> '' AND NOT regexp_matches({so}, '^\\d+/BC-.+') THEN 'invalid_so_bao_cao_format' END,
{_DAY_CODE.format(ngay)}, CASE WHEN thoi_gian_tu_den <> '' AND NOT regexp_matches(thoi_gian_tu_den, '\\d{{1,2}}/\\d{{2}}/\\d{{4}}') THEN 'invalid_thoi_gian_tu_den' END, CASE WHEN stt_02_tong_chay < 0 THEN 'negative_stt_02_tong_chay' END, CASE WHEN n > 0 AND tong_so_vu_chay > 0 AND n > 3 * tong_so_vu_chay THEN 'cross_field_incident_total_mismatch' END, CASE WHEN big THEN 'ket_qua_out_of_range' END] IF c IS NOT NULL]"""


@query(f"WITH t AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(big, false) AS big FROM ({_RECORDS}) r LEFT JOIN (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS n, bool_or(l_quantity * 3000 > 100000) AS big FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) SELECT o_orderkey, unnest({_business_sql('so_bao_cao', 'ngay_bao_cao', 'don_vi')}) AS code FROM t")
def business_codes(spark, sf_dir):
    """V1, whole."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("bang_thong_ke").alias("nguon"), F.col("l_linenumber").cast("long").alias("so_luong"))).alias("incidents"), F.collect_list(F.struct((F.col("l_quantity") * 3000).cast("long").alias("ket_qua"))).alias("bang_thong_ke_raw"))
    rows = read(spark, sf_dir, "orders").selectExpr(*_RECORD).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.explode(V.business_codes({c: F.col(c) for c in rows.columns})).alias("code"))


@query(f"""WITH t AS (SELECT *, 0 AS n, false AS big, 'Đội ' || o_orderkey AS x FROM ({_RECORDS})), f AS (SELECT *, {_business_sql('so_bao_cao', 'ngay_bao_cao', 'don_vi')} AS first FROM t),
m AS (SELECT * REPLACE (CASE WHEN len(first) > 0 AND so_bao_cao = '' THEN '9/BC-X' ELSE so_bao_cao END AS so_bao_cao, CASE WHEN len(first) > 0 AND don_vi = '' THEN x ELSE don_vi END AS don_vi) FROM f), e AS (SELECT *, CASE WHEN len(first) > 0 THEN {_business_sql('so_bao_cao', 'ngay_bao_cao', 'don_vi')} ELSE first END AS errors FROM m)
SELECT o_orderkey, regexp_replace(so_bao_cao, '\\s+', '', 'g') AS so_bao_cao, regexp_replace(don_vi, '\\s+', ' ', 'g') AS don_vi, regexp_replace(thoi_gian_tu_den, '(\\d)\\s*/\\s*', '\\1/', 'g') AS thoi_gian_tu_den, array_to_string(errors, ',') AS errors, CASE WHEN len(errors) = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM e""")
def rule_chain(spark, sf_dir):
    """V2: blank fields take a fallback where there are errors; checked again and normalised."""
    fields = ["so_bao_cao", "ngay_bao_cao", "don_vi", "thoi_gian_tu_den", "stt_02_tong_chay"]
    none = F.lit(None)
    fallback = F.struct(F.lit("9/BC-X").alias("so_bao_cao"), none.cast("string").alias("ngay_bao_cao"), F.concat(F.lit("Đội "), F.col("o_orderkey").cast("string")).alias("don_vi"), none.cast("string").alias("thoi_gian_tu_den"), none.cast("bigint").alias("stt_02_tong_chay"))
    rows = read(spark, sf_dir, "orders").selectExpr(*_RECORD).withColumn("fallback", fallback)
    return V.ruled(rows, fields, "fallback").select("o_orderkey", "so_bao_cao", "don_vi", "thoi_gian_tu_den", F.array_join("errors", ",").alias("errors"), "confidence")


_FIELDS = {"so_luong": "number", "xac_nhan": "boolean", "ngay_lap": "string", "ten": "string"}


@query("""WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' vụ' ELSE '' END END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'Có' WHEN o_custkey % 3 = 1 THEN 'không' ELSE 'khác' END END AS b, CASE WHEN o_orderkey % 6 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS c, o_orderkey % 7 = 0 AS more FROM orders)
SELECT k AS o_orderkey, CAST(regexp_extract(a, '^\\d+') AS DOUBLE) AS so_luong, CASE b WHEN 'Có' THEN true WHEN 'không' THEN false END AS xac_nhan, CASE WHEN c LIKE '%-%' THEN c[9:10] || '/' || c[6:7] || '/' || c[1:4] ELSE c END AS ngay_lap, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS is_valid,
round((4 - (a IS NULL)::INTEGER - (b IS NULL)::INTEGER - (c IS NULL)::INTEGER) * 25.0, 1)::DOUBLE AS completeness_pct, array_to_string([x FOR x IN [CASE WHEN c LIKE '%-%' THEN 'ngay_lap' END, CASE WHEN a LIKE '% vụ' THEN 'so_luong' END, CASE WHEN b IS NOT NULL THEN 'xac_nhan' END] IF x IS NOT NULL], ',') AS corrected, CASE WHEN more THEN 'ghi_chu' ELSE '' END AS extra FROM t""".replace("\\\\", "\\"))
def typed_records(spark, sf_dir):
    """B2."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(k % 4 != 0, F.concat(c.cast("string"), F.when(k % 3 == 0, " vụ").otherwise("")))
    yes = F.when(k % 5 != 0, F.when(c % 3 == 0, "Có").when(c % 3 == 1, "không").otherwise("khác"))
    day = F.when(k % 6 != 0, F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    pairs = F.array(*(F.struct(F.lit(n).alias("k"), v.cast("string").alias("v")) for n, v in (("so_luong", number), ("xac_nhan", yes), ("ngay_lap", day), ("ten", F.col("o_orderpriority")), ("ghi_chu", F.when(k % 7 == 0, "x")))))
    raw = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    out = read(spark, sf_dir, "orders").select("o_orderkey", V.validated(raw, _FIELDS).alias("r"))
    return out.select("o_orderkey", "r.clean.so_luong", "r.clean.xac_nhan", "r.clean.ngay_lap", "r.is_valid", "r.completeness_pct", F.array_join("r.corrected", ",").alias("corrected"), F.array_join("r.extra", ",").alias("extra"))


_LIST = """CASE WHEN event_id % 4 = 0 THEN concat('[{"so_luong": "', CAST(user_id AS VARCHAR(20)), ' vụ", "ngay": "2024-1-2"}, 5, {"so_luong": "1.500", "khac": 1}]') WHEN event_id % 4 = 1 THEN concat('{"so_luong": ', CAST(user_id AS VARCHAR(20)), ', "ngay": "7h5"}') WHEN event_id % 4 = 2 THEN '[]' ELSE concat('["a", {"ngay": "', CAST(user_id % 28 + 1 AS VARCHAR(20)), '/2/2024"}]') END"""


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || ',1.5' WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE '' END AS numbers, CASE event_id % 4 WHEN 0 THEN '02/01/2024' WHEN 1 THEN '7h5' WHEN 3 THEN lpad(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0') || '/02/2024' ELSE '' END AS days, CASE event_id % 4 WHEN 0 THEN 'expected object at 1' WHEN 1 THEN 'expected array' WHEN 3 THEN 'expected object at 0' ELSE '' END AS warnings FROM events")
def typed_lists(spark, sf_dir):
    """B3."""
    r = read(spark, sf_dir, "events").select("event_id", V.validated_array(F.expr(_LIST), {"so_luong": "number", "ngay": "string"}).alias("r"))
    shown = lambda xs: F.array_join(F.filter(xs, lambda x: x.isNotNull()), ",")
    numbers = F.transform("r.items", lambda i: F.regexp_replace(i["so_luong"].cast("string"), r"\.0$", ""))
    return r.select("event_id", shown(numbers).alias("numbers"), shown(F.transform("r.items", lambda i: i["ngay"])).alias("days"), F.array_join("r.warnings", ",").alias("warnings"))
