"""Consolidated reports over stat tables, incidents and narratives. Roles: an order is a job of its customer's report, a line a stat row, an incident or a vehicle."""

from pyspark.sql import functions as F

from tallyforge.functions.numbers import int_or_null
from tallyforge.operators import stats as S
from tallyforge.operators.incremental import distinct_details
from tallyforge.operators.payload import date_parts, first_part, period, promoted, total
from tallyforge.operators.rules import EQUATIONS, overlay
from tallyforge.plans.registry import query, read

#: Expressions that Spark and DuckDB read alike.
_AT = "((l_partkey * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS place"
_STAT = ["l_orderkey AS job", _AT, "concat(' ', CASE WHEN l_partkey % 40 = 0 THEN 'x' ELSE CAST(l_linenumber * 7 + l_suppkey % 9 AS VARCHAR(20)) END, ' ') AS stt", "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS ket_qua", "CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE concat('Mục ', l_returnflag) END AS noi_dung"]
_STATS = f"SELECT {', '.join(_STAT)} FROM lineitem"


def stat_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr(*_STAT)


_CODE = "TRY_CAST(trim(stt) AS INTEGER)"
_NAMED = f"SELECT job, {', '.join(f'arg_min(coalesce(ket_qua, 0), place) FILTER ({_CODE} = {c}) AS {n}' for c, n in S.STAT_FIELDS.items())} FROM ({_STATS}) GROUP BY job"


@query(_NAMED)
def stat_named_first(spark, sf_dir):
    """P6 over all fifty codes."""
    return S.named_stats(stat_rows(spark, sf_dir), ["job"], F.col("place"))


def _derived_sql() -> str:
    out = []
    for t, parts in EQUATIONS.items():
        f, ps = S.STAT_FIELDS[t], [S.STAT_FIELDS[p] for p in parts]
        none = " + ".join(f"CAST({p} IS NULL AS INTEGER)" for p in ps)
        known = " + ".join(f"coalesce({p}, 0)" for p in ps)
        out.append(f"CASE WHEN {f} IS NULL AND {none} = 0 THEN {known} ELSE {f} END AS {f}")
        out += [f"CASE WHEN {f} IS NOT NULL AND {none} = 1 AND {p} IS NULL THEN greatest(0, {f} - ({known})) ELSE {p} END AS {p}" for p in ps]
    return f"SELECT * REPLACE ({', '.join(out)}) FROM ({_NAMED})"


@query(_derived_sql())
def stat_derived_fields(spark, sf_dir):
    """A19 by its own equations."""
    return S.derived(stat_named_first(spark, sf_dir))


_LABEL = "CASE code " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in S.STAT_LABELS.items()) + " ELSE 'STT ' || code END"
_SYNCED = f"""WITH d AS ({_derived_sql()}), u AS (UNPIVOT d ON {', '.join(S.STAT_FIELDS.values())} INTO NAME field VALUE ket_qua),
a AS (SELECT job, CAST(regexp_extract(field, '^stt_(\\d+)', 1) AS INTEGER) AS code, CAST(ket_qua AS BIGINT) AS ket_qua FROM u),
m AS (SELECT job, CAST(code AS VARCHAR) AS stt, ket_qua, {_LABEL} AS noi_dung FROM a WHERE (job, CAST(code AS VARCHAR)) NOT IN (SELECT job, trim(stt) FROM ({_STATS}))),
b AS (SELECT job, place, stt, ket_qua, noi_dung, false AS late FROM ({_STATS}) UNION ALL SELECT job, NULL, stt, ket_qua, noi_dung, true FROM m),
c AS (SELECT *, bool_or(late) OVER (PARTITION BY job) AS any_late, CASE WHEN regexp_matches(trim(stt), '^\\d+$') THEN {_CODE} ELSE 9999 END AS n FROM b)
SELECT job, CAST(row_number() OVER (PARTITION BY job ORDER BY CASE WHEN any_late THEN n ELSE 0 END, late, place, CAST(stt AS VARCHAR)) - 1 AS INTEGER) AS place, stt, ket_qua, noi_dung FROM c"""


@query(_SYNCED)
def stat_synced_rows(spark, sf_dir):
    """The table with the codes that only the derived fields have."""
    rows = stat_rows(spark, sf_dir)
    return S.synced(rows, S.derived(S.named_stats(rows, ["job"], F.col("place"))), "job", "place")


_ORDER = ["o_orderkey AS job", "o_custkey AS report", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(CAST(o_orderkey % 900 AS VARCHAR(20)), '/BC-KV', CAST(o_custkey % 40 AS VARCHAR(20))) END AS so_bao_cao",
          "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'không rõ' ELSE concat(CAST(day(o_orderdate) AS VARCHAR(20)), '/', CAST(month(o_orderdate) AS VARCHAR(20)), '/', CAST(year(o_orderdate) AS VARCHAR(20))) END AS ngay_bao_cao",
          "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'trong ngày' ELSE concat('từ 7h ngày 1/', CAST(month(o_orderdate) AS VARCHAR(20)), '/', CAST(year(o_orderdate) AS VARCHAR(20)), ' đến ngày ', CAST(day(o_orderdate) AS VARCHAR(20)), '/', CAST(month(o_orderdate) AS VARCHAR(20)), '/', CAST(year(o_orderdate) AS VARCHAR(20))) END AS thoi_gian_tu_den",
          "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey % 6 AS VARCHAR(20)) END AS tong_so_vu_chay", "CASE WHEN o_orderkey % 6 = 1 THEN '1.2' ELSE CAST(o_orderkey % 3 AS VARCHAR(20)) END AS tong_so_vu_no", "CASE WHEN o_orderkey % 8 = 2 THEN 'không' ELSE CAST(o_custkey % 4 AS VARCHAR(20)) END AS tong_so_vu_cnch"]
_ORDERS = f"SELECT {', '.join(_ORDER)} FROM orders"


def order_payloads(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(*_ORDER)


_DATE = "'(\\d{1,2}/\\d{1,2}/\\d{4})'"
_VU = "TRY_CAST(CASE WHEN trim({0}) = '' THEN '0' ELSE trim({0}) END AS BIGINT)"


@query(f"""SELECT job, so_bao_cao, regexp_extract(coalesce(ngay_bao_cao, ''), '^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})$', 1) AS ngay_xuat, regexp_extract(coalesce(ngay_bao_cao, ''), '^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})$', 3) AS nam_xuat,
regexp_extract_all(thoi_gian_tu_den, {_DATE})[1] AS tu_ngay, regexp_extract_all(thoi_gian_tu_den, {_DATE})[2] AS den_ngay,
CASE WHEN tong_so_vu_no = '1.2' THEN NULL ELSE {_VU.format('tong_so_vu_chay')} + {_VU.format('tong_so_vu_no')} + {_VU.format('tong_so_vu_cnch')} END AS tong_su_co, stt_14_tong_cnch, stt_31_kiem_tra_tong
FROM (SELECT * FROM ({_ORDERS}) LEFT JOIN ({_NAMED}) USING (job)) WHERE so_bao_cao IS NOT NULL OR stt_14_tong_cnch IS NOT NULL OR stt_31_kiem_tra_tong IS NOT NULL""")
def flatten_payload(spark, sf_dir):
    """Header fields up, dates and periods cut, the narrative's counts up and added, stat codes by name; for jobs that have a header or one of two codes."""
    rows = order_payloads(spark, sf_dir)
    header = ["so_bao_cao", "ngay_bao_cao", "thoi_gian_tu_den"]
    nested = rows.select("job", F.when(F.col("so_bao_cao").isNotNull(), F.struct(*header)).alias("header"), F.struct("tong_so_vu_chay", "tong_so_vu_no", "tong_so_vu_cnch").alias("told"), F.lit(None).cast("struct<tong_so_vu_chay:string,tong_so_vu_no:string,tong_so_vu_cnch:string>").alias("other"))
    flat = promoted(promoted(nested.withColumn("narrative", first_part(F.col("other"), F.col("told"))), "header"), "narrative")
    ngay, _, nam = date_parts(F.col("ngay_bao_cao"))
    added = total(F.lit(None).cast("string"), F.col("tong_so_vu_chay"), F.col("tong_so_vu_no"), F.col("tong_so_vu_cnch"))
    flat = flat.select("job", "so_bao_cao", ngay, nam, *period(F.col("thoi_gian_tu_den")), added.alias("tong_su_co"))
    named = S.named_stats(stat_rows(spark, sf_dir), ["job"], F.col("place"), {c: S.STAT_FIELDS[c] for c in (14, 31)})
    return flat.join(named, "job", "left").where("so_bao_cao is not null or stt_14_tong_cnch is not null or stt_31_kiem_tra_tong is not null")


def _dates_sql(x: str) -> str:
    return f"[d FOR d IN [TRY_STRPTIME(s, '%d/%m/%Y') FOR s IN regexp_extract_all(coalesce({x}, ''), {_DATE})] IF d IS NOT NULL]"


@query(f"""WITH r AS (SELECT report, {_dates_sql("CASE WHEN report % 3 = 0 THEN thoi_gian_tu_den END")} AS e, {_dates_sql("CASE WHEN report % 3 = 1 THEN ngay_bao_cao END")} AS b, {_dates_sql("thoi_gian_tu_den")} AS f FROM ({_ORDERS})),
s AS (SELECT report, min(list_min(e)) AS ea, max(list_max(e)) AS eb, min(list_min(b)) AS ba, max(list_max(b)) AS bb, min(list_min(f)) AS fa, max(list_max(f)) AS fb FROM r GROUP BY report)
SELECT report, strftime(coalesce(ea, ba, fa), '%d/%m/%Y') AS tu_ngay, strftime(coalesce(eb, bb, fb), '%d/%m/%Y') AS den_ngay FROM s WHERE coalesce(ea, ba, fa) IS NOT NULL""")
def reporting_window_sources(spark, sf_dir):
    """Three kinds of dates, each used only where a report has none of the kind before."""
    rows = order_payloads(spark, sf_dir)
    third = lambda k, c: F.when(F.col("report") % 3 == k, F.col(c))
    return S.window_of(rows, ["report"], [third(0, "thoi_gian_tu_den")], [third(1, "ngay_bao_cao")], [F.col("thoi_gian_tu_den")])


@query(f"SELECT report, {', '.join(f'CAST(coalesce(sum(CAST(trunc(TRY_CAST(replace(trim({c}), chr(44), chr(46)) AS DECIMAL(38,10))) AS BIGINT)), 0) AS BIGINT) AS {c}' for c in ('tong_so_vu_chay', 'tong_so_vu_no', 'tong_so_vu_cnch'))} FROM ({_ORDERS}) GROUP BY report")
def counter_totals(spark, sf_dir):
    """Three counters summed as whole numbers, whatever the rules say."""
    fields = ("tong_so_vu_chay", "tong_so_vu_no", "tong_so_vu_cnch")
    return order_payloads(spark, sf_dir).groupBy("report").agg(*(F.coalesce(F.sum(int_or_null(F.col(c))), F.lit(0)).alias(c) for c in fields))


_ITEM = ["l_orderkey AS job", _AT, "CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat(CAST(l_suppkey % 24 AS VARCHAR(20)), ' giờ') END AS thoi_gian", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('cháy kho ', l_returnflag) END AS noi_dung_tin_bao", "CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE concat('số ', CAST(l_partkey AS VARCHAR(20)), '.') END AS dia_diem",
         "CASE WHEN l_linestatus = 'F' THEN concat('Kết quả: cứu ', CAST(l_linenumber AS VARCHAR(20)), ' người.') END AS ket_qua_xu_ly", "CASE WHEN l_linenumber > 4 THEN 'Thiệt hại: nhỏ' ELSE '' END AS thiet_hai"]
_ITEMS = f"SELECT {', '.join(_ITEM)} FROM lineitem"
_LAST = "CASE WHEN o_custkey % 3 = 0 THEN 'Công tác Cứu nạn, cứu hộ: Không' WHEN o_custkey % 3 = 1 THEN '' ELSE 'Đã xử lý' END"


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY place, thoi_gian, noi_dung_tin_bao, dia_diem, ket_qua_xu_ly, thiet_hai) AS k FROM ({_ITEMS})),
s AS (SELECT *, concat_ws(' ', '3.' || k || '.', CASE WHEN trim(thoi_gian) <> '' THEN 'Vào lúc ' || trim(thoi_gian) END, CASE WHEN trim(noi_dung_tin_bao) <> '' THEN 'nhận tin báo ' || trim(noi_dung_tin_bao) END, CASE WHEN trim(dia_diem) <> '' THEN 'tại ' || trim(dia_diem) END) AS b,
 coalesce(nullif(rtrim(regexp_replace(coalesce(ket_qua_xu_ly, ''), '^Kết quả: ', ''), ' .'), ''), nullif(regexp_replace(thiet_hai, '^Thiệt hại: ', ''), ''), '') AS r FROM i),
d AS (SELECT job, '3. Tình hình công tác cứu nạn, cứu hộ: Trong kỳ xảy ra ' || count(*) || ' vụ.' || chr(10) || string_agg(b || CASE WHEN ends_with(b, '.') THEN '' ELSE '.' END || CASE WHEN r <> '' THEN ' Kết quả: ' || r || '.' ELSE '' END, chr(10) ORDER BY k) AS detail FROM s GROUP BY job)
SELECT o_orderkey AS job, CASE WHEN o_custkey % 3 < 2 THEN detail ELSE 'Đã xử lý' END AS detail FROM orders JOIN d ON job = o_orderkey""")
def rescue_detail(spark, sf_dir):
    """Sentences in place of a text that says nothing or none."""
    fields = ["place", "thoi_gian", "noi_dung_tin_bao", "dia_diem", "ket_qua_xu_ly", "thiet_hai"]
    items = read(spark, sf_dir, "lineitem").selectExpr(*_ITEM).groupBy("job").agg(F.array_sort(F.collect_list(F.struct(*fields, F.lit("").alias("mo_ta")))).alias("items"))
    last = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.expr(_LAST).alias("said"))
    return last.join(items, "job").select("job", F.when(S.empty_detail(F.col("said")), S.detail_text(F.col("items"))).otherwise(F.col("said")).alias("detail"))


_REPORT_STATS = f"SELECT o_custkey AS report, s.* FROM ({_STATS}) s JOIN orders ON o_orderkey = job"


def report_stats(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("report"))
    return stat_rows(spark, sf_dir).join(jobs, "job")


_MERGED = f"""SELECT report, CASE WHEN trim(stt) <> '' THEN 'stt:' || trim(stt) ELSE 'noi_dung:' || lower(trim(noi_dung)) END AS key, trim(stt) AS stt, CAST(sum(coalesce(ket_qua, 0)) AS BIGINT) AS ket_qua,
coalesce(arg_min(trim(noi_dung), row(job, place)) FILTER (trim(noi_dung) <> ''), '') AS noi_dung FROM (SELECT * REPLACE (CASE WHEN trim(stt) = 'x' THEN '' ELSE stt END AS stt) FROM ({_REPORT_STATS})) WHERE trim(stt) <> '' OR trim(noi_dung) <> '' GROUP BY 1, 2, 3"""


def merged(spark, sf_dir):
    rows = report_stats(spark, sf_dir).withColumn("stt", F.when(F.trim("stt") == "x", "").otherwise(F.col("stt")))
    return S.merged_stats(rows, ["report"], F.struct("job", "place"))


@query(_MERGED)
def daily_merged_stats(spark, sf_dir):
    """Equal codes summed, rows without one by their label; the first label that isn't blank."""
    return merged(spark, sf_dir)


_INT0 = "coalesce(TRY_CAST(regexp_replace(trim({0}), '[.,]', '', 'g') AS BIGINT), 0)"


@query(f"""WITH m AS ({_MERGED}), c AS (SELECT report, sum(ket_qua) FILTER (stt = '2') AS a, sum(ket_qua) FILTER (stt = '8') AS b, sum(ket_qua) FILTER (stt = '14') AS c FROM m GROUP BY report),
n AS (SELECT report, sum({_INT0.format('tong_so_vu_chay')}) AS a, sum({_INT0.format('tong_so_vu_no')}) AS b, sum({_INT0.format('tong_so_vu_cnch')}) AS c FROM ({_ORDERS}) GROUP BY report),
l AS (SELECT o_custkey AS report, count(DISTINCT (lower(trim(thoi_gian)), lower(trim(coalesce(noi_dung_tin_bao, ''))), lower(trim(dia_diem)))) AS cnch, count(DISTINCT (ket_qua_xu_ly IS NOT NULL, thiet_hai)) AS vehicles FROM ({_ITEMS}) JOIN orders ON o_orderkey = job GROUP BY 1)
SELECT report, CAST(coalesce(c.a, n.a) AS BIGINT) AS total_chay, CAST(coalesce(c.b, n.b) AS BIGINT) AS total_no, CAST(coalesce(c.c, n.c) AS BIGINT) AS total_cnch, CAST(coalesce(c.a, n.a) + coalesce(c.b, n.b) + coalesce(c.c, n.c) AS BIGINT) AS total_incidents,
coalesce(l.cnch, 0) AS listed_cnch, coalesce(l.vehicles, 0) AS listed_vehicles, 0::BIGINT AS listed_tasks FROM n LEFT JOIN c USING (report) LEFT JOIN l USING (report)""")
def daily_kpis(spark, sf_dir):
    """The table's counts where it has the code, else the narratives'; the sizes of lists without repeats."""
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("report"))
    items = read(spark, sf_dir, "lineitem").selectExpr(*_ITEM).join(jobs, "job")
    sig = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    sizes = items.groupBy("report").agg(F.count_distinct(F.struct(*(sig(c) for c in ("thoi_gian", "noi_dung_tin_bao", "dia_diem")))).alias("cnch"), F.count_distinct(F.struct(F.col("ket_qua_xu_ly").isNotNull(), "thiet_hai")).alias("vehicles"))
    lists = sizes.select("report", F.explode(F.array(F.struct(F.lit("cnch").alias("list"), F.col("cnch").alias("n")), F.struct(F.lit("vehicles").alias("list"), F.col("vehicles").alias("n")))).alias("x")).select("report", "x.*")
    return S.daily_kpis(merged(spark, sf_dir), order_payloads(spark, sf_dir), lists, ["report"])


_SOURCE = ["doc_id AS job", "source AS report", "CASE WHEN n_chars % 3 = 0 THEN NULL ELSE md5(text) END AS row_hash", "CASE WHEN n_chars % 4 = 0 THEN ' partial ' WHEN n_chars % 4 = 1 THEN 'ok' WHEN n_chars % 4 = 2 THEN '' END AS row_status"]


@query(f"""WITH k AS (SELECT *, CASE WHEN trim(coalesce(row_hash, '')) <> '' THEN 'row_hash:' || row_hash ELSE 'job_id:' || job END AS key FROM (SELECT {', '.join(_SOURCE)} FROM documents)),
b AS (SELECT report, key, arg_min(coalesce(upper(trim(row_status)), 'UNKNOWN'), job) AS st, count(*) AS n FROM k GROUP BY 1, 2),
s AS (SELECT report, CASE WHEN st = '' THEN 'UNKNOWN' ELSE st END AS st, count(*) AS n, sum(n) AS seen FROM b GROUP BY 1, 2)
SELECT report, CAST(sum(seen) AS BIGINT) AS jobs_total, CAST(sum(n) AS BIGINT) AS jobs_selected, CAST(sum(seen) - sum(n) AS BIGINT) AS duplicates_skipped, CAST(coalesce(sum(n) FILTER (st = 'PARTIAL'), 0) AS BIGINT) AS partial_rows, string_agg(st || ':' || n, ',' ORDER BY st || ':' || n) AS status_counts FROM s GROUP BY report""")
def daily_dataset(spark, sf_dir):
    """A26."""
    rows = read(spark, sf_dir, "documents").selectExpr(*_SOURCE)
    return S.daily_dataset(rows, ["report"], F.col("job"))[1]


@query(f"SELECT report, CAST(sum({_INT0.format('tong_so_vu_chay')}) AS BIGINT) AS tong_so_vu_chay, CAST(sum(CASE WHEN job % 2 = 0 THEN {_INT0.format('tong_so_vu_no')} WHEN job % 3 = 0 THEN 7 END) AS BIGINT) AS tong_so_vu_no FROM ({_ORDERS}) GROUP BY report")
def calendar_numbers(spark, sf_dir):
    """A number nested where a job has it there, else at the top; null where no job of a report has it."""
    rows = order_payloads(spark, sf_dir)
    even = F.col("job") % 2 == 0
    jobs = rows.select("report", F.col("tong_so_vu_chay").alias("nested_tong_so_vu_chay"), F.lit("9").alias("top_tong_so_vu_chay"), F.when(even, F.col("tong_so_vu_no")).alias("nested_tong_so_vu_no"), F.when(F.col("job") % 3 == 0, "7").alias("top_tong_so_vu_no"))
    return S.summed_numbers(jobs, ["report"], ["tong_so_vu_chay", "tong_so_vu_no"])


@query("WITH d AS (SELECT o_custkey % 20 AS tenant, CAST(o_orderdate AS DATE) AS day, count(*) AS jobs, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1, 2) SELECT tenant, strftime(date_trunc('week', day), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', day) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end, count(*) AS daily_reports_count, CAST(sum(jobs) AS BIGINT) AS jobs, CAST(sum(total) AS BIGINT) AS total FROM d GROUP BY tenant, date_trunc('week', day)")
def weekly_summaries(spark, sf_dir):
    """Every numeric column of the days, by tenant and week."""
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("tenant"), F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").cast("long").alias("price"))
    days = rows.groupBy("tenant", "day").agg(F.count("*").alias("jobs"), F.sum("price").alias("total"))
    return S.weekly(days, "day", ["tenant"]).withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd")).withColumn("week_end", F.date_format("week_end", "yyyy-MM-dd"))


@query("SELECT source AS report, array_to_string(list_sort(list(DISTINCT coalesce(lang, 'none'))), ',') AS sources, count(*) AS n FROM documents GROUP BY source")
def source_union(spark, sf_dir):
    """What the days of a report drew on, sorted."""
    rows = read(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    return rows.groupBy(F.col("source").alias("report")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("sources"), F.sum("n").alias("n"))


@query("SELECT source AS report, count(*) AS jobs, count(quality) AS reviewed, count(CASE WHEN quality IS NULL AND text IS NOT NULL AND lang = 'en' THEN 1 END) AS enriched, count(CASE WHEN quality IS NULL AND NOT coalesce(text IS NOT NULL AND lang = 'en', false) THEN 1 END) AS stage1_only, count(CASE WHEN quality IS NULL AND text IS NOT NULL AND lang = 'en' THEN 1 END) BETWEEN 1 AND count(*) - 1 AS partial FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def enrichment_audit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")
    rows = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return S.audited(rows.withColumnRenamed("source", "report"), overlay(F.col("quality"), F.col("text"), F.when(F.col("lang") == "en", 1)), ["report"])


_SAID = "CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN concat(' ', p_type) ELSE p_type END"


@query(f"WITH t AS (SELECT p_brand, p_partkey AS k, trim({_SAID}) AS item FROM part), d AS (SELECT p_brand, min(k) AS k, arg_min(item, k) AS item FROM t WHERE item <> '' GROUP BY p_brand, lower(item)) SELECT p_brand, string_agg(item, '; ' ORDER BY k) AS items FROM d GROUP BY p_brand")
def merge_texts_any_case(spark, sf_dir):
    """Texts of a day that differ by more than case, each as it was first written, in that order."""
    items = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), F.trim(F.expr(_SAID)).alias("item")).where("item <> ''")
    firsts = items.groupBy("p_brand", F.lower("item").alias("low")).agg(F.min(F.struct("k", "item")).alias("x"))
    return firsts.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), "; ").alias("items"))


_INCIDENT = "SELECT l_orderkey AS job, concat(' ', l_returnflag) AS a, l_linestatus AS b, CASE WHEN l_linenumber > 4 THEN CAST(l_linenumber AS VARCHAR(9)) END AS c, CASE WHEN l_linenumber = 2 THEN ' ' ELSE '' END AS d, l_linenumber AS ord, l_partkey AS carried FROM lineitem"


@query(f"SELECT o_custkey, count(*) AS incidents, CAST(sum(carried) AS BIGINT) AS carried FROM (SELECT o_custkey, arg_min(carried, (job, ord, carried)) AS carried FROM ({_INCIDENT}) JOIN orders ON job = o_orderkey GROUP BY o_custkey, trim(a), trim(coalesce(b, '')), trim(coalesce(c, '')), trim(d)) GROUP BY o_custkey")
def merge_incidents(spark, sf_dir):
    """Incidents of a reporter's jobs, one a signature of four trimmed fields; the row of the first is carried."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as job", "concat(' ', l_returnflag) as a", "l_linestatus as b", "case when l_linenumber > 4 then string(l_linenumber) end as c", "case when l_linenumber = 2 then ' ' else '' end as d", "l_linenumber as ord", "l_partkey as carried")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), "o_custkey")
    first = distinct_details(rows.join(orders, "job"), ["o_custkey"], ["a", "b", "c", "d"], ["job", "ord", "carried"])
    return first.groupBy("o_custkey").agg(F.count("*").alias("incidents"), F.sum("carried").alias("carried"))


@query("SELECT p_brand, code, said, arg_min(p_partkey, p_partkey) AS first FROM (SELECT p_brand, p_partkey, trim(CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(' ', p_size, '/CV ') END) AS code, trim(CASE WHEN p_size % 8 = 0 THEN ' ' ELSE split_part(p_type, ' ', 1) END) AS said FROM part) WHERE code <> '' OR said <> '' GROUP BY 1, 2, 3")
def merge_documents(spark, sf_dir):
    """Documents by two trimmed fields; those without either go, the first row stays."""
    rows = read(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", "case when p_size % 4 = 0 then '' else concat(' ', p_size, '/CV ') end as code", "case when p_size % 8 = 0 then ' ' else split_part(p_type, ' ', 1) end as said")
    first = distinct_details(rows, ["p_brand"], ["code", "said"], ["p_partkey"])
    return first.select("p_brand", F.trim("code").alias("code"), F.trim("said").alias("said"), F.col("p_partkey").alias("first"))
