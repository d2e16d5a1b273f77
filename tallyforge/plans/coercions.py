"""Dates, numbers, names and report parts read from text, and what job lifecycles make of results. Texts are made of the tables' columns by expressions that Spark and DuckDB read alike."""

from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text
from tallyforge.operators import lifecycle as L
from tallyforge.plans.registry import query, read
from tallyforge.plans.texts import _SPACED

_D, _M, _Y = (f"CAST({f}(o_orderdate) AS VARCHAR(20))" for f in ("day", "month", "year"))
_K = "o_orderkey % 12"
_LOOSE = f"""CASE WHEN {_K} = 0 THEN concat(' ', {_D}, '/', {_M}, '/', {_Y}) WHEN {_K} = 1 THEN concat({_D}, '-', {_M}, '-', {_Y}, ' ') WHEN {_K} = 2 THEN concat({_Y}, '.', {_M}, '.', {_D}) WHEN {_K} = 3 THEN concat('ngày ', {_D}, ' tháng ', {_M}, ' năm ', {_Y})
WHEN {_K} = 4 THEN concat(CAST(o_custkey % 30 AS VARCHAR(20)), 'h', lpad(CAST(o_custkey % 70 AS VARCHAR(20)), 2, '0')) WHEN {_K} = 5 THEN concat('31/', {_M}, '/', {_Y}) WHEN {_K} = 6 THEN concat(o_orderpriority, ' ', {_Y}) WHEN {_K} = 7 THEN concat(lpad({_D}, 2, '0'), '/', lpad({_M}, 2, '0'), '/', {_Y})
WHEN {_K} = 8 THEN concat({_Y}, lpad({_M}, 2, '0'), lpad({_D}, 2, '0')) WHEN {_K} = 9 THEN ' ' WHEN {_K} = 10 THEN concat({_D}, ' Thang ', {_M}, ' nam ', {_Y}) END"""
_DMY, _YMD, _VN, _CLOCK = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$", r"^(?i)(?:ngày|ngay)?\s*(\d{1,2})\s+(?:tháng|thang)\s*(\d{1,2})\s+(?:năm|nam)\s*(\d{4})", r"^(\d{1,2})\s*[hH:]\s*(\d{2})$"


def _made(pattern: str, d: int, m: int, y: int) -> str:
    part = lambda i: f"regexp_extract(s, '{pattern}', {i})"
    return f"strftime(TRY_STRPTIME({part(d)} || '/' || {part(m)} || '/' || {part(y)}, '%d/%m/%Y'), '%d/%m/%Y')"


@query(f"""WITH t AS (SELECT o_orderkey, trim({_LOOSE}) AS s FROM orders), v AS (SELECT *, CASE WHEN TRY_CAST(regexp_extract(s, '{_CLOCK}', 1) AS INTEGER) BETWEEN 0 AND 23 AND TRY_CAST(regexp_extract(s, '{_CLOCK}', 2) AS INTEGER) BETWEEN 0 AND 59 THEN lpad(regexp_extract(s, '{_CLOCK}', 1), 2, '0') || ':' || regexp_extract(s, '{_CLOCK}', 2) END AS a,
coalesce({_made(_DMY, 1, 2, 3)}, {_made(_YMD, 3, 2, 1)}) AS b, {_made(_VN.replace('^(?i)', '(?i)^'), 1, 2, 3)} AS c, CASE WHEN regexp_matches(s, '^\\d{{8}}$') THEN strftime(CASE WHEN substr(s, 7) <= '12' THEN TRY_STRPTIME(s, '%Y%d%m') ELSE TRY_STRPTIME(s, '%Y%m%d') END, '%d/%m/%Y') END AS d FROM t)
SELECT o_orderkey, CASE WHEN s <> '' THEN coalesce(a, b, c, d, s) END AS value, CASE WHEN a IS NOT NULL THEN 'time' WHEN b IS NOT NULL THEN CASE WHEN b <> s THEN 'date' END WHEN c IS NOT NULL THEN 'words' WHEN d IS NOT NULL THEN 'free' WHEN s <> '' THEN 'not_recognised' END AS note FROM v""")
def coerce_date_forms(spark, sf_dir):
    """D1."""
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.coerced_date(F.expr(_LOOSE)).alias("x")).select("o_orderkey", "x.value", "x.note")


_CANDIDATES = [f"CASE WHEN o_custkey % 4 = 0 THEN concat({_Y}, '-', {_M}, '-', {_D}) END", f"CASE WHEN o_custkey % 3 = 0 THEN 'chưa rõ' ELSE '' END", f"CASE WHEN o_custkey % 4 = 1 THEN concat({_D}, '/', {_M}, '/', {_Y}) END",
               f"CASE WHEN o_custkey % 5 = 0 THEN concat('31-2-', {_Y}) END", f"CASE WHEN o_custkey % 4 < 3 THEN concat('1-', {_M}, '-', {_Y}) END", f"CASE WHEN o_custkey % 7 > 2 THEN concat(' ', {_Y}, '/', {_M}, '/2 ') END"]
_CHAIN = "coalesce(" + ", ".join(f"TRY_STRPTIME(trim({c}), '{f}')" for c in _CANDIDATES for f in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d")) + ")"


def chained(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.first_report_date(*(F.expr(c) for c in _CANDIDATES)).alias("d"))


@query(f"SELECT o_orderkey, strftime({_CHAIN}, '%Y-%m-%d') AS day FROM orders")
def report_date_chain(spark, sf_dir):
    """D3: six places, the first that holds a date."""
    return chained(spark, sf_dir).select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query(f"SELECT o_orderkey FROM orders WHERE CAST({_CHAIN} AS DATE) = DATE '1996-04-01'")
def jobs_of_report_date(spark, sf_dir):
    """jobs whose derived date is a given day."""
    return chained(spark, sf_dir).where("d = date'1996-04-01'").select("o_orderkey")


_TIMES = f"""CASE WHEN {_K} = 0 THEN concat({_D}, '/', {_M}, '/', {_Y}) WHEN {_K} = 1 THEN concat(CAST(o_custkey % 24 AS VARCHAR(20)), 'h', lpad(CAST(o_custkey % 60 AS VARCHAR(20)), 2, '0')) WHEN {_K} = 2 THEN concat('07:30 ', {_D}, '/', {_M}, '/', {_Y}) WHEN {_K} = 3 THEN concat('07:30  ngày ', {_D}, '/', {_M}, '/', {_Y}, ' ')
WHEN {_K} = 4 THEN concat('7 giờ 5 phút ngày ', {_D}, '/', {_M}, '/', {_Y}) WHEN {_K} = 5 THEN concat('lúc 7h ', {_D}, '/', {_M}) WHEN {_K} = 6 THEN '' WHEN {_K} = 7 THEN concat({_D}, '/', {_M}, '/', {_Y}, ' 17:45') WHEN {_K} = 8 THEN '7:30' WHEN {_K} = 9 THEN concat(o_orderpriority, '!') ELSE '23:59' END"""
_FORMS = " OR ".join(f"regexp_matches(s, '(?i){f}')" for f in dates.TIME_FORMS)
_PADDED = "regexp_replace(regexp_replace({0}, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})', '0\\1/0\\2/\\3', 'g'), '0(\\d{{2}})/', '\\1/', 'g')"


@query(f"WITH t AS (SELECT o_orderkey, trim({_TIMES}) AS r FROM orders), u AS (SELECT o_orderkey, {_PADDED.format('CASE WHEN regexp_matches(r, ' + chr(39) + '^[0-9]{1,2}[hH][0-9]{2}$' + chr(39) + ') THEN lpad(split_part(lower(r), ' + chr(39) + 'h' + chr(39) + ', 1), 2, ' + chr(39) + '0' + chr(39) + ') || ' + chr(39) + ':' + chr(39) + ' || split_part(lower(r), ' + chr(39) + 'h' + chr(39) + ', 2) ELSE r END')} AS s FROM t) SELECT o_orderkey, s AS value, s = '' OR {_FORMS} AS valid FROM u")
def incident_times(spark, sf_dir):
    """D7."""
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.incident_time(F.expr(_TIMES)).alias("x")).select("o_orderkey", "x.value", "x.valid")


_WRITTEN_DATES = f"CASE WHEN {_K} < 4 THEN concat({_D}, '/', {_M}, '/', {_Y}) WHEN {_K} < 8 THEN concat({_Y}, '-', {_M}, '-', {_D}, 'T08:00') WHEN {_K} = 8 THEN NULL ELSE o_orderpriority END"


@query(f"""WITH t AS (SELECT o_orderkey, coalesce({_WRITTEN_DATES}, '') AS s FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(s, '^\\d+/\\d+/\\d{{4}}$') THEN 'ngày ' || split_part(s, '/', 1) || ' tháng ' || split_part(s, '/', 2) || ' năm ' || split_part(s, '/', 3)
WHEN ends_with(s, 'T08:00') THEN 'ngày ' || split_part(replace(s, 'T08:00', ''), '-', 3) || ' tháng ' || split_part(s, '-', 2) || ' năm ' || split_part(s, '-', 1) ELSE s END AS words, CASE WHEN ends_with(s, 'T08:00') THEN split_part(replace(s, 'T08:00', ''), '-', 3) || '/' || split_part(s, '-', 2) || '/' || split_part(s, '-', 1) ELSE s END AS short FROM t""")
def dates_for_export(spark, sf_dir):
    """D11."""
    x = F.expr(_WRITTEN_DATES)
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_in_words(x).alias("words"), dates.short_date(x).alias("short"))


_WORDS = list(numbers.NUMBER_WORDS)
_SAID = f"CASE WHEN event_id % 3 = 0 THEN upper(split('{';'.join(_WORDS)}', ';')[event_id % {len(_WORDS)}]) WHEN event_id % 3 = 1 THEN concat(CAST(event_id AS VARCHAR(20)), ' vụ') WHEN event_id % 7 = 2 THEN concat(CAST(user_id AS VARCHAR(20)), ',5%') ELSE event_type END"
_SAID_SQL = _SAID.replace("split(", "(str_split(").replace(f"[event_id % {len(_WORDS)}]", f")[event_id % {len(_WORDS)} + 1]")
_VALUES = "MAP {" + ", ".join(f"'{w}': {n}.0::DOUBLE" for w, n in numbers.NUMBER_WORDS.items()) + "}"


@query(f"""WITH t AS (SELECT event_id, {_SAID_SQL} AS x FROM events), u AS (SELECT event_id, x, trim(regexp_replace(x, '\\s*(vụ|%)$', '')) AS s FROM t), n AS (SELECT *, coalesce(TRY_CAST(replace(s, ',', '.') AS DOUBLE), {_VALUES}[lower(s)]) AS n FROM u)
SELECT event_id, n, CASE WHEN n IS NULL THEN 'not_a_number' WHEN TRY_CAST(x AS DOUBLE) = n THEN NULL WHEN {_VALUES}[lower(s)] IS NOT NULL THEN 'words' ELSE 'rewritten' END AS note FROM n""")
def number_words(spark, sf_dir):
    """All its words, in any case, and what it tells of a value."""
    x = F.expr(_SAID)
    return read(spark, sf_dir, "events").select("event_id", numbers.measured_number(x).alias("n"), numbers.measured_note(x).alias("note"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(p_brand, '__', p_name, '!') WHEN p_size % 3 = 1 THEN concat(CAST(p_size AS VARCHAR), ' ', p_type) ELSE concat('_', p_name, '_') END AS x FROM part), s AS (SELECT *, lower(trim(regexp_replace(regexp_replace(x, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS n FROM t)
SELECT p_partkey, CASE WHEN n = '' THEN 'unnamed_field' WHEN regexp_matches(n, '^[0-9]') THEN 'field_' || n ELSE n END AS snake, upper(trim(replace(x, '_', ' '))[1]) || lower(trim(replace(x, '_', ' '))[2:]) AS shown FROM s""")
def field_names(spark, sf_dir):
    """T27."""
    x = F.expr("CASE WHEN p_size % 3 = 0 THEN concat(p_brand, '__', p_name, '!') WHEN p_size % 3 = 1 THEN concat(CAST(p_size AS STRING), ' ', p_type) ELSE concat('_', p_name, '_') END")
    return read(spark, sf_dir, "part").select("p_partkey", text.snake_case(x).alias("snake"), text.humanised(x).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN v = floor(v) THEN w ELSE w || ',' || lpad(CAST(CAST(round(CAST(v - floor(v) AS DECIMAL(12,6)), 2) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS written FROM (SELECT o_orderkey, v, replace(format('{:,}', CAST(floor(v) AS BIGINT)), ',', '.') AS w FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS v FROM orders))")
def numbers_for_export(spark, sf_dir):
    """T29."""
    v = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.grouped_number(v).alias("written"))


_BODY = "translate(text, 'tT', 'dD')"
_REPORT = (
    f"concat(CASE WHEN n_chars % 11 = 0 THEN '' ELSE concat('Số ', CAST(doc_id AS VARCHAR(20)), chr(10), {_BODY}, chr(10)) END, CASE WHEN n_chars % 3 = 0 THEN '' ELSE concat('I.  Tình hình chung', chr(10), {_BODY}, chr(10)) END, CASE WHEN n_chars % 4 = 0 THEN '' ELSE concat('III. TỔNG QUÂN SỐ trực ', CAST(n_chars AS VARCHAR(20)), chr(10)) END, "
    "CASE WHEN n_chars % 5 = 0 THEN '' WHEN n_chars % 5 = 1 THEN concat('STT | Nội dung', chr(10), '(1)', chr(10), 'Danh  mục', chr(10), '1 | a', chr(10)) ELSE concat('bảng stt, chỉ tiêu', chr(10), '2 | b', chr(10)) END, CASE WHEN n_chars % 7 = 0 THEN concat('Nơi nhận: lưu', chr(10)) ELSE '' END)"
)


@query(f"""WITH t AS (SELECT doc_id, n_chars, {_REPORT} AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, x, length(x) + 1 AS e, CASE WHEN n_chars % 3 <> 0 THEN strpos(x, 'I.  Tình hình chung') END AS a, CASE WHEN n_chars % 4 <> 0 THEN strpos(x, 'III. TỔNG') END AS b,
 CASE WHEN n_chars % 5 = 1 THEN strpos(x, 'STT | N') WHEN n_chars % 5 > 1 THEN strpos(x, 'bảng stt, chỉ') END AS c, CASE WHEN n_chars % 7 = 0 THEN strpos(x, 'Nơi nhận:') END AS s FROM t),
r AS (SELECT doc_id, 'header' AS block_id, substring(x, 1, least(a, b, c, e) - 1) AS content FROM p UNION ALL SELECT doc_id, 'nghiep_vu', substring(x, a, least(CASE WHEN b > a THEN b END, CASE WHEN c > a THEN c END, e) - a) FROM p WHERE a IS NOT NULL
 UNION ALL SELECT doc_id, 'quan_so', substring(x, b, least(CASE WHEN c > b THEN c END, e) - b) FROM p WHERE b IS NOT NULL UNION ALL SELECT doc_id, 'bang_thong_ke', substring(x, c, CASE WHEN s > c THEN s ELSE e END - c) FROM p WHERE c IS NOT NULL)
SELECT doc_id, block_id, md5(content) AS content_md5, length(content) AS n FROM r WHERE regexp_matches(content, '\\S')""")
def split_report_parts(spark, sf_dir):
    """Reports put together of documents, cut again into their parts."""
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(text.split_parts(F.expr(_REPORT))).alias("b"))
    return rows.select("doc_id", "b.block_id", F.md5("b.content").alias("content_md5"), F.length("b.content").cast("long").alias("n"))


_PERIOD = f"concat('Từ ', {_D}, ' / ', {_M}, ' /', {_Y}, '  đến', chr(10), {_D}, '/', {_M}, '/ ', {_Y}, ' ')"
_RAN = "concat(p_name, CAST(p_size AS VARCHAR(20)), 'Vụ,', p_brand, '(', p_type, ')  x')"


@query(f"SELECT o_orderkey, trim(regexp_replace(regexp_replace({_PERIOD}, '(\\d{{1,2}})\\s*/\\s*(\\d{{1,2}})\\s*/\\s*(\\d{{4}})', '\\1/\\2/\\3', 'g'), '\\s+', ' ', 'g')) AS period FROM orders")
def period_texts(spark, sf_dir):
    """T33."""
    return read(spark, sf_dir, "orders").select("o_orderkey", text.clean_period(F.expr(_PERIOD)).alias("period"))


@query(f"SELECT p_partkey, regexp_replace(concat(' ', p_size, ' /BC ', p_brand), '\\s+', '', 'g') AS so_bao_cao, {_PADDED.format('concat(p_size % 28 + 1, chr(47), p_size % 12 + 1, chr(47), 2026)')} AS ngay, trim(regexp_replace({_SPACED.format(_RAN)}, '\\s+', ' ', 'g')) AS chi_tiet, trim(trim(regexp_replace({_SPACED.format('concat(chr(45), ' + _RAN + ', chr(58))')}, '\\s+', ' ', 'g')), ' .:-') AS noi_dung FROM part")
def normalise_business(spark, sf_dir):
    """T5: a record's number without blanks, its date padded, its texts with blanks restored, its labels without marks at the ends."""
    ran = F.expr(_RAN)
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.concat_ws(" ", F.lit(""), F.col("p_size"), F.lit("/BC"), "p_brand"), r"\s+", "").alias("so_bao_cao"), dates.clean_date(F.concat_ws(" / ", F.col("p_size") % 28 + 1, F.col("p_size") % 12 + 1, F.lit(2026))).alias("ngay"), text.clean_detail(ran).alias("chi_tiet"), text.clean_label(F.concat(F.lit("-"), ran, F.lit(":"))).alias("noi_dung"))


_ERROR = """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN concat('Read TIMEOUT after ', CAST(user_id AS VARCHAR(20)), ' s') WHEN event_id % 11 = 2 THEN 'HTTP 429 too many requests: timeout' WHEN event_id % 11 = 3 THEN 'division by zero' WHEN event_id % 11 = 4 THEN concat('Bad Gateway from ', event_type)
WHEN event_id % 11 = 5 THEN 'Template not found; network' WHEN event_id % 11 = 6 THEN concat('Extraction job ', CAST(user_id AS VARCHAR(20)), ' timeout') WHEN event_id % 11 = 7 THEN 'json schema mismatch' WHEN event_id % 11 = 8 THEN 'thoi_gian KHÔNG đúng định dạng, connection reset' WHEN event_id % 11 = 9 THEN props ELSE 'connection refused by 502' END"""
_KIND = "CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'KeyError' END WHEN event_id % 13 = 0 THEN 'ValidationError' WHEN event_id % 13 = 1 THEN 'TimeoutError' ELSE 'Exception' END"


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(f"WITH t AS (SELECT event_id, lower({_ERROR}) AS m, {_KIND} AS k FROM events) SELECT event_id, CASE WHEN m IS NULL AND k IS NULL THEN NULL WHEN k = 'ValidationError' THEN 'AI_OR_DATA_ERROR' WHEN k = 'TimeoutError' THEN 'SYSTEM_ERROR' WHEN {_has('m', L.DATA_WORDS)} THEN 'AI_OR_DATA_ERROR' WHEN {_has('m', L.SYSTEM_WORDS)} THEN 'SYSTEM_ERROR' ELSE 'LOGIC_ERROR' END AS kind, NOT {_has('m', L.FINAL_MARKS)} AND {_has('m', L.TRANSIENT_MARKS)} AS retry FROM t")
def error_classes(spark, sf_dir):
    """M6, M7: the class of each error, and whether another try is worth it."""
    return read(spark, sf_dir, "events").select("event_id", L.error_class(F.expr(_KIND), F.expr(_ERROR)).alias("kind"), L.retriable(F.expr(_ERROR)).alias("retry"))


@query("""WITH r AS (SELECT o_orderkey AS job, o_orderstatus <> 'O' AS ok, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS detail FROM orders)
SELECT job, 1 AS step, 'processing' AS from_state, CASE WHEN ok THEN 'extracted' ELSE 'failed' END AS to_state, CASE WHEN NOT ok THEN 'skipped' END AS enrichment FROM r UNION ALL SELECT job, 2, 'extracted', CASE WHEN detail <> '' THEN 'enriching' ELSE 'ready_for_review' END, CASE WHEN detail <> '' THEN 'pending' ELSE 'skipped' END FROM r WHERE ok""")
def stage1_events(spark, sf_dir):
    """M3."""
    results = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderstatus") != "O").alias("ok"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("detail"))
    return L.stage1_events(results)


@query("""WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'enriching' WHEN 'P' THEN 'approved' ELSE 'processing' END AS status FROM orders), r AS (SELECT l_orderkey AS job, count(*) AS items, max(l_linenumber) AS top FROM lineitem GROUP BY 1),
b AS (SELECT j.job, status, r.job IS NOT NULL AND status = 'enriching' AS o, CASE WHEN top = 7 THEN 'boom ' || items END AS error, CASE WHEN top <> 6 THEN items END AS items FROM j LEFT JOIN r ON r.job = j.job)
SELECT job, CASE WHEN o THEN 'ready_for_review' ELSE status END AS status, CASE WHEN o THEN CASE WHEN error IS NOT NULL THEN 'failed' WHEN items IS NOT NULL THEN 'enriched' ELSE 'skipped' END END AS enrichment, CASE WHEN o THEN error END AS error, CASE WHEN o AND error IS NULL THEN items END AS items FROM b""")
def enrichment_results(spark, sf_dir):
    """M4."""
    s = F.col("o_orderstatus")
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(s == "F", "enriching").when(s == "P", "approved").otherwise("processing").alias("status"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("top"))
    results = lines.select("job", F.when(F.col("top") != 6, F.col("n")).alias("items"), F.when(F.col("top") == 7, F.concat(F.lit("boom "), F.col("n").cast("string"))).alias("error"))
    return L.enriched(jobs, results)


_ACTION = "CASE WHEN l_linenumber = 1 THEN 'approve' WHEN l_linenumber = 2 THEN 'reject' WHEN l_linenumber = 3 THEN 'retry' ELSE 'delete' END"


@query(f"""WITH a AS (SELECT DISTINCT l_orderkey + l_suppkey % 2 * 1000000000 AS job, {_ACTION} AS action FROM lineitem), j AS (SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'F' THEN 'ready_for_review' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'processing' END AS status FROM orders)
SELECT a.job, action, CASE WHEN status IS NULL OR NOT ok THEN NULL WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' WHEN action = 'retry' THEN 'pending' ELSE 'deleted' END AS to_state, CASE WHEN status IS NULL THEN 'not_found' WHEN NOT ok THEN 'cannot ' || action || ' a job that is ' || status END AS error
FROM (SELECT a.*, status, (action IN ('approve', 'reject') AND status = 'ready_for_review') OR (action = 'retry' AND status = 'failed') OR (action = 'delete' AND status <> 'processing') AS ok FROM a LEFT JOIN j ON j.job = a.job) a""")
def review_actions(spark, sf_dir):
    """M5."""
    s = F.col("o_orderstatus")
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(s == "F", "ready_for_review").when(s == "P", "failed").otherwise("processing").alias("status"))
    actions = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_suppkey") % 2 * 1000000000).alias("job"), F.expr(_ACTION).alias("action")).distinct()
    return L.reviewed(jobs, actions)


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY r DESC) AS trace FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY user_id")
def bounded_traces(spark, sf_dir):
    """The last twenty steps of each job."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return L.bounded_trace(events, "user_id", ["ts", "event_id"], F.col("event_type"), 20).select("user_id", F.array_join("trace", ",").alias("trace"))


_SPOILT = "CASE WHEN doc_id % 3 = 0 THEN concat(translate(text, 'áàâéèêíóôúüöäßñçëïîùû', 'aaaeeeiooouuoasnceiiuu'), ' ch6y ch6n 5t 1n OOi 4t Q x') WHEN doc_id % 3 = 1 THEN substring(text, 1, n_chars % 90) ELSE text END"
_GARBLED = "[" + ", ".join(f"'{g}'" for g in text.GARBLED) + "]"


@query(f"""WITH t AS (SELECT doc_id, substring({_SPOILT}, 1, 2000) AS s, length(trim({_SPOILT}, ' ' || chr(10) || chr(9) || chr(13))) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, n, length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) AS letters, length(s) - length(translate(s, '{text.MARKED}', '')) AS marked, len([g FOR g IN {_GARBLED} IF contains(s, g)]) AS hits FROM t)
SELECT doc_id, n >= 50 AND letters >= 20 AND ((marked / greatest(letters, 1) < 0.01 AND hits >= 3) OR (marked / greatest(letters, 1) < 0.03 AND hits >= 5)) AS garbled, CAST(CASE WHEN NOT (n >= 50 AND letters >= 20) THEN 0 WHEN marked / greatest(letters, 1) < 0.01 AND hits >= 3 THEN least(1.0, 0.5 + hits * 0.1) WHEN marked / greatest(letters, 1) < 0.03 AND hits >= 5 THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence FROM c""")
def garbled_texts(spark, sf_dir):
    """T25."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.garbled(F.expr(_SPOILT)).alias("x"))
    return docs.select("doc_id", "x.garbled", "x.confidence")


_LISTED = "concat('Tham mưu Công văn số ', CAST(o_custkey AS VARCHAR(20)), '/CV-KV 30 ngày 1/2/2026 về việc ', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN '; ' ELSE ' và ' END, 'Báo cáo ', CAST(o_orderkey AS VARCHAR(20)), '/BC gửi quận. Kế hoạch chung', CASE WHEN o_orderkey % 3 = 0 THEN concat(', Tờ trình số: ', CAST(o_orderkey % 50 AS VARCHAR(20)), '/TTr 7 ngày 03/04/2026 xin, kinh phí') ELSE '' END)"


@query("SELECT o_orderkey, o_custkey || '/CV-KV30' AS so_ky_hieu, 'về việc ' || o_orderpriority AS noi_dung FROM orders UNION ALL SELECT o_orderkey, o_orderkey || '/BC', 'gửi quận' FROM orders UNION ALL SELECT o_orderkey, (o_orderkey % 50) || '/TTr7', 'xin, kinh phí' FROM orders WHERE o_orderkey % 3 = 0")
def listed_documents(spark, sf_dir):
    """T18."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.document_items(F.expr(_LISTED))).alias("d"))
    return rows.select("o_orderkey", "d.so_ky_hieu", "d.noi_dung")
