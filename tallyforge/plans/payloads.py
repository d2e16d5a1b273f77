"""Layout, incident rows, payload reshaping and export rows. Roles: a conversation is a document and its turns are pages; an order is a report or a job."""

from pyspark.sql import functions as F

from tallyforge.operators import cells, layout, payload
from tallyforge.plans.registry import query, read
from tallyforge.sources import sinks

_WORDS = "SELECT conv_id, turn, unnest(string_split_regex(text, '[ \\n]+')) AS w, unnest(range(len(string_split_regex(text, '[ \\n]+')))) AS i FROM conversations WHERE text IS NOT NULL"
_LINES = f"SELECT conv_id, turn, CAST(i % 6 >= 3 AS INT) AS side, 12.5 * (i // 6) AS row, string_agg(CASE WHEN i % 3 > 0 AND (i - 1) % 2 = 0 THEN ' ' || w ELSE w END, '' ORDER BY i) AS line FROM ({_WORDS}) WHERE w <> '' GROUP BY ALL"


def _placed(spark, sf_dir):
    """Words six in a row, three in each half of a page; a word of odd place overlaps the next."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[ \n]+")).alias("i", "text"))
    left = F.col("i") % 6 * 100
    return turns.select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("i").alias("ord"), F.lit(600).alias("width"), "text",
        left.alias("x0"), (left + 100 + F.col("i") % 2 * 2).alias("x1"), (F.floor(F.col("i") / 6) * 12.5 + F.col("i") % 6 * 0.004).alias("top"),
    )


@query(f"SELECT conv_id AS doc, turn AS page, side, CAST(row AS DOUBLE) AS row, line FROM ({_LINES})")
def layout_lines(spark, sf_dir):
    """Words to the lines of each half of a page."""
    return layout.lines(_placed(spark, sf_dir))


_SPACED = "regexp_replace(regexp_replace({}, '([A-Za-zÀ-ỹ])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-zÀ-ỹ])', '\\1 \\2', 'g')"
_LOWER = layout.BOUNDARIES[2][0]


@query(
    f"SELECT conv_id AS doc, string_agg(t, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, regexp_replace({_SPACED.format('p')}, '{_LOWER}', '\\1 \\2', 'g') AS t"
    f" FROM (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY row, side) AS p FROM ({_LINES}) GROUP BY ALL)) GROUP BY ALL"
)
def layout_texts(spark, sf_dir):
    """P20: lines to pages and pages to documents."""
    return layout.texts(_placed(spark, sf_dir))


_CELLS = (
    "array(array(array('14', concat(' Tổng số vụ tai nạn, sự cố '), string(o_orderkey % 4)), array('15', 'Khác', '9'), array('16', 'Tổng số vụ CNCH', 'x'), array('17', NULL)),"
    " array(array('TT', 'Địa điểm', 'Nguyên nhân', 'Thời gian'), array('1', concat('Số ', o_orderkey), 'chập điện'), array('2')))"
)


def _tabled(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.expr(_CELLS)).alias("tables"))


@query("SELECT o_orderkey, 'Tổng số vụ tai nạn, sự cố' AS noi_dung, o_orderkey % 4 AS so_luong FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 4 > 0")
def incident_rows_from_table(spark, sf_dir):
    """Counted rows of a stat table."""
    return cells.incident_rows(_tabled(spark, sf_dir), "o_orderkey", "tables")


@query(
    "SELECT o_orderkey, 'Số ' || o_orderkey AS dia_diem, 'chập điện' AS nguyen_nhan, '' AS thiet_hai FROM orders WHERE o_orderkey % 5 > 0"
    " UNION ALL SELECT o_orderkey, '', '', '' FROM orders WHERE o_orderkey % 5 > 0"
)
def incident_table(spark, sf_dir):
    """A table of incidents, known by its header."""
    return cells.incident_table_rows(_tabled(spark, sf_dir), "o_orderkey", "tables")


@query(
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'BC/' || o_custkey) AS so, strftime(o_orderdate, '%-d/%-m/%Y') AS ngay,"
    " strftime(o_orderdate, '%-d') AS ngay_xuat, strftime(o_orderdate, '%-m') AS thang_xuat, strftime(o_orderdate, '%Y') AS nam_xuat,"
    " strftime(o_orderdate, '%-d/%-m/%Y') AS tu_ngay, CASE WHEN o_orderkey % 3 = 0 THEN '1/2/2000' END AS den_ngay, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 7 END AS tong FROM orders"
)
def header_promotion(spark, sf_dir):
    """A header's fields, its date and period, and the total."""
    day = F.date_format("o_orderdate", "d/M/yyyy")
    reports = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("so"), F.struct(F.concat(F.lit("BC/"), "o_custkey").alias("so"), day.alias("ngay")).alias("header")
    )
    said = F.concat(F.lit("(Từ "), "ngay", F.when(F.col("o_orderkey") % 3 == 0, F.lit(" đến 1/2/2000)")).otherwise(F.lit(")")))
    total = payload.total((F.col("o_orderkey") % 4).cast("string"), F.lit("3"), F.lit(4), F.lit(""))
    return payload.promoted(reports, "header").select("o_orderkey", "so", "ngay", *payload.date_parts(F.col("ngay")), *payload.period(said), total.alias("tong"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"danh_sach_cnch\":' || event_id || '}' WHEN 1 THEN '{\"data\":{\"k\":1},\"x\":2}' WHEN 2 THEN '{\"data\":{},\"x\":2}' ELSE '{}' END AS daily,"
    " CASE event_id % 4 WHEN 0 THEN '{\"danh_sach_cnch\":' || event_id || '}' WHEN 1 THEN '{\"k\":1}' WHEN 2 THEN '{\"data\":{},\"x\":2}' ELSE '{}' END AS calendar FROM events"
)
def payload_unwrap(spark, sf_dir):
    """The daily report unwraps known lists only, the calendar whatever is there."""
    said = F.expr("CASE event_id % 4 WHEN 0 THEN concat('{\"data\":{\"danh_sach_cnch\":', event_id, '},\"x\":2}') WHEN 1 THEN '{\"data\":{\"k\":1},\"x\":2}' WHEN 2 THEN '{\"data\":{},\"x\":2}' END")
    return read(spark, sf_dir, "events").select("event_id", payload.unwrapped(said).alias("daily"), payload.unwrapped(said, None).alias("calendar"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value, CAST(event_type IS NOT NULL AS INT) AS tags_n, event_type AS tag, '' AS nguoi_ky, 0 AS so, false AS xong, 0 AS rows_n FROM events")
def payload_shape(spark, sf_dir):
    """Declared fields are there, with their type's value where they were missing."""
    events = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), F.col("event_type").alias("tags"))
    out = payload.shaped(events, {"value": "number", "tags": "array", "nguoi_ky": "string", "so": "number", "xong": "boolean", "rows": "array"})
    return out.select("event_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.size("tags").alias("tags_n"), F.get("tags", F.lit(0)).alias("tag"), "nguoi_ky", "so", "xong", F.size("rows").alias("rows_n"))


_RULED = "SELECT o_custkey, count(*) AS jobs, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1"


@query(f"SELECT o_custkey, jobs, o_orderstatus, 'BC' || k AS so FROM ({_RULED})")
def summary_record(spark, sf_dir):
    """A report's results and what else its last row says."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"), F.struct(F.concat(F.lit("BC"), "o_orderkey").alias("so")).alias("header"), F.struct("o_orderkey").alias("dropped"))
    out = payload.summary(orders.groupBy("o_custkey").agg(F.count("*").alias("jobs")), orders, "o_custkey", "at")
    return out.select("o_custkey", "jobs", "o_orderstatus", "header.so")


@query(
    "SELECT o_custkey, CAST(CASE WHEN o_custkey % 3 < n THEN o_custkey % 3 ELSE 0 END AS INT) AS record_index, l[CASE WHEN o_custkey % 3 < n THEN o_custkey % 3 ELSE 0 END + 1] AS o_orderkey, 'Word' AS loai"
    " FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY 1)"
)
def record_context(spark, sf_dir):
    """A record picked by its place, before what the report says, after what the caller says."""
    reports = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("records"))
    reports = reports.select("o_custkey", "records", (F.col("o_custkey") % 3).alias("record_index"), F.lit(-1).cast("long").alias("o_orderkey"), F.lit("x").alias("_metadata"))
    return payload.context(reports, extra={"loai": F.lit("Word")}).select("o_custkey", "record_index", "o_orderkey", "loai")


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'máy bơm' ELSE '61A-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.52' END AS bien_so,"
    " CASE o_orderkey % 3 WHEN 0 THEN 'hỏng máy' WHEN 1 THEN 'cũ' ELSE '' END AS tinh_trang FROM orders"
)
def vehicle_normalise(spark, sf_dir):
    """P15."""
    plate = F.concat(F.lit("61"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" A - ")).otherwise(F.lit("A-")), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".52"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Xe "), plate, F.lit(" , hỏng  máy"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("xe "), plate)).otherwise(F.lit("Xe máy bơm"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(payload.vehicle(text, F.when(F.col("o_orderkey") % 3 == 1, F.lit(" cũ "))))))


@query("SELECT event_id, CASE WHEN event_id % 10 > 1 THEN value END AS value, CASE WHEN event_id % 10 > 1 THEN value END AS inner_value FROM events")
def nan_scrub(spark, sf_dir):
    """P16."""
    value = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 10 == 1, float("-inf")).otherwise(F.col("value"))
    events = read(spark, sf_dir, "events").select("event_id", value.alias("value"), F.array(F.struct(value.alias("v"))).alias("deep"))
    clean = events.select(*(payload.scrubbed(F.col(f.name), f.dataType).alias(f.name) for f in events.schema))
    return clean.select("event_id", "value", F.col("deep")[0]["v"].alias("inner_value"))


@query(
    "SELECT o_custkey, count(*) AS row_count, strftime(min(o_orderdate), '%Y-%m-%d') AS start, strftime(max(o_orderdate), '%Y-%m-%d') AS \"end\","
    " string_agg(o_orderkey || ':' || o_orderstatus || ' (' || substr(CAST(o_orderkey AS VARCHAR), 1, 8) || ')', ',' ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS jobs FROM orders GROUP BY 1"
)
def sources_used(spark, sf_dir):
    """P17, P18."""
    orders = read(spark, sf_dir, "orders").withColumn("file", payload.display_name(F.col("o_orderstatus"), F.col("o_orderkey")))
    out = payload.sources_used(orders, "o_custkey", "o_orderkey", "o_orderdate", "file")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("o_custkey", "row_count", day("start"), day("end"), F.array_join(F.transform("jobs", lambda j: F.concat(j["id"], F.lit(":"), j["file_name"])), ",").alias("jobs"))


@query(
    "SELECT l_orderkey, CASE WHEN n % 2 = 0 THEN CAST(s + n // 2 AS VARCHAR) ELSE CAST(s + n // 2 AS VARCHAR) || '.5' END AS tong, l AS danh_sach"
    " FROM (SELECT l_orderkey, sum(l_linenumber) AS s, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ', ' ORDER BY l_linenumber) AS l FROM lineitem GROUP BY 1)"
)
def render_list(spark, sf_dir):
    """A list where a value is due."""
    code = F.col("l_linenumber").cast("int")
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit(" "), code, F.lit(",5")).alias("k_t_qu"))).alias("a"), F.array_sort(F.collect_list(code)).alias("b"))
    return lists.select("l_orderkey", payload.rendered(F.col("a"), lists.schema["a"].dataType).alias("tong"), payload.rendered(F.col("b"), lists.schema["b"].dataType).alias("danh_sach"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE text END AS mo_ta FROM conversations")
def enrichment_refill(spark, sf_dir):
    """What the enriched rows lack comes from the first stage's."""
    turns = read(spark, sf_dir, "conversations")
    first = turns.select("conv_id", "turn", F.col("text").alias("mo_ta"), F.lit(1).alias("o"))
    return payload.refilled(turns.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("mo_ta")), first, ["conv_id", "turn"], ["mo_ta"], "o")


@query("SELECT doc_id, coalesce(len(string_split(text, ' ')), 0) AS words_n, array_to_string(string_split(text, ' ')[1:20], ' ') AS words FROM documents")
def export_preview(spark, sf_dir):
    """A list's size and the head that a preview shows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"), F.struct("lang").alias("part"), F.col("source").alias("_source"))
    return payload.preview(docs).select("doc_id", "words_n", F.array_join("words", " ").alias("words"))


def _reports(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.array("o_custkey", "o_custkey").alias("ds"), F.struct(F.col("o_custkey").alias("c")).alias("part"), F.struct(F.lit(1).alias("v")).alias("_metadata"))


_VALUES = "SELECT o_orderkey, unnest(['o_orderstatus', 'ds', 'part']) AS \"{}\", unnest([o_orderstatus, {}, '{{\"c\":' || o_custkey || '}}']) AS \"{}\" FROM orders"


@query(_VALUES.format("Trường", "'[2 phần tử]'", "Giá trị"))
def export_summary_sheet(spark, sf_dir):
    """The rows of a workbook's first sheet."""
    return sinks.summary_sheet(_reports(spark, sf_dir), "o_orderkey")


@query(_VALUES.format("Field", "'[' || o_custkey || ',' || o_custkey || ']'", "Value"))
def export_key_values(spark, sf_dir):
    """The rows of the CSV export."""
    return sinks.key_values(_reports(spark, sf_dir), "o_orderkey")


@query("SELECT o_orderkey AS job_id, o_custkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS note, CASE WHEN o_orderstatus = 'F' THEN '[1,' || o_custkey || ']' ELSE '[' || o_custkey || ']' END AS items FROM orders")
def export_detail_sheet(spark, sf_dir):
    """Each job's reviewed data, or what was extracted where there is none."""
    data = lambda note, items: F.struct(note.alias("note"), items.alias("items"))
    key = F.col("o_custkey")
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), key.alias("document_id"), F.when(F.col("o_orderstatus") == "F", data(F.col("o_orderpriority"), F.array(F.lit(1).cast("long"), key))).alias("reviewed"), data(F.col("o_orderstatus"), F.array(key)).alias("extracted"))
    return sinks.detail_sheet(jobs, ["job_id", "document_id"], "reviewed", "extracted")


@query("SELECT o_orderkey, 'exports/' || (o_custkey % 5) || '/daily/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderkey || '.csv' AS path FROM orders")
def daily_export_keys(spark, sf_dir):
    """S18."""
    return read(spark, sf_dir, "orders").select("o_orderkey", sinks.export_key(F.col("o_custkey") % 5, F.col("o_orderdate"), F.col("o_orderkey"), "csv").alias("path"))
