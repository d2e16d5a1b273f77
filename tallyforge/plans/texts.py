"""Extraction, coercion and validation over text. Texts and cells are made of the tables' own columns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text
from tallyforge.operators.infer import field_type, placeholders, rule_method
from tallyforge.operators.matching import by_name, coverage
from tallyforge.plans.registry import query, read

#: A number of an event as people write it, by the event's id.
_WRITTEN = "CASE event_id % 8 WHEN 0 THEN event_id || ',500' WHEN 1 THEN ' ' || event_id || '.25 ' WHEN 2 THEN '1.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.000' WHEN 3 THEN '12,5' WHEN 4 THEN 'abc' WHEN 5 THEN event_id || ' kg' WHEN 6 THEN '-' || event_id ELSE '' END"


def written(spark, sf_dir):
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 8
    x = (
        F.when(k == 0, F.concat(e, F.lit(",500"))).when(k == 1, F.concat(F.lit(" "), e, F.lit(".25 "))).when(k == 2, F.concat(F.lit("1."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(".000")))
        .when(k == 3, "12,5").when(k == 4, "abc").when(k == 5, F.concat(e, F.lit(" kg"))).when(k == 6, F.concat(F.lit("-"), e)).otherwise("")
    )
    return read(spark, sf_dir, "events").select("event_id", x.alias("x"))


@query(f"SELECT event_id, CAST(coalesce(TRY_CAST(replace(trim(x), ',', '.') AS DECIMAL(38,10)), 0) AS DOUBLE) AS n FROM (SELECT event_id, {_WRITTEN} AS x FROM events)")
def coerce_number_n1(spark, sf_dir):
    return written(spark, sf_dir).select("event_id", numbers.garbage_number(F.col("x")).cast("double").alias("n"))


@query(f"SELECT event_id, CAST(trunc(TRY_CAST(replace(trim(x), ',', '.') AS DECIMAL(38,10))) AS BIGINT) AS n FROM (SELECT event_id, {_WRITTEN} AS x FROM events)")
def coerce_number_n2(spark, sf_dir):
    return written(spark, sf_dir).select("event_id", numbers.int_or_null(F.col("x")).alias("n"))


@query(f"SELECT event_id, coalesce(TRY_CAST(replace(replace(trim(x), ',', ''), '.', '') AS BIGINT), 0) AS n FROM (SELECT event_id, {_WRITTEN} AS x FROM events)")
def coerce_number_n3(spark, sf_dir):
    return written(spark, sf_dir).select("event_id", numbers.int_or_zero(F.col("x")).alias("n"))


@query("SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN event_id * 1000 + 500 WHEN 1 THEN event_id + 0.25 WHEN 2 THEN 1000000 + (event_id % 1000) * 1000 WHEN 3 THEN 12.5 WHEN 5 THEN event_id WHEN 6 THEN -event_id END AS DOUBLE) AS n FROM events")
def coerce_number_n4(spark, sf_dir):
    return written(spark, sf_dir).select("event_id", numbers.measured_number(F.col("x")).alias("n"))


@query(f"SELECT event_id, CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) ELSE 0 END AS n5, CASE WHEN regexp_full_match(trim(x), '-?[0-9]+') THEN CAST(trim(x) AS BIGINT) WHEN len(regexp_extract_all(x, '-?[0-9]+')) >= 2 THEN CAST(list_last(regexp_extract_all(x, '-?[0-9]+')) AS BIGINT) ELSE 0 END AS n6 FROM (SELECT event_id, {_WRITTEN} AS x FROM events)")
def coerce_cells(spark, sf_dir):
    return written(spark, sf_dir).select("event_id", numbers.digits_or(F.col("x")).alias("n5"), numbers.cell_number(F.col("x")).alias("n6"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false END AS b FROM events")
def coerce_bool(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, [" Có ", "không", "YES", "0", "", "perhaps"])), (F.col("event_id") % 6).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", numbers.boolean(words).alias("b"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def coerce_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    x = F.when(k == 0, F.date_format(d, "d/M/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "yyyy/M/d"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.report_date(F.concat(F.lit(" "), x)), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, 2 AS n, strftime(o_orderdate, '%Y-%m-%d') AS first_day, strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') AS last_day FROM orders")
def dates_from_text(spark, sf_dir):
    d = F.to_date("o_orderdate")
    x = F.concat(F.lit("Từ ngày "), F.date_format(d, "dd/MM/yyyy"), F.lit(" (31/02/2026) đến "), F.date_format(F.date_add(d, 6), "d/M/yyyy"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", dates.dates_in(x).alias("found"))
    return rows.select("o_orderkey", F.size("found").alias("n"), F.date_format(F.col("found")[0], "yyyy-MM-dd").alias("first_day"), F.date_format(F.element_at("found", -1), "yyyy-MM-dd").alias("last_day"))


@query("SELECT o_orderkey, CASE WHEN m NOT BETWEEN 1 AND 12 THEN 'date_month_out_of_range' WHEN d NOT BETWEEN 1 AND 31 THEN 'date_day_out_of_range' WHEN y NOT BETWEEN 2020 AND 2030 THEN 'date_year_out_of_range' WHEN d > CASE WHEN m = 2 THEN 29 WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END THEN 'date_day_exceeds_month' END AS code FROM (SELECT o_orderkey, o_orderkey % 33 AS d, o_orderkey % 14 AS m, 2018 + o_orderkey % 15 AS y FROM orders)")
def date_validation_codes(spark, sf_dir):
    part = lambda n, size: F.lpad((F.col("o_orderkey") % n).cast("string"), size, "0")
    x = F.concat_ws("/", part(33, 2), part(14, 2), (2018 + F.col("o_orderkey") % 15).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_code(x).alias("code"))


@query("SELECT doc_id, trim(regexp_replace(strip_accents(upper(replace(text, 'ß', 'SS'))), '\\s+', ' ', 'g')) AS folded FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


_SPACED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{L}})([0-9])', '\\1 \\2', 'g'), '([0-9])(\\p{{L}})', '\\1 \\2', 'g'), '([.,;:)])([^\\s0-9).,;:])', '\\1 \\2', 'g'), '(\\p{{L}})\\(', '\\1 (', 'g')"


@query(f"SELECT doc_id, regexp_replace(trim(regexp_replace({_SPACED.format('text')}, '\\s+', ' ', 'g')), '^[ .:-]+|[ .:-]+$', '', 'g') AS label FROM documents")
def restore_spacing(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_label(F.col("text")).alias("label"))


@query("SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN floor(1000 * (length(text) - length(regexp_replace(text, '[ÃÂÐ�¤¦]', '', 'g'))) / length(text)) ELSE 0 END AS BIGINT) AS score FROM documents")
def mojibake_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.garbled_share(F.col("text")).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'report' WHEN p_partkey % 3 = 1 THEN 'plan' ELSE 'dispatch' END AS kind, p_partkey % 9000 || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'BC' WHEN p_partkey % 3 = 1 THEN 'KH' ELSE 'CV' END || '-KV30' AS code FROM part")
def doc_type_counters(spark, sf_dir):
    k = F.col("p_partkey") % 3
    said = F.concat(F.lit("văn bản "), (F.col("p_partkey") % 9000).cast("string"), F.lit("/"), F.when(k == 0, "BC").when(k == 1, "KH").otherwise("CV"), F.lit("-KV30 ngày 01/04/2026"))
    code = text.document_codes(said)[0]
    return read(spark, sf_dir, "part").select("p_partkey", text.document_type(code).alias("kind"), code.alias("code"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(coalesce(list_position([length(l) > 120 for l in string_split(text, chr(10))], true), 0) AS INTEGER) AS first_long FROM documents WHERE text IS NOT NULL")
def block_boundaries(spark, sf_dir):
    """Where a block begins: the first line that fits."""
    lines = F.split("text", "\n", -1)
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).alias("lines"), F.array_position(F.transform(lines, lambda x: F.length(x) > 120), True).cast("int").alias("first_long"))


@query("WITH l AS (SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)), h AS (SELECT *, max(CASE WHEN length(line) < 40 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS head FROM l) SELECT doc_id, head, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM h WHERE head IS NOT NULL GROUP BY 1, 2")
def section_carry_forward(spark, sf_dir):
    """Lines under the short line (a heading) before them."""
    sections = held_sections(read(spark, sf_dir, "documents")).select("doc_id", F.explode("sections").alias("s"))
    return sections.select("doc_id", "s.head", F.col("s.lines").cast("long").alias("lines"), F.col("s.chars").cast("long").alias("chars"))


def held_sections(docs):
    """(doc_id, sections: array of head, title, lines, chars): lines from one heading to the next. One text is one row throughout: nothing is shuffled."""
    rows = docs.where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("held")).withColumn("sizes", F.transform("held", lambda x: F.length(x)))
    rows = rows.withColumn("heads", F.filter(F.transform("sizes", lambda n, i: F.when(n < 40, i)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0))), F.array(F.size("held")))
    one = lambda h, e: F.struct(h.alias("head"), F.col("held")[h].alias("title"), (e - h).alias("lines"), F.aggregate(F.slice("sizes", h + 1, e - h), F.lit(0), lambda a, n: a + n).alias("chars"))
    return rows.where("size(heads) > 0").select("doc_id", F.zip_with("heads", ends, one).alias("sections"))


@query("WITH l AS (SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)), h AS (SELECT *, max(CASE WHEN length(line) < 40 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS head FROM l), s AS (SELECT doc_id, head, arg_min(line, n) AS title, count(*) - 1 AS lines FROM h WHERE head IS NOT NULL GROUP BY 1, 2) SELECT doc_id, md5(title) AS title, arg_max(lines, head) AS lines FROM s GROUP BY doc_id, s.title")
def section_last_runs(spark, sf_dir):
    """A heading that comes again begins its lines anew, so its last run counts."""
    later = lambda s, i: F.exists(F.slice("sections", i + 2, F.size("sections")), lambda t: t["title"] == s["title"])
    last = held_sections(read(spark, sf_dir, "documents")).select("doc_id", F.explode(F.filter("sections", lambda s, i: ~later(s, i))).alias("s"))
    return last.select("doc_id", F.md5("s.title").alias("title"), (F.col("s.lines") - 1).cast("long").alias("lines"))


@query("SELECT l_orderkey, l_linenumber AS stt, max_by(CAST(l_quantity AS BIGINT), row(l_partkey, l_suppkey, l_quantity)) AS ket_qua, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2")
def table_rows_parse(spark, sf_dir):
    """Rows of cells, read back from text: a code, a label, a value; the last of a code by the cells' order counts."""
    row = F.concat_ws(" | ", F.col("l_linenumber"), F.concat(F.lit("Mục "), "l_returnflag"), F.col("l_quantity").cast("long"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.split(row, r" \| ").alias("cells"))
    parsed = rows.select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_quantity").alias("o"), F.col("cells")[0].try_cast("int").alias("stt"), F.regexp_extract(F.col("cells")[1], r"^Mục (\S+)$", 1).alias("label"), numbers.cell_number(F.col("cells")[2]).alias("v"))
    return parsed.groupBy("l_orderkey", "stt").agg(F.max_by("v", "o").alias("ket_qua"), F.max("label").alias("flag"))


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS codes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def text_grid_parse(spark, sf_dir):
    """A grid in running text, one line a row, read back by pattern."""
    row = F.concat_ws(" ", F.col("l_linenumber"), F.concat(F.lit("Số vụ "), "l_returnflag"), F.col("l_quantity").cast("long"))
    grid = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list(row)).alias("grid"))
    part = lambda i: F.transform(F.split("grid", "\n"), lambda line: F.regexp_extract(line, r"^(\d+) (.+?) (-?\d+)$", i).try_cast("bigint"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return grid.select("l_orderkey", total(part(1)).alias("codes"), total(part(3)).alias("total"))


def _both():
    """Templates that two tenants have alike."""
    return F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("tenant")


@query("SELECT p_brand AS template, best AS pattern FROM (SELECT p_brand, (SELECT min(r_name) FROM region WHERE lower(p_brand) LIKE '%' || lower(substr(r_name, 1, 1)) || '%') AS best FROM (SELECT DISTINCT p_brand FROM part)) WHERE best IS NOT NULL")
def template_match_regex(spark, sf_dir):
    """The first pattern that a name has."""
    names = read(spark, sf_dir, "part").select((F.crc32(F.col("p_brand").cast("binary")) % 2).alias("tenant"), F.col("p_brand").alias("name")).distinct()
    patterns = read(spark, sf_dir, "region").select(_both(), F.col("r_name").alias("template"), F.col("r_name").alias("place"), F.substring("r_name", 1, 1).alias("pattern"))
    return by_name(names, patterns).select(F.col("name").alias("template"), F.col("template").alias("pattern"))


@query("SELECT p_type, n_name AS template, round(hits / total, 4) AS score FROM (SELECT p_type, n_name, hits, total, row_number() OVER (PARTITION BY p_type ORDER BY hits / total DESC, n_nationkey) AS r FROM (SELECT p_type, n_name, n_nationkey, CAST(len([c for c in list_distinct(string_split(lower(n_name), '')) if contains(lower(p_type), c)]) AS DOUBLE) AS hits, CAST(len(list_distinct(string_split(lower(n_name), ''))) AS DOUBLE) AS total FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN nation)) WHERE r = 1")
def template_match_coverage(spark, sf_dir):
    """The template of which most fields occur in the text; of equals the first."""
    texts = read(spark, sf_dir, "part").select((F.crc32(F.col("p_type").cast("binary")) % 2).alias("tenant"), "p_type", F.col("p_type").alias("page")).distinct()
    fields = F.array_distinct(F.filter(F.split(F.lower("n_name"), ""), lambda c: c != ""))
    templates = read(spark, sf_dir, "nation").select(_both(), F.col("n_name").alias("template"), F.col("n_nationkey").alias("place"), fields.alias("fields"))
    best = coverage(texts, "p_type", templates).groupBy("p_type").agg(F.max_by(F.struct("template", "score"), F.struct("score", -F.col("place"))).alias("x"))
    return best.select("p_type", "x.template", F.round("x.score", 4).alias("score"))


_NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'tong_so_vu_' WHEN 1 THEN 'stt_' WHEN 2 THEN 'danh_sach_' WHEN 3 THEN 'ngay_' WHEN 4 THEN 'is_' WHEN 5 THEN 'tong_bao_cao_' WHEN 6 THEN 'price_' ELSE 'ghi_chu_' END || p_size"


def named(spark, sf_dir):
    stems = F.array(*map(F.lit, ["tong_so_vu_", "stt_", "danh_sach_", "ngay_", "is_", "tong_bao_cao_", "price_", "ghi_chu_"]))
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("template"), F.concat(F.element_at(stems, (F.col("p_partkey") % 8).cast("int") + 1), F.col("p_size").cast("string")).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'number' WHEN 1 THEN 'number' WHEN 2 THEN 'array' WHEN 3 THEN 'string' WHEN 4 THEN 'boolean' WHEN 5 THEN 'string' WHEN 6 THEN 'number' ELSE 'string' END AS kind FROM part")
def infer_types(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", field_type(F.col("name")).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'SUM' WHEN 1 THEN 'SUM' WHEN 2 THEN 'CONCAT' WHEN 4 THEN 'LAST' WHEN 6 THEN 'SUM' WHEN 7 THEN 'LAST' END AS method FROM part")
def infer_rules(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", rule_method(F.col("name")).alias("method"))


@query(f"SELECT p_brand AS template, name, count(*) * 2 AS occurrences FROM (SELECT p_brand, {_NAMES} AS name FROM part) GROUP BY 1, 2")
def placeholder_scan(spark, sf_dir):
    x = F.concat(F.lit("Số {{ "), "name", F.lit(" }} và {{"), "name", F.lit("}}."))
    return placeholders(named(spark, sf_dir).select("template", x.alias("text")), "template", "text")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def json_flatten(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props")).select("event_id", F.col("props.k").alias("props_k"))


@query("SELECT o_orderkey, strip_accents(o_orderpriority) IS NOT NULL AS ok, (o_orderkey % 40) || ' báo cáo' AS said, CAST(o_orderkey % 40 AS INTEGER) AS reports, CAST(o_orderkey % 7 AS INTEGER) AS plans FROM orders")
def narrative_counters(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.concat((k % 40).cast("string"), F.lit(" báo cáo"))
    full = F.concat(F.lit("Đã ban hành "), said, F.lit(", kế hoạch: "), (k % 7).cast("string"), F.lit(", số 12/5 báo cáo"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").isNotNull().alias("ok"), said.alias("said"), text.counter(full, "báo cáo").alias("reports"), text.counter(full, "kế hoạch").alias("plans"))
