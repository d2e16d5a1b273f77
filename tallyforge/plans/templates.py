"""Templates scanned for their schema and rules, and files told their template. Roles: a part's brand is a template's text, put together of its parts' names."""

from pyspark.sql import functions as F

from tallyforge.operators import infer as I
from tallyforge.operators.matching import detected
from tallyforge.plans.registry import query, read, spread

#: A line of a template, by a part's size; expressions that Spark and DuckDB read alike.
_NAME = "concat(CASE WHEN p_size % 6 = 0 THEN 'tong_' WHEN p_size % 6 = 1 THEN 'ngay_' WHEN p_size % 6 = 2 THEN 'danh_sach_' WHEN p_size % 6 = 3 THEN 'is_' ELSE 'Ghi-' END, replace(p_type, ' ', '_'))"
_LINE = """CASE WHEN p_size % 5 = 0 THEN concat('{{ ', replace({0}, '-', '_'), ' }}') WHEN p_size % 5 = 1 THEN concat('{%p if ', replace({0}, '-', '_'), ' == 0 %}không{% endif %}') WHEN p_size % 5 = 2 THEN concat('{% for x in bang_', CAST(p_size % 3 AS VARCHAR(20)), ' %}{{ x.so_', CAST(p_size % 4 AS VARCHAR(20)), ' }}{{x.bien_so}}{{ y.mo_ta }}{%tr endfor %}')
WHEN p_size % 5 = 3 THEN concat('{% for y in ds_', CAST(p_size % 2 AS VARCHAR(20)), ' %}{% for x in bang_', CAST(p_size % 3 AS VARCHAR(20)), ' %}{{ y.ten_', CAST(p_size % 7 AS VARCHAR(20)), ' }}{{ x.tong_a }}{% endfor %}{% endfor %}') ELSE '{% for z in trong %}{% endfor %} {{ tong_bao_cao }}' END""".replace("{0}", _NAME)


def scanned(spark, sf_dir):
    """(template, p_partkey, text): a template's lines, in order of their part; no mark reaches over the end of a line."""
    return read(spark, sf_dir, "part").selectExpr("p_brand AS template", "p_partkey", f"{_LINE} AS text")


_T = f"SELECT p_brand AS template, p_partkey, p_size, p_type, {_LINE} AS line, replace({_NAME}, '-', '_') AS n FROM part"
_HOLES = f"""SELECT template, name, count(*) AS occurrences FROM (SELECT template, n AS name FROM ({_T}) WHERE p_size % 5 < 2 UNION ALL SELECT template, unnest(['x.so_' || p_size % 4, 'x.bien_so', 'y.mo_ta']) FROM ({_T}) WHERE p_size % 5 = 2
UNION ALL SELECT template, unnest(['y.ten_' || p_size % 7, 'x.tong_a']) FROM ({_T}) WHERE p_size % 5 = 3 UNION ALL SELECT template, 'tong_bao_cao' FROM ({_T}) WHERE p_size % 5 = 4) GROUP BY 1, 2"""


@query(f"SELECT template, name, occurrences, contains(name, '.') AS nested FROM ({_HOLES})")
def template_holes(spark, sf_dir):
    """Names in braces and in conditions."""
    return I.holes(scanned(spark, sf_dir), "template", "text")


_LOOPS = f'''WITH f AS (SELECT template, 'bang_' || p_size % 3 AS arr, 'x' AS alias, p_partkey * 10 AS pos, unnest(['so_' || p_size % 4, 'bien_so']) AS field, unnest([0, 1]) AS k FROM ({_T}) WHERE p_size % 5 = 2
UNION ALL SELECT template, 'bang_' || p_size % 3, 'x', p_partkey * 10, 'tong_a', 0 FROM ({_T}) WHERE p_size % 5 = 3 UNION ALL SELECT template, 'ds_' || p_size % 2, 'y', p_partkey * 10 + 1, 'ten_' || p_size % 7, 0 FROM ({_T}) WHERE p_size % 5 = 3
UNION ALL SELECT template, 'trong', 'z', min(p_partkey), 'value', 0 FROM ({_T}) WHERE p_size % 5 = 4 GROUP BY template),
g AS (SELECT template, arr, min(alias) AS item_alias, field, min(pos * 10 + k) AS pos FROM f GROUP BY template, arr, field)
SELECT template, arr AS "array", item_alias, field, CAST(row_number() OVER (PARTITION BY template, arr ORDER BY pos) - 1 AS INTEGER) AS place, CASE WHEN field = 'bien_so' OR field LIKE 'ten%' OR field = 'value' THEN 'string' ELSE 'number' END AS type FROM g'''


@query(_LOOPS)
def loop_scan(spark, sf_dir):
    """I2, I4."""
    return I.loops(scanned(spark, sf_dir), "template", "text", "p_partkey")


_KIND = "CASE WHEN contains(lower(name), 'ngay_') OR contains(lower(name), 'bao_cao') THEN 'string' WHEN starts_with(name, 'tong_') THEN 'number' WHEN starts_with(name, 'is_') THEN 'boolean' WHEN starts_with(name, 'danh_sach') THEN 'array' ELSE 'string' END"


_SCHEMAS = f"""WITH h AS (SELECT template, lower(name) AS name, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(name) AS said FROM ({_HOLES}) WHERE NOT contains(name, '.') GROUP BY 1, 2), l AS ({_LOOPS}), a AS (SELECT template, "array" AS name, string_agg(field || ':' || type, ',' ORDER BY place) AS fields FROM l GROUP BY 1, 2) SELECT template, name, CASE WHEN fields IS NOT NULL THEN 'array' ELSE {_KIND} END AS type, upper(replace(coalesce(said, name), '_', ' ')[1]) || lower(replace(coalesce(said, name), '_', ' ')[2:]) AS description, coalesce(fields, '') AS fields, coalesce(occurrences, 1) AS occurrences FROM h FULL JOIN a USING (template, name)"""


@query(_SCHEMAS)
def template_schemas(spark, sf_dir):
    """I6."""
    t = scanned(spark, sf_dir)
    out = I.schemas(I.holes(t, "template", "text"), I.loops(t, "template", "text", "p_partkey"), "template")
    return out.withColumn("fields", F.coalesce(F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["type"])), ","), F.lit("")))


@query(f"SELECT template, count(*) AS unique_variables, CAST(sum(occurrences) AS BIGINT) AS total_placeholders, count(CASE WHEN type = 'array' AND fields <> '' THEN 1 END) AS arrays_of_objects, count(CASE WHEN {' OR '.join(f"contains(name, '{w}')" for w in I.METADATA)} THEN 1 END) AS metadata_fields, any_value(n) AS total_holes FROM ({_SCHEMAS}) JOIN (SELECT template, count(*) AS n FROM ({_HOLES}) GROUP BY template) USING (template) GROUP BY template")
def template_scan_stats(spark, sf_dir):
    """A35."""
    t = scanned(spark, sf_dir)
    holes = I.holes(t, "template", "text")
    return I.template_stats(holes, I.schemas(holes, I.loops(t, "template", "text", "p_partkey"), "template"), "template")


@query(f"SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'MAX' WHEN contains(lower(name), 'ngay_') THEN '' WHEN starts_with(name, 'tong_') THEN 'SUM' WHEN starts_with(name, 'danh_sach') THEN 'CONCAT' ELSE 'LAST' END AS method FROM (SELECT p_partkey, p_size, {_NAME} AS name FROM part)")
def review_rules(spark, sf_dir):
    """I8."""
    named = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(_NAME).alias("name"))
    return named.select("p_partkey", I.default_method(F.col("name"), I.field_type(F.col("name")), F.when(F.col("p_size") % 9 == 0, "MAX").otherwise("")).alias("method"))


_PAGE = "concat(p_name, ' ', p_type, ' trang đầu của báo cáo ', CASE WHEN p_size % 2 = 0 THEN 'nation_1' ELSE 'region' END)"


@query(f"""WITH t AS (SELECT r_name AS template, r_regionkey AS place, CASE WHEN r_regionkey = 1 THEN 'widget.*7' WHEN r_regionkey = 3 THEN '^red' END AS pattern, CASE WHEN r_regionkey = 0 THEN ['ring', 'nation'] WHEN r_regionkey = 2 THEN ['economy', 'nation', 'bolt'] WHEN r_regionkey = 4 THEN ['promo', 'standard'] ELSE ['region', 'none'] END AS fields FROM region),
f AS (SELECT p_partkey, lower(concat(p_name, '_', p_size, '.pdf')) AS name, lower({_PAGE}) AS page FROM part), a AS (SELECT p_partkey, arg_min(template, place) AS x FROM f JOIN t ON pattern IS NOT NULL AND regexp_matches(name, pattern) GROUP BY 1),
b AS (SELECT p_partkey, template, place, len([x FOR x IN fields IF contains(page, x)]) / len(fields) AS score FROM f, t), c AS (SELECT p_partkey, arg_max(template, row(score, -place)) AS x FROM b WHERE score >= 0.7 GROUP BY 1)
SELECT f.p_partkey, coalesce(a.x, c.x) AS template, CASE WHEN a.x IS NOT NULL THEN 'name' WHEN c.x IS NOT NULL THEN 'page' END AS how FROM f LEFT JOIN a USING (p_partkey) LEFT JOIN c USING (p_partkey)""")
def template_detection(spark, sf_dir):
    """By name, else by first page, for two tenants that have the same templates; one pattern doesn't compile."""
    k = F.col("r_regionkey")
    fields = F.when(k == 0, F.array(F.lit("ring"), F.lit("nation"))).when(k == 2, F.array(*map(F.lit, ("economy", "nation", "bolt")))).when(k == 4, F.array(F.lit("promo"), F.lit("standard"))).otherwise(F.array(F.lit("region"), F.lit("none")))
    templates = read(spark, sf_dir, "region").select(F.col("r_name").alias("template"), k.alias("place"), F.when(k == 1, "widget.*7").when(k == 3, "^red").when(k == 2, "[bad").alias("pattern"), fields.alias("fields"), F.explode(F.array(F.lit(0), F.lit(1))).alias("tenant"))
    files = spread(read(spark, sf_dir, "part"), "p_partkey").select((F.col("p_size") % 2).alias("tenant"), "p_partkey", F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"), F.lit(".pdf")).alias("name"), F.expr(_PAGE).alias("page"))
    return detected(files, templates, "p_partkey").drop("tenant")
