"""JSON of unknown and of declared shapes, and templates' own rules. Roles: an event's properties are an upload's payload, an order a job, a part a template's field."""

from pyspark.sql import functions as F

from tallyforge.operators.schema_rules import field_codes, repaired, rule_codes, unique_names
from tallyforge.operators.variants import json_normalize, validated_nested
from tallyforge.plans.registry import query, read, spread

#: Payloads with keys that differ by row, nested, of several types, and some that are no JSON; expressions that Spark and DuckDB read alike.
_PROPS = """CASE WHEN event_id % 6 = 0 THEN props WHEN event_id % 6 = 1 THEN concat('{"k":', CAST(user_id AS VARCHAR(20)), ',"more":{"user":', CAST(user_id AS VARCHAR(20)), ',"tags":[1,', CAST(event_id AS VARCHAR(20)), ']}}')
WHEN event_id % 6 = 2 THEN concat('{"k":"', event_type, '","more":{"deep":{"ok":true}}}') WHEN event_id % 6 = 3 THEN '{"k":' WHEN event_id % 6 = 4 THEN concat('{"more":{"user":null,"deep":', CAST(event_id AS VARCHAR(20)), '},"share":0.5}') END"""


@query(f"""SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN json_extract_string(j, '$.k') END AS k, CASE WHEN event_id % 6 = 1 THEN user_id END AS more_user, CASE WHEN event_id % 6 = 1 THEN '[1,' || event_id || ']' END AS more_tags,
CASE WHEN event_id % 6 = 2 THEN true END AS more_deep_ok, CASE WHEN event_id % 6 = 4 THEN event_id::VARCHAR END AS more_deep, CASE WHEN event_id % 6 = 4 THEN 0.5::DOUBLE END AS share, CASE WHEN event_id % 6 = 3 THEN j END AS corrupt
FROM (SELECT event_id, user_id, {_PROPS} AS j FROM events)""")
def json_normalize_props(spark, sf_dir):
    """Columns for all keys that the payloads have; what is no JSON apart."""
    events = read(spark, sf_dir, "events").select("event_id", F.expr(_PROPS).alias("j"))
    return json_normalize(events, "j", ["event_id"])


_FORM = {"name": "form", "type": "object", "fields": [
    {"name": "so", "type": "number"}, {"name": "duyet", "type": "boolean"}, {"name": "ngay_lap", "type": "string"},
    {"name": "vu", "type": "array", "items": {"type": "object", "fields": [{"name": "noi", "type": "string"}, {"name": "muc", "type": "array", "items": {"type": "object", "fields": [{"name": "n", "type": "number"}]}}]}},
]}

_JSON = """concat('{"so":"', CAST(o_orderkey AS VARCHAR(20)), ' vụ","duyet":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '"không"' END, ',"ngay_lap":"7h30","vu":', CASE WHEN o_orderkey % 3 = 0 THEN '{"noi":"A","muc":[{"n":1},5]}' WHEN o_orderkey % 3 = 1 THEN concat('[{"noi":"', o_orderpriority, '"},"x",{"muc":{"n":"', CAST(o_custkey AS VARCHAR(20)), ' kg"}}]') ELSE '[]' END, '}')"""


def forms(spark, sf_dir):
    return spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").select("o_orderkey", F.expr(_JSON).alias("j"))


@query(
    "SELECT o_orderkey, o_orderkey::DOUBLE AS so, o_orderkey % 2 = 0 AS duyet, '07:30' AS ngay_lap, CAST([1, 2, 0][o_orderkey % 3 + 1] AS INTEGER) AS vu, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey::DOUBLE WHEN o_orderkey % 3 = 0 THEN 1.0 END AS n,"
    " 'form.so: read number from ' || o_orderkey || ' vụ' || CASE WHEN o_orderkey % 2 = 1 THEN '|form.duyet: read boolean from không' ELSE '' END || '|form.ngay_lap: read string from 7h30'"
    " || CASE o_orderkey % 3 WHEN 0 THEN '|form.vu: expected array, got object|form.vu[0].muc[1]: expected object, got number' WHEN 1 THEN '|form.vu[1]: expected object, got string|form.vu[2].muc: expected array, got object|form.vu[2].muc[0].n: read number from ' || o_custkey || ' kg' ELSE '' END AS warnings FROM orders"
)
def validated_nested_forms(spark, sf_dir):
    """Objects in arrays in objects in arrays, each value coerced and told by its path."""
    rows = validated_nested(forms(spark, sf_dir), "j", _FORM, ["o_orderkey"])
    last = F.element_at(F.flatten(F.transform(F.filter("clean.vu", lambda x: x["muc"].isNotNull()), lambda x: x["muc"])), -1)
    found = F.when(F.size("clean.vu") > 0, last["n"])
    return rows.select("o_orderkey", F.col("clean.so").cast("double").alias("so"), "clean.duyet", "clean.ngay_lap", F.size("clean.vu").alias("vu"), found.cast("double").alias("n"), F.array_join("warnings", "|").alias("warnings"))


_NAME = "CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 7 = 1 THEN concat('tổng-', CAST(p_size AS VARCHAR(9)), 'x') WHEN p_partkey % 7 = 2 THEN '9 9' WHEN p_partkey % 7 = 3 THEN concat(' ngay', CAST(p_size % 3 AS VARCHAR(9)), 'a ') ELSE concat('f', CAST(p_partkey AS VARCHAR(20))) END"
_FIXED = "CASE WHEN p_partkey % 7 = 1 THEN concat('t_ng_', CAST(p_size AS VARCHAR(9)), 'x') WHEN p_partkey % 7 = 3 THEN concat('ngay', CAST(p_size % 3 AS VARCHAR(9)), 'a') WHEN p_partkey % 7 > 3 THEN concat('f', CAST(p_partkey AS VARCHAR(20))) END"
_TYPE = "CASE WHEN p_partkey % 11 = 0 THEN 'date' WHEN p_partkey % 11 = 1 THEN NULL ELSE 'number' END"


def _fields(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("template"), F.col("p_partkey").alias("pos"), F.expr(_NAME).alias("name"), F.expr(_TYPE).alias("type"))


@query(f"WITH f AS (SELECT p_brand AS template, p_partkey AS pos, p_partkey % 7 AS k, {_FIXED} AS fixed, {_TYPE} AS type FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY template, fixed) AS many FROM f) SELECT template, pos, 'empty_name' AS code FROM n WHERE k = 0 UNION ALL SELECT template, pos, 'invalid_name' FROM n WHERE k = 2 UNION ALL SELECT template, pos, 'renamed' FROM n WHERE k = 1 UNION ALL SELECT template, pos, 'type_not_allowed' FROM n WHERE type IS NULL OR type = 'date' UNION ALL SELECT template, pos, 'duplicate_name' FROM n WHERE fixed IS NOT NULL AND many > 1")
def template_field_codes(spark, sf_dir):
    """V9: what the fields of all templates break."""
    return field_codes(_fields(spark, sf_dir), ["template"], "pos")


@query(f"SELECT template, pos, fixed || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS repaired FROM (SELECT *, row_number() OVER (PARTITION BY template, fixed ORDER BY pos) AS r FROM (SELECT p_brand AS template, p_partkey AS pos, {_FIXED} AS fixed FROM part) WHERE fixed IS NOT NULL)")
def template_names_repaired(spark, sf_dir):
    """V9: names made identifiers, and each its template's only one."""
    fields = _fields(spark, sf_dir).withColumn("fixed", repaired(F.col("name"))).where("fixed is not null")
    return unique_names(fields, ["template"], "pos", "fixed").select("template", "pos", F.col("unique").alias("repaired"))


@query("SELECT p_partkey AS rule, unnest(list_filter([CASE WHEN p_size % 10 = 0 THEN 'missing_output' END, CASE WHEN p_size % 9 = 0 THEN 'missing_source' END, CASE WHEN p_size % 4 = 3 THEN 'method_not_allowed' END], lambda c: c IS NOT NULL)) AS code FROM part")
def template_rule_codes(spark, sf_dir):
    """V9: what the aggregation rules of all templates break."""
    k = F.col("p_size")
    rules = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule"), F.when(k % 10 > 0, "out").alias("output_field"), F.when(k % 9 > 0, "in").otherwise("").alias("source_field"), F.element_at(F.array(*map(F.lit, ["sum", "Last", "CONCAT", "median"])), k % 4 + 1).alias("method"))
    return rule_codes(rules, ["rule"])
