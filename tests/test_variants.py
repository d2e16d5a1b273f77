"""JSON of unknown keys against pandas, nested values against their shape written out, names and codes of templates."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators.schema_rules import field_codes, repaired, rule_codes, unique_names
from tallyforge.operators.variants import json_normalize, schema_tree, validated_nested

ROWS = [{"k": 1, "m": {"u": 5, "t": [1, 2], "x y": {"z": True}}}, {"k": 2.5}, {"m": {"u": 9_000_000_000, "o'k": "q"}}, {}, {"a": {"b": {"c": "deep"}}, "l": [{"x": 1}]}]


def test_columns_are_those_of_pandas(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)], "i int, j string")
    out = json_normalize(df, "j", ["i"])
    want = pd.json_normalize(ROWS, sep="_")
    assert set(out.columns) == {"i", "corrupt", *want.columns}
    for r in out.orderBy("i").collect():
        for c in want.columns:
            x, y = want.loc[r.i, c], r[c]
            if isinstance(x, list):
                assert json.loads(y) == x
            elif x is None or isinstance(x, float) and math.isnan(x):
                assert y is None
            else:
                assert y == x
        assert r.corrupt is None


def test_mixed_types_bad_json_and_names_alike(spark):
    texts = ['{"k":1,"m":{"u":1}}', '{"k":"a","m":7}', '{"k":', "[1]", None, '{"k":null,"m":{"v":2}}', '{"K":3,"m_u":8}', '{"i":"x"}', "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {r.i: r.asDict() for r in json_normalize(df, "j", ["i"]).collect()}
    assert {i: r["corrupt"] for i, r in got.items() if r["corrupt"]} == {2: '{"k":', 3: "[1]", 8: "5"}
    k = {"k", "k_2", "K", "K_2"} & set(got[0])
    assert len(k) == 2
    lower, upper = ("k", "K_2") if "K_2" in k else ("k_2", "K")
    assert (got[0][lower], got[1][lower], got[6][upper]) == ("1", "a", 3)
    assert (got[0]["m_u"], got[1]["m"], got[5]["m_v"], got[6]["m_u"], got[7]["i_2"]) == (1, "7", 2, 8, "x")
    assert json_normalize(df.limit(0), "j", ["i"]).count() == 0


@pytest.mark.parametrize(("text", "tree"), [("BIGINT", "BIGINT"), ("OBJECT<>", {}), ("OBJECT<`a``, b`: DECIMAL(2,1), c: ARRAY<OBJECT<d: VOID>>>", {"a`, b": "DECIMAL", "c": "ARRAY"})])
def test_schemas_are_read(text, tree):
    assert schema_tree(text)[0] == tree


SPEC = {"name": "f", "type": "object", "fields": [
    {"name": "n", "type": "number"}, {"name": "ngay", "type": "string"}, {"name": "tags", "type": "array", "items": {"type": "string"}},
    {"name": "rows", "type": "array", "items": {"type": "object", "fields": [{"name": "ok", "type": "boolean"}, {"name": "sub", "type": "object", "fields": [{"name": "v", "type": "number"}]}]}},
]}


def test_nested_values(spark):
    texts = [
        '{"n":"1500 vụ","ngay":"2026-04-01","tags":["a",1,null],"rows":[{"ok":"có","sub":{"v":2}},7,{"sub":"x"}]}',
        '{"n":3,"tags":"one","rows":{"ok":true}}', "[]", "{", None, "{}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {r.i: r for r in validated_nested(df, "j", SPEC, ["i"]).collect()}
    a = got[0].clean
    assert (float(a.n), a.ngay, a.tags) == (1500.0, "01/04/2026", ["a", "1", None])
    assert [(x.ok, x.sub and float(x.sub.v)) for x in a.rows] == [(True, 2.0), (None, None)]
    assert got[0].warnings == ["f.n: read number from 1500 vụ", "f.ngay: read string from 2026-04-01", "f.rows[0].ok: read boolean from có", "f.rows[1]: expected object, got number", "f.rows[2].sub: expected object, got string"]
    assert (got[1].clean.tags, [x.ok for x in got[1].clean.rows]) == (["one"], [True])
    assert got[1].warnings == ["f.tags: expected array, got string", "f.rows: expected array, got object"]
    assert (got[2].clean, got[2].warnings) == (None, ["f: expected object, got array"])
    assert (got[3].clean, got[3].warnings) == (None, ["not JSON"])
    assert (got[4].clean, got[4].warnings) == (None, []) and got[5].warnings == [] and got[5].clean.rows is None


def test_names_of_templates(spark):
    names = ["a", " a ", "a_2", "a-b", "a.b", "_x_", "-9", "9", "é", "", None, "a", "a_2", "--z--y--", "a_3"]
    df = spark.createDataFrame([("t", i, n, "number") for i, n in enumerate(names)] + [("u", 0, "a", "x"), ("u", 1, "b", None)], "t string, pos int, name string, type string")
    fixed = {r.pos: r.f for r in df.where("t = 't'").select("pos", repaired(F.col("name")).alias("f")).collect()}
    assert [fixed[i] for i in range(len(names))] == ["a", "a", "a_2", "a_b", "a_b", "_x_", None, None, None, None, None, "a", "a_2", "z_y", "a_3"]
    whole = unique_names(df.withColumn("fixed", repaired(F.col("name"))), ["t"], "pos", "fixed").where("t = 't' and unique is not null").orderBy("pos").collect()

    assert len({r.unique for r in whole}) == len(whole) and all(r.unique == r.fixed or r.unique.startswith(r.fixed + "_") for r in whole)
    codes = {(r.t, r.pos, r.code) for r in field_codes(df, ["t"], "pos").collect()}
    assert {c for c in codes if c[0] == "u"} == {("u", 0, "type_not_allowed"), ("u", 1, "type_not_allowed")}
    assert {p for t, p, c in codes if c == "duplicate_name"} == {0, 1, 2, 3, 4, 11, 12}
    assert {p for t, p, c in codes if c == "empty_name"} == {9, 10} and {p for t, p, c in codes if c == "invalid_name"} == {6, 7, 8}
    assert {p for t, p, c in codes if c == "renamed"} == {3, 4, 13}


def test_codes_of_rules(spark):
    df = spark.createDataFrame([(1, "o", "s", "sum"), (2, "", None, "MEDIAN"), (3, "o", "s", None)], "r int, output_field string, source_field string, method string")
    assert sorted((x.r, x.code) for x in rule_codes(df, ["r"]).collect()) == [(2, "method_not_allowed"), (2, "missing_output"), (2, "missing_source"), (3, "method_not_allowed")]
