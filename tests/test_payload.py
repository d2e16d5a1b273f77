"""Layout, payload reshaping, file scans and exports on small cases."""

from pyspark.sql import functions as F

from tallyforge.operators import cells, layout, payload
from tallyforge.sources import files, sinks

WORDS = "doc int, page int, ord int, width double, text string, x0 double, x1 double, top double"


def test_words_to_lines(spark):
    rows = [(1, 1, 0, 100.0, " b ", 20.0, 30.0, 5.01), (1, 1, 1, 100.0, "a", 0.0, 19.0, 4.98), (1, 1, 2, 100.0, "c", 28.0, 40.0, 5.0), (1, 1, 3, 100.0, "R", 50.0, 60.0, 5.0), (1, 2, 0, None, "x9", None, None, None), (1, 2, 1, None, " ", 0.0, 0.0, 0.0), (2, 1, 0, 1.0, None, 0.0, 0.0, 0.0)]
    words = spark.createDataFrame(rows, WORDS)
    got = sorted((r.doc, r.page, r.side, r.row, r.line) for r in layout.lines(words).collect())
    assert got == [(1, 1, 0, 5.0, "a bc"), (1, 1, 1, 5.0, "R"), (1, 2, 1, 0.0, "x9")]
    assert [tuple(r) for r in layout.texts(words).collect()] == [(1, "a bc\nR\nx 9")]


def test_incident_rows_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[["Tổng số vụ CNCH", "x", "--5"], ["Tổng số vụ C N C H", None, "2"], ["only"]]])], "k int, t array<array<array<string>>>")
    assert [tuple(r) for r in cells.incident_rows(rows, "k", "t").collect()] == [(4, "", 2)]
    assert cells.incident_table_rows(rows, "k", "t").count() == 0


def test_vehicles(spark):
    rows = spark.createDataFrame([("Xe chữa cháy 61A-003.52", None), (" xe 61 a - 003.52, hỏng", ""), ("Xe 5", "cũ"), (None, None)], "a string, b string")
    got = [tuple(r.v) for r in rows.select(payload.vehicle(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [("chữa cháy 61A-003.52", ""), ("61a-003.52", "hỏng"), ("5", "cũ"), ("", "")]


def test_structs_become_columns_and_names_do_not_clash(spark):
    df = spark.sql("select named_struct('b', named_struct('c', 1), 'l', array(2)) as a, 9 as a_b_c")
    assert [tuple(r) for r in payload.normalised(df).collect()] == [(1, [2])]
    assert payload.normalised(df).columns == ["a_b_c", "a_l"]


def test_lists_as_values(spark):
    df = spark.sql("select array(named_struct('k_t_qu', '1,5'), named_struct('k_t_qu', 'x'), named_struct('k_t_qu', '98,50')) as a, array(named_struct('k_t_qu', '')) as b, cast(array() as array<int>) as c, array(named_struct('k_t_qu', '0')) as d")
    got = df.select(*(payload.rendered(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns)).first()
    assert tuple(got) == ("100", '[{"k_t_qu":""}]', "", "0")


def test_records_out_of_range_and_none(spark):
    df = spark.createDataFrame([(1, [(7,)], 5, 0), (2, [], 0, 3), (3, None, None, 4)], "k int, records array<struct<v:int>>, record_index int, v int")
    assert sorted((r.k, r.record_index, r.v) for r in payload.context(df).collect()) == [(1, 0, 7), (2, 0, 3), (3, 0, 4)]


def test_shape_of_structs_and_totals(spark):
    df = spark.sql("select cast(null as struct<x:int>) as o, 'a' as l, cast(null as string) as s")
    got = payload.shaped(df, {"o": "object", "l": "array", "s": "string", "new": "object"}).first()
    assert (got.o.x, got.l, got.s, got.new) == (None, ["a"], "", {})
    row = spark.range(1).select(payload.total(F.lit("x"), F.lit("1"), F.lit(None)).alias("a"), payload.total(F.lit(None), F.lit("x")).alias("b"), payload.total(F.lit("0"), F.lit(2)).alias("c")).first()
    assert tuple(row) == (1, None, 2)


def test_refill_takes_the_last_row_and_keeps_blank(spark):
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, m string, o int")
    rows = spark.createDataFrame([(1, ""), (1, "own"), (2, ""), (3, None)], "k int, m string")
    assert sorted((r.k, r.m or "-") for r in payload.refilled(rows, first, ["k"], ["m"], "o").collect()) == [(1, "b"), (1, "own"), (2, "-"), (3, "-")]


def test_files_are_listed_and_tenants_read_from_paths(spark, tmp_path):
    inbox = tmp_path / "inbox" / "t1"
    inbox.mkdir(parents=True)
    for name, text in (("a.PDF", "x"), ("b.pdf", ""), ("c.txt", "x")):
        (inbox / name).write_text(text)
    got = files.listing(spark, str(inbox)).select(F.substring_index("path", "/", -1), files.tenant(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("a.PDF", "t1")]
    assert spark.range(1).select(files.tenant(F.lit("other/a.pdf"))).first()[0] is None


def test_exports(spark, tmp_path):
    df = spark.sql("select 1 as k, 't' as tenant, array(1, 2) as l, array(named_struct('a', named_struct('b', 5))) as _source_records, named_struct('v', 1) as _metadata")
    sinks.write_workbook(df, "k", f"{tmp_path}/book")
    read = lambda p: sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/{p}").collect())
    assert read("book/summary") == [("1", "l", "[2 phần tử]"), ("1", "tenant", "t")]
    assert read("book/source_records") == [("1", "5")]
    sinks.write_csv(df, "k", f"{tmp_path}/pairs")
    assert [r[1] for r in read("pairs")] == ["_source_records", "l", "tenant"]
    sinks.write_json(df, f"{tmp_path}/json", ("tenant",))
    assert (tmp_path / "json" / "tenant=t").is_dir()


def test_an_export_that_fails_does_not_stop_the_stream(spark, tmp_path):
    spark.range(3).selectExpr("id as k", "'x' as v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "workbook").write_text("a file where the folder should be")
    run = sinks.auto_export(stream, "k", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert run.exception() is None and spark.read.json(f"{tmp_path}/out/json/0").count() == 3
