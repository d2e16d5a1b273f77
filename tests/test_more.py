"""Functions and operators whose small cases tell more than whole tables."""

import os
import time

from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text
from tallyforge.operators import filters, infer, lifecycle, stats, validate
from tallyforge.operators.rules import Rule, apply_rules
from tallyforge.sources.files import watched


def values(spark, items, make):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(make(F.col("x")).alias("y")).collect()]


def test_dates_of_all_forms(spark):
    said = ["7h30", "24h10", "2/3/2026", "02-03-2026", "2026.3.2", "31/02/2026", "Ngày 2 tháng 3 năm 2026 lúc", "20260302", "2 Mar 2026", "mai", " ", None]
    got = values(spark, said, dates.coerced_date)
    assert [r.value for r in got] == ["07:30", "24h10", "02/03/2026", "02/03/2026", "02/03/2026", "31/02/2026", "02/03/2026", "03/02/2026", "02/03/2026", "mai", None, None]
    assert [r.note for r in got] == ["time", "not_recognised", "date", "date", "date", "not_recognised", "words", "free", "free", "not_recognised", None, None]
    assert [(r.value, r.valid) for r in values(spark, ["7H05", "2/4/2026", "7:30", "12 giờ 5 phút ngày 1/2/2026", "12:05 NGÀY 01/02/2026", ""], dates.incident_time)] == [("07:05", True), ("02/04/2026", True), ("7:30", False), ("12 giờ 5 phút ngày 01/02/2026", True), ("12:05 NGÀY 01/02/2026", True), ("", True)]
    assert values(spark, ["1/2/2026", "2026-02-01T05", "x", None], dates.date_in_words) == ["ngày 1 tháng 2 năm 2026", "ngày 01 tháng 02 năm 2026", "x", ""]


def test_number_words_and_notes(spark):
    assert values(spark, ["năm"], numbers.measured_number) == [None]  # its last letter is a unit
    assert values(spark, ["MƯỜI LĂM", "ngàn", "bay", "12,5%", "1.500 vụ", "7", "x"], numbers.measured_number) == [15, 1000, 7, 12.5, 1.5, 7, None]
    assert values(spark, ["MƯỜI LĂM", "12,5%", "7", "x", " "], numbers.measured_note) == ["words", "rewritten", None, "not_a_number", None]


def test_names_and_numbers_for_export(spark):
    assert values(spark, ["Tổng số", "9 a__b", "__", "aB"], text.snake_case) == ["t_ng_s", "field_9_a_b", "unnamed_field", "ab"]
    assert values(spark, ["1500000", "1234.5", "0.005", "x"], lambda x: text.grouped_number(x.try_cast("double"))) == ["1.500.000", "1.234,50", "0,01", "0"]


def test_rules_by_type(spark):
    rows = spark.createDataFrame([("a", "1,5", True, ["1", "x"]), ("a", "?", False, ["2,5"]), ("a", None, None, None)], "k string, t string, b boolean, l array<string>")
    got = apply_rules(rows, ["k"], [Rule("t", "t"), Rule("b", "b"), Rule("l", "l"), Rule("m", "t", "AVG"), Rule("n", "t", "COUNT"), Rule("gone", "x"), Rule("odd", "t", "X")]).first()
    assert (got.t, got.b, got.l, got.m, got.n, got.gone, got.odd) == (1.5, 1, 3.5, 0.75, 2, None, None)


def test_admission_and_placeholders(spark):
    assert values(spark, [None, "{}", "x", '{"_manual_review_path": 1}', '{"a": 1}'], filters.placeholder) == [True, True, True, True, False]
    got = values(spark, ["a.PDF", "b.exe", "c", "d.txt"], lambda x: filters.admitted(x, F.lit("[1]"), 100))
    assert [(r.error, r.mime) for r in got] == [(None, "application/json"), ("extension_not_allowed", None), ("extension_not_allowed", None), (None, "application/json")]
    assert values(spark, ["d.txt"], lambda x: filters.admitted(x, F.lit("long text"), 3))[0].error == "too_large"


def test_nested_loops(spark):
    template = "{% for a in xs %}{{ a.so_x }}{%tr for b in ys %}{{ b.ten }}{{ a.ghi_chu }}{{ c.no }}{% endfor %}{{ b.late }}{% endfor %}{% endfor %}{% for d in open %}{{ d.z }}"
    rows = spark.createDataFrame([("t", template), ("u", ""), ("v", None)], "k string, t string")
    got = sorted((r.array, r.item_alias, r.place, r.field, r.type) for r in infer.loops(rows, "k", "t").collect())
    assert got == [("xs", "a", 0, "so_x", "number"), ("xs", "a", 1, "ghi_chu", "string"), ("ys", "b", 0, "ten", "string")]


def test_transitions_in_blocks_from_states(spark):
    steps = ["processing", "extracted", "approved", "enriching", "ready_for_review", "approved", "failed", "aggregated"] * 40
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)] + [(2, 0, "pending")], "job long, i int, to string").select("job", F.timestamp_seconds("i").alias("at"), F.col("i").alias("tie"), "to")
    now, want = "failed", []
    for s in steps:
        ok = s == now or s in lifecycle.TRANSITIONS[now]
        want.append((now, s, ok))
        now = s if ok else now
    initial = spark.createDataFrame([(1, "failed")], "job long, state string")
    for block in (3, 1000):
        told = lifecycle.transitions(rows.repartition(3), initial, "minute", block)
        got = [(r.from_state, r.to_state, r.valid) for r in sorted(told.where("job = 1").collect(), key=lambda r: r.tie)]
        assert got == want
    assert {(r.job, r.state) for r in lifecycle.last_states(told).collect()} == {(1, now), (2, "pending")}


def test_synced_rows_keep_their_order_where_nothing_is_added(spark):
    rows = spark.createDataFrame([(1, 5, "17", 2, "a"), (1, 1, "16", 3, "b"), (1, 3, "x", 1, "c"), (2, 9, "16", 1, "d"), (2, 2, "3", 4, "e")], "job int, place long, stt string, ket_qua long, noi_dung string")
    out = stats.synced(rows, stats.derived(stats.named_stats(rows, ["job"], F.col("place"))), "job", "place")
    got = {j: [(r.stt, r.ket_qua) for r in sorted(out.where(f"job = {j}").collect(), key=lambda r: r.place)] for j in (1, 2)}
    assert got == {1: [("15", 5), ("16", 3), ("17", 2), ("x", 1)], 2: [("3", 4), ("16", 1)]}


def test_gate(spark):
    rows = spark.sql("select * from values (1, named_struct('so_bao_cao', ' ', 'ngay_bao_cao', null, 'don_vi_bao_cao', ''), array(1)), (2, null, array(1)), (3, named_struct('so_bao_cao', '1', 'ngay_bao_cao', null, 'don_vi_bao_cao', null), array()), (4, named_struct('so_bao_cao', '1', 'ngay_bao_cao', null, 'don_vi_bao_cao', null), array(2)) t(i, h, s)")
    got = [r.e for r in rows.select("i", validate.gate_error(F.col("h"), F.col("s")).alias("e")).orderBy("i").collect()]
    assert got == ["header metadata is empty", "header is missing", "bang_thong_ke is empty", None]


def test_watched_files_are_moved_away(spark, tmp_path):
    inbox, done = tmp_path / "inbox" / "t1", tmp_path / "processed"
    inbox.mkdir(parents=True)
    for i in range(3):
        (inbox / f"f{i}.pdf").write_bytes(b"%PDF" * (i + 1))
        os.utime(inbox / f"f{i}.pdf", (time.time() - 60, time.time() - 60))
    stream = watched(spark, str(tmp_path / "inbox"), str(done))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
    for _ in range(2):  # what one run has read is moved as the next one begins
        writer.trigger(availableNow=True).start().awaitTermination()
        (inbox / "late.pdf").write_bytes(b"%PDF")
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 3
