"""A report's parts from where they can begin, and patterns tried only where a text has their words, are those of patterns over the whole text."""

from pyspark.sql import functions as F

from tallyforge.functions import narrative as N
from tallyforge.functions.text import collapse, fold, folded, let, says, spaced
from tallyforge.operators import cells

TEXTS = [
    None, "", " \n", "a  b", "a b\r\nc\rd\t", " x　\n\x85y", "ó ́ n", "ΐ ß ﬁ", "3. Tình hình cứu nạn: 1\nII. b", "x́2. Công tác tham mưu: 1 2. Công tác tham mưu: 2 3. Công tác",
    "́2. Công tác tham mưu: 4", "1. Công tác đảm bảo an ninh: x 2. Công tác tham mưu: 3", "Khác. CÔNG TAC KHÁC: trực gác 1; lau chùi xe", "ß công tác khác: trực gác 22; b", "công tác  Khác: trực gác 3",
    "Xe chữa cháy 61A-002.85 HỎNG", "không có xe", "xe thang CHỜ THANH lý", "ngày 5 /\n06 / 1995", "ngày 5\n/ 06/1995", "Từ 1 ngày 5/06/1995\nngày 6 / 06 / 1996", "ngày 5 tháng 6 năm 1995 / 1",
]


def test_parts_equal_patterns_over_whole_texts(spark):
    x = F.col("x")
    plain_lines = F.filter(F.transform(F.split(x, r"\r\n|\r|\n", -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string").select("x", plain_lines.alias("l"), collapse(x).alias("f")).select("*", F.array_join("l", " ").alias("j"), F.upper("f").alias("u"), F.array_join(F.slice("l", 1, 30), "\n").alias("h"))
    held, flat, joined, upper, head = map(F.col, "lfjuh")
    group = lambda x, p: F.regexp_extract(x, p, 1)
    same = {
        "lines": (N.lines(x), held), "known": (N.lines(x, spaced(x)), held), "flat": (F.when(spaced(x), collapse(joined)).otherwise(joined), flat), "folded": (folded(upper), fold(x)),
        "advisory": (N.advisory_of(flat), F.trim(F.coalesce(group(flat, r"(?iU)\b2\.\s*Công\s*tác\s*tham\s*mưu\s*:?\s*(.*?)(?=\b3\.\s*Công\s*tác\b|\bIII\.|$)"), F.lit("")))),
        "tasks": (F.when((joined == flat) & (F.length(flat) == F.length(upper)), group(N.tasks_part(joined, upper), f"(?isU){N.OTHER_TASKS}")).otherwise(group(joined, f"(?isU){N.OTHER_TASKS}")), group(joined, f"(?isU){N.OTHER_TASKS}")),
        "vehicles": (N.vehicles_of(joined, upper), N.vehicles_of(joined)),
        "day": (N.report_date(head, upper), N.padded_date(F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(N.joined_dates(head), f"(?iU){N.LONG_DATE}", 0), f"(?iU){N.LONG_DATE}", "$1/$2/$3"), F.lit("")), F.get(F.filter(F.transform(F.filter(F.split(N.joined_dates(head), "\n"), lambda s: ~(s.contains("Từ") | s.contains("đến"))), lambda s: group(s, f"(?iU){N.SHORT_DATE}")), lambda s: s != ""), F.lit(0)), F.lit("")))),
    }
    rows = df.select("x", *(a.eqNullSafe(b).alias(n) for n, (a, b) in same.items())).collect()
    assert len(rows) == len(TEXTS) and [(r.x, n) for r in rows for n in same if not r[n]] == []


def test_letters_of_sought_words_have_one_upper_case(spark):
    words = [*N.DAMAGED, *N.TASKS_WORDS, *N.INCIDENT_WORDS, "THÁNG"]
    letters = sorted({c for w in words for c in w.lower() if c != " "})
    df = spark.createDataFrame([(chr(i),) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "c string")
    wrong = [F.count(F.when(F.col("c").rlike(f"(?iU)^{x}") & (F.upper("c") != x.upper()), 1)).alias(f"n{i}") for i, x in enumerate(letters)]
    assert set(df.select(*wrong).first()) == {0}


def test_values_are_bound_without_an_array(spark):
    # an item got out of an array made for it cost the types of all that it held, for each row
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int").select(let(F.col("x"), lambda x: let(F.concat(x, x), lambda y: F.coalesce(F.concat(y, x), F.lit("none")))).alias("z"))
    assert "array(x" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.z for r in df.collect()] == ["aaa", "none"]


def test_table_lines_left_out_and_uneven_cells(spark):
    tables = [[["TT", "Nội dung", "Kết quả"], ["1", "Danh  mục", "3"], [" 2", "Mục\n2 ", "4"], ["3", "kết quả", "ghi chú"]], [["STT", "Chỉ tiêu", "Số liệu"], ["4", "danh mục", "5"], ["5", "mụcA", "6"]], None, [None, ["6", "x", "7"]], [["x", "7 a", "8"], ["8", "DANH", "MUC"]]]
    got = spark.createDataFrame([(tables,)], "t array<array<array<string>>>").select(cells.table_rows(F.col("t")).alias("r")).first().r
    assert [(r.stt, r.noi_dung, r.ket_qua) for r in got] == [("2", "Mục 2", 4), ("5", "mục A", 6), ("6", "x", 7)]


def test_words_are_told(spark):
    row = spark.createDataFrame([("CỨU NẠN",)], "x string").select(says(F.col("x"), "A", "NẠN").alias("a"), says(F.col("x"), "NAN").alias("b")).first()
    assert (row.a, row.b) == (True, False)
