"""Numeric and boolean coercions (survey rows N1-N6, B1). They disagree on purpose; none is built on another."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import let

DECIMAL = "decimal(38,10)"


def stripped(x: Column) -> Column:
    """Without white space at either end (all of it, not blanks alone)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def garbage_number(x: Column) -> Column:
    """A comma is a decimal point; what doesn't parse is 0."""
    return F.coalesce(F.translate(stripped(x), ",", ".").try_cast(DECIMAL), F.lit(0).cast(DECIMAL))


def int_or_null(x: Column) -> Column:
    """Truncated toward zero; a comma is a decimal point; null if it doesn't parse."""
    return F.translate(stripped(x), ",", ".").try_cast(DECIMAL).try_cast("bigint")


def int_or_zero(x: Column) -> Column:
    """Points and commas are left out, so "12.5" is 125."""
    return F.coalesce(F.regexp_replace(stripped(x), "[.,]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


#: Number words.
NUMBER_WORDS = {
    "không": 0, "một": 1, "hai": 2, "ba": 3, "bốn": 4, "bon": 4, "năm": 5, "nam": 5, "sáu": 6, "sau": 6, "bảy": 7, "bay": 7, "tám": 8, "tam": 8, "chín": 9, "chin": 9, "mười": 10, "muoi": 10,
    "mười một": 11, "mười hai": 12, "mười ba": 13, "mười bốn": 14, "mười lăm": 15, "mười sáu": 16, "mười bảy": 17, "mười tám": 18, "mười chín": 19,
    "hai mươi": 20, "ba mươi": 30, "bốn mươi": 40, "năm mươi": 50, "sáu mươi": 60, "bảy mươi": 70, "tám mươi": 80, "chín mươi": 90, "trăm": 100, "nghìn": 1000, "ngàn": 1000, "triệu": 1000000, "tỷ": 1000000000,
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
#: Fixed value: units that may follow a number.
UNITS = r"\s*(VNĐ|vnđ|đồng|dong|vụ|vu|người|nguoi|cái|cai|chiếc|chiec|km|m|kg|g|lít|lit|ha|USD|\$|€|%)\s*$"


def measured_number(x: Column) -> Column:
    """A unit is cut; separators are told apart by their places; number words count; null if nothing fits."""
    return let(stripped(F.regexp_replace(stripped(x), UNITS, "")), _measured)


def _measured(s: Column) -> Column:
    both = F.when(F.instr(F.reverse(s), ".") < F.instr(F.reverse(s), ","), F.regexp_replace(s, ",", "")).otherwise(F.translate(F.regexp_replace(s, r"\.", ""), ",", "."))
    commas = F.when(s.rlike(r"^[^,]*(,[^,]{3})+$"), F.regexp_replace(s, ",", "")).otherwise(F.translate(s, ",", "."))
    plain = F.when(s.contains(",") & s.contains("."), both).when(s.contains(","), commas).when(s.rlike(r"\..*\."), F.regexp_replace(s, r"\.", "")).otherwise(s)
    words = F.create_map(*(F.lit(v) for kv in NUMBER_WORDS.items() for v in kv))
    return F.coalesce(plain.try_cast("double"), F.try_element_at(words, F.lower(s)).cast("double"))


def measured_note(x: Column) -> Column:
    """What N4 tells of a value: null where it was a plain number or blank, else how it was read, or that it wasn't."""
    return let(stripped(x), lambda raw: let(measured_number(raw), lambda n: noted(n, raw)))


def noted(n: Column, raw: Column) -> Column:
    """``measured_note`` of a stripped text whose number is known."""
    return F.when(F.coalesce(raw, F.lit("")) == "", None).when(n.isNull(), "not_a_number").when(raw.try_cast("double") == n, None).when(F.lower(F.regexp_replace(raw, UNITS, "")).isin(list(NUMBER_WORDS)), "words").otherwise("rewritten")


def digits_or(x: Column, default: int = 0) -> Column:
    """Digits alone count."""
    return F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def cell_number(x: Column) -> Column:
    """A whole number, else the last of two or more numbers in the cell, else 0."""
    all_ = F.regexp_extract_all(x, F.lit(r"-?\d+"), F.lit(0))
    return F.when(stripped(x).rlike(r"^-?\d+$"), stripped(x).try_cast("bigint")).when(F.size(all_) >= 2, F.element_at(all_, -1).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


#: Words for yes and no.
TRUE_WORDS = ["đúng", "dung", "có", "co", "true", "yes", "1", "rồi", "roi", "x", "✓", "✔"]
FALSE_WORDS = ["sai", "không", "khong", "false", "no", "0", "chưa", "chua", ""]


def boolean(x: Column) -> Column:
    """B1; null for any other word."""
    s = F.lower(stripped(x))
    return F.when(s.isin(TRUE_WORDS), True).when(s.isin(FALSE_WORDS), False)
