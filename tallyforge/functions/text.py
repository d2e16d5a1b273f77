"""Text functions (survey rows T1-T5, T13, T18, T25, T29, T33)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from functools import cache
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _accents() -> tuple[str, str]:
    """Upper-case letters that decompose into a base and marks, and their bases; generated, so Đ is not among them."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        upper = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", upper) if unicodedata.category(c) != "Mn")
        if base != upper and len(base) == 1:
            pairs.append((upper, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(x: Column) -> Column:
    """Upper case, no accents, single spaces."""
    old, new = _accents()
    return collapse(F.regexp_replace(F.translate(F.upper(x), old, new), r"\p{Mn}", ""))


def collapse(x: Column) -> Column:
    """T3."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


#: All white space, as (?U)\s has it, and bytes of which some are in each but blanks and ends of lines (E2 80 begins dashes and quotes, too).
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_BYTES = [b"\t", b"\v", b"\f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def spaced(x: Column) -> Column:
    """Whether a text may have white space besides single blanks and ends of lines; bytes are sought, as a pattern takes far longer."""
    return functools.reduce(or_, (F.contains(x, F.lit(w).cast("string")) for w in [b"  ", *WHITE_BYTES]))


def unaccented(upper: Column) -> Column:
    """Upper-case text without accents on its letters."""
    return F.translate(upper, *_accents())


def folded(upper: Column) -> Column:
    """``fold`` of a text that is collapsed and in upper case: only marks that go leave blanks to collapse."""
    return let(unaccented(upper), lambda x: F.when(x.rlike(r"^\P{Mn}*+\z"), x).otherwise(collapse(F.regexp_replace(x, r"\p{Mn}", ""))))


def says(upper: Column, *words: str) -> Column:
    """Whether a text has one of ``words``. Of an upper-case text it tells far sooner than a pattern that ignores case whether that can fit, by words of the pattern without I and K, whose case other letters share."""
    return functools.reduce(or_, (F.contains(upper, F.lit(w)) for w in words))


def restore_spaces(x: Column) -> Column:
    """Spaces between words that ran together. No place fits two of the patterns and a space makes none fit elsewhere, so one pass finds all."""
    return F.regexp_replace(x, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=[0-9(])|(?<=[0-9])(?=\p{L})|(?<=[.,;:)])(?=[^\s0-9).,;:])", " ")


def clean_label(x: Column) -> Column:
    """T4: spaces restored and single, no punctuation at the ends."""
    return F.regexp_replace(collapse(restore_spaces(x)), r"^[ .:-]+|[ .:-]+$", "")


def counter(x: Column, noun: str) -> Column:
    """A count beside a noun: between a leading verb and it, or after it; else before it, not as part of a code; 0 if there is none."""
    led = rf"(?iU)(?:tham\s*mưu|ban\s*hành|gửi)\s+(\d+)\s+{noun}|{noun}[:\s]+(\d+)"
    number = lambda pattern, i: F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).try_cast("int")
    return F.coalesce(number(led, 1), number(led, 2), number(rf"(?iU)(?<!/)(\d+)\s+{noun}", 1), F.lit(0))


#: Kinds of documents, letters with marks, and what a wrong decoding leaves in their place.
DOCUMENT = r"(?:Công\s*văn|CV|Tờ\s*trình|Báo\s*cáo|Kế\s*hoạch)"
MARKED = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴĐ"
GARBLED = ["6ng", "6y", "6n", "6i", "6o", "6c", "6t", "5n", "5t", "5i", "5o", "4n", "4i", "4t", "1f", "1i", "1n", "9 ", "Q ", "OOi", "OO "]


def document_items(x: Column) -> Column:
    """(so_ky_hieu, noi_dung) of each document that a text lists: split codes joined, a date before the content left out, items whose code has no digit too."""
    kind_code = rf"{DOCUMENT}\s*(?:s(?:ố|o)\s*[:.]?\s*)?([0-9A-Za-zĐđ][0-9A-Za-zĐđ/-]*(?:\s+\d{{1,4}})?)\s*"
    whole = rf"(?iUs){kind_code}.*?(?=(?:;\s*|,\s*|\.\s*-\s*|\.\s*|\bvà\s+){DOCUMENT}\b|\d+\.\s*Công\s+tác|$)"
    found = F.regexp_extract_all(collapse(F.regexp_replace(x, "\n", " ")), F.lit(whole), F.lit(0))

    def item(m: Column) -> Column:
        code = F.regexp_replace(F.regexp_replace(F.regexp_extract(m, rf"(?iUs)^{kind_code}", 1), r"^[ ,:;.-]+|[ ,:;.-]+$", ""), r"\s+(?=\d{1,4}$)", "")
        said = F.regexp_replace(F.regexp_extract(m, rf"(?iUs)^{kind_code}(.*)$", 2), r"^[ :;,.-]+|\s+$", "")
        spill = F.when(code.rlike("/[A-Za-z]+$"), F.regexp_extract(said, r"(?iU)^(\d{1,4})\s+(?=ngày\b)", 1)).otherwise("")
        said = F.when(spill != "", F.regexp_replace(said, r"^\d{1,4}\s+", "")).otherwise(said)
        said = F.regexp_replace(F.regexp_replace(said, r"(?iU)^ngày\s+\d{1,2}/\d{1,2}/\d{4}\s*", ""), r"^[ :;,.-]+|\s+$", "")
        return F.struct(F.concat(code, spill).alias("so_ky_hieu"), said.alias("noi_dung"))

    return F.filter(F.transform(found, item), lambda d: d["so_ky_hieu"].rlike(r"\d"))


def garbled(x: Column, sample: int = 2000) -> Column:
    """(garbled, confidence): whether a text of some length has hardly a letter with a mark but several signs of a wrong decoding, seen over its first ``sample`` characters, which is what the score is defined on."""
    s = F.substring(x, 1, sample)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    share = (F.length(s) - F.length(F.translate(s, MARKED, ""))) / F.greatest(letters, F.lit(1))
    hits = F.size(F.filter(F.array(*map(F.lit, GARBLED)), lambda g: s.contains(g)))
    read = (F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) >= 50) & (letters >= 20)
    sure, likely = read & (share < 0.01) & (hits >= 3), read & (share < 0.03) & (hits >= 5)
    value = F.when(sure, F.least(F.lit(1.0), F.lit(0.5) + hits * 0.1)).when(likely, 0.8).otherwise(0.0)
    return F.struct(F.coalesce(sure | likely, F.lit(False)).alias("garbled"), F.round(F.coalesce(value, F.lit(0.0)), 3).alias("confidence"))


def document_codes(x: Column) -> Column:
    """Codes such as 12/CV-KV30, with a split suffix joined."""
    joined = F.regexp_replace(x, r"(\d+/\p{Lu}+) (?=\d)", "$1")
    return F.regexp_extract_all(joined, F.lit(r"\d{1,4}/[\p{Lu}\d]+(?:-[\p{Lu}\d]+)*"), F.lit(0))


def document_type(code: Column) -> Column:
    """By the letters of the code."""
    return F.when(code.rlike(r"/BC"), "report").when(code.rlike(r"/KH"), "plan").otherwise("dispatch")


def garbled_share(x: Column) -> Column:
    """Share of characters that a wrong decoding leaves behind, in thousandths."""
    return F.when(F.length(x) > 0, F.floor(1000 * (F.length(x) - F.length(F.translate(x, "ÃÂÐ�¤¦", ""))) / F.length(x))).otherwise(0).cast("bigint")


def grouped_number(n: Column) -> Column:
    """1500000 as 1.500.000, 1500000.5 as 1.500.000,50; no number is 0. Hundredths are cut from the number as written, half up."""
    value = F.coalesce(n.cast("double"), F.lit(0.0))
    whole = F.translate(F.format_number(F.floor(F.abs(value)), 0), ",", ".")
    cents = F.round((F.abs(value) - F.floor(F.abs(value))).cast("decimal(12,6)"), 2)
    part = F.when(value == F.floor(value), "").otherwise(F.concat(F.lit(","), F.substring(F.format_string("%.2f", cents.cast("double")), -2, 2)))
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, part)


def humanised(name: Column) -> Column:
    """Blanks for underscores, and only the first letter upper."""
    s = F.trim(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def snake_case(name: Column) -> Column:
    """Letters, digits and single underscores, lower; a name that begins with a digit is a field, one of nothing is unnamed."""
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_|_$", ""))
    return F.when(s == "", "unnamed_field").when(s.rlike("^[0-9]"), F.concat(F.lit("field_"), s)).otherwise(s)


def clean_period(x: Column) -> Column:
    """Dates without blanks around their slashes, single blanks."""
    return collapse(F.regexp_replace(x, r"(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", "$1/$2/$3"))


def clean_detail(x: Column) -> Column:
    """Blanks restored and single."""
    return collapse(restore_spaces(x))


#: What begins the parts of a report, and a table's header (its folded words).
PARTS = {"nghiep_vu": r"(?imU)^I\.\s+TÌNH HÌNH.*", "quan_so": r"(?imU)^III\.\s+TỔNG\s+QUÂN\s+SỐ.*", "signature": r"(?imU)^(?:Nơi\s+nhận\s*:|Noi\s+nhan\s*:)"}
TABLE_WORDS, TABLE_CODE = ("DANH MUC", "CHI TIEU"), "STT"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` names it, and in whatever lambda.

    An aggregate over no items, of which only the last step is left: an item got out of an array of one works out the type of all that was nested in it, for each row and at each level.
    """
    return F.aggregate(F.array(), value, lambda value, _: value, then)


def table_start(x: Column) -> Column:
    """Where (from 1) the first line begins that has the code's word and, in it or the three lines after it, a word of a table's header; null if none does."""

    def found(held: Column, folded: Column) -> Column:
        near = lambda i: F.array_join(F.slice(folded, i + 1, 4), " ")
        heads = lambda i: near(i).contains(TABLE_WORDS[0]) | near(i).contains(TABLE_WORDS[1])
        place = F.array_position(F.transform(folded, lambda line, i: line.contains(TABLE_CODE) & heads(i)), True).cast("int")
        before = lambda at: F.aggregate(F.slice(held, 1, F.greatest(at - 1, F.lit(0))), F.lit(0), lambda n, line: n + F.length(line))
        return let(place, lambda at: F.when(at > 0, before(at) + 1))

    return let(F.split(x, "(?<=\n)"), lambda held: let(F.transform(held, fold), lambda folded: found(held, folded)))


def split_parts(x: Column) -> Column:
    """The parts of a report in their order, as array of (block_id, content): each from its mark to the next part's, the table to the signature. Blank parts are left out."""
    first = lambda text, name: F.nullif(F.regexp_instr(text, F.lit(PARTS[name])), F.lit(0))
    after = lambda mark, start: F.when(mark > start, mark)

    def cut(text: Column, marks: Column) -> Column:
        one, three, table, end = marks["one"], marks["three"], marks["table"], F.length(text) + 1
        least = lambda *at: F.least(*at, end)
        sign = first(F.substring(text, table, F.length(text)), "signature") + table - 1
        spans = [("header", F.lit(1), least(one, three, table)), ("nghiep_vu", one, least(after(three, one), after(table, one))), ("quan_so", three, least(after(table, three))), ("bang_thong_ke", table, F.coalesce(sign, end))]
        blocks = F.array(*(F.when(a.isNotNull() & (b > a), F.struct(F.lit(name).alias("block_id"), F.substring(text, a, b - a).alias("content"))) for name, a, b in spans))
        return F.filter(blocks, lambda b: b.isNotNull() & (F.regexp_replace(b["content"], r"(?U)\s", "") != ""))

    return let(x, lambda text: let(F.struct(first(text, "nghiep_vu").alias("one"), first(text, "quan_so").alias("three"), table_start(text).alias("table")), lambda marks: cut(text, marks)))
