"""Report narratives (survey rows T7-T12, T14-T17, T19-T24, W3) as column expressions over a text.

A null text gives null for a single value and no items for a list, unless a function says otherwise.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import WHITE, collapse, fold, let, says

#: Limits and patterns of the report form. A letter or number is looked for before the end of a word, which takes longer to tell.
HEADER_LINES, DETAIL_LINES, DETAIL_CHARS, CONTEXT_CHARS, LOCATION_CHARS = 30, 20, 3000, 600, 200
REPORT_NUMBERS = [r"Số\s*[:\.]?\s*(\d{1,4}/BC[^\n]{1,30})", r"(\d{1,4}/BC-[A-Z0-9\s]{1,20})"]
LONG_DATE = r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
SHORT_DATE = r"ngày\s+(\d{1,2}/\d{2}/\d{4})"
UNITS = [r"ĐỘI CC&CNCH[^\n]{0,50}", r"PHÒNG CẢNH SÁT[^\n]{0,50}"]
PERIOD_IN_LINE = r"Từ\s+\d[^\n]{3,60}(?:đến|–|-)[^\n]{3,40}"
PERIOD_OVER_LINES = r"Từ\s+\d.{3,80}(?:đến|–|-)\s+\d.{3,40}"
COUNTS = {
    "tong_so_vu_chay": [r"TINH HINH CHAY[:\s]+(KHONG|\d+)", r"XAY RA (\d+) VU CHAY", r"TONG SO VU CHAY[:\s]+(\d+)", r"(\d+) VU CHAY"],
    "tong_so_vu_no": [r"TINH HINH NO[:\s]+(KHONG|\d+)", r"XAY RA (\d+) VU NO", r"TONG SO VU NO[:\s]+(\d+)", r"(\d+) VU NO"],
    "tong_so_vu_cnch": [r"TINH HINH CONG TAC CUU NAN, CUU HO[:\s]+(KHONG|\d+)", r"XAY RA (\d+) VU TAI NAN", r"TONG SO VU TAI NAN[:\s]+(\d+)", r"(\d+) SU CO LIEN QUAN"],
    "quan_so_truc": [r"QUAN SO TRUC[:\s]+(\d+)", r"QUAN SO TRUC LA (\d+)"],
}
DETAIL_WORDS = ["CNCH", "TAI NAN", "SU CO", "CUU NAN"]
RESCUE_SECTION = r"3\.\s*Tình\s*hình\s*(?:công\s*tác\s*)?cứu\s*nạn"
NEXT_PART = r"\n\s*III?[\.\s]"
SECURITY = [r"(?=1)\b1\.\s*Công\s*tác\s*đảm\s*bảo\s*an\s*ninh[^:：]*[:：]\s*(.*?)(?=(?=2)\b2\.\s*Công\s*tác\s*tham\s*mưu\b|$)", r"an\s+ninh[^.;:]*[:：]?\s*([^.\n]{1,200})"]
ADVISORY = r"(?=2)\b2\.\s*Công\s*tác\s*tham\s*mưu\s*:?\s*(.*?)(?=(?=3)\b3\.\s*Công\s*tác\b|(?=I)\bIII\.|$)"
OTHER_TASKS = r"công\s+t[áa]c\s+kh[áa]c\s*[:：]\s*(.{10,600}?)(?=\d+\.\s*[A-ZĐÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬ]|\Z)"
TASKS_WORDS = ["HÁC", "HAC"]
PLATE = r"\d{2}[A-Z]{1,2}-\d{3}\.\d{2}"
VEHICLES = r"xe\s+.{5,400}(?:hư hỏng|hỏng|hết kiểm định|chờ thanh lý|đang sửa)"
DAMAGED = ["HỎNG", "HẾT ", "CHỜ THANH", "ĐANG SỬA"]
VEHICLES_ELSE = r"(?:xe|phương tiện|máy bơm|máy cắt)[^.]{3,80}(?:hư hỏng|hỏng|hết kiểm định)"
INCIDENT_MARK = r"(?=[xstcn])\b(?:xảy ra|sự cố|tai nạn|cứu nạn|nạn nhân)\b"
INCIDENT_WORDS = ["LÚC", "TẠ", "BÁO", "CÓ"]
INCIDENT_TIME = r"lúc\s+(\d{1,2})\s+giờ\s+(\d{2})\s*phút?\s+ngày\s+(\d{1,2}/\d{1,2}/\d{4})"
INCIDENT_PLACE = r"(?:xảy ra\s+)?tại\s+(?:địa\s+chỉ:?\s*)?(.+?)(?:\.\s*Đội|\s+Đội|\.\s*Thiệ|$)"
INCIDENT_STORY = r"(?:người dân|nạn nhân)[^.]{0,300}"
CHUNK_TIME = r"(?:lúc|vào lúc)\s+(\d{1,2})\s+giờ\s+(\d{2})\s+phút\s+ngày\s+(\d{1,2}/\d{1,2}/\d{4})"
CHUNK_PLACE = r"(?:xảy ra\s+)?tại\s+(?:địa chỉ:?\s*)?([\s\S]{10,200}?)(?:\.\s*Đội|\s+Đội|\.\s*Thiệ|$)"
FILL = {
    "noi_dung_tin_bao": [
        r"báo có\s+([\s\S]{5,150}?)\s+xảy ra", r"nhận tin báo[^,]*,\s*([\s\S]{5,120}?)(?:xảy ra|tại)", r"báo\s+(cháy[\s\S]{2,100}?)\s+tại\s+(?:địa chỉ)",
        r"báo\s+(cháy[\s\S]{2,80}?)\s+tại", r"có\s+(cháy[\s\S]{2,100}?)\s+xảy ra", r"tin báo từ[\s\S]{5,60}?(?:báo|có)\s+([\s\S]{3,100}?)\s+(?:xảy ra|tại)",
    ],
    "luc_luong_tham_gia": [
        r"điều động\s+([\s\S]{5,200}?)\s+tham gia", r"xuất\s+(\d+\s+xe[\s\S]{5,200}?)\s*(?:Thiệ|\.\s|$)", r"(?:Đội[\s\S]{5,50}?)\s+xuất\s+(\d+\s+xe[\s\S]{5,150}?CBCS)",
        r"điều động\s+([\s\S]{5,200}?)\s+đến", r"(Đội\s+(?:Chữa cháy|CC&CNCH|Công tác)[\s\S]{5,200}?(?:CBCS|Hồ Chí Minh))(?:\.\s|\s*Thiệ|$)",
    ],
    "thong_tin_nan_nhan": [r"nạn nhân(?:\s+(?:tên|là))?\s+([\s\S]{10,300}?)(?=\s*Đội|\s*Hiện|\.|$)"],
    "ket_qua_xu_ly": [
        r"Thi(?:ệ|ấ)t hại:\s*(Không|[\s\S]{3,100}?)\.", r"[Hh]iện tại[\s\S]{0,100}?(?:đang|đã)\s+([\s\S]{5,150}?)\.(?:\s*\d|$)", r"[Hh]iện tại[\s\S]{0,100}?(?:đang|đã)\s+([\s\S]{5,150}?)\.",
        r"tham gia[\s\S]{0,30}?(?:cứu chữa|chữa cháy|xử lý)[\s\S]{0,20}?(?:\(([^)]{3,100})\))",
    ],
    "ngay_xay_ra": [r"(?:lúc|vào lúc)[\s\S]{1,50}?ngày\s+(\d{1,2}/\d{1,2}/\d{4})", r"(\d{1,2}/\d{1,2}/\d{4})"],
}
LONG_NOTICE = r"tại\s+(?:địa chỉ|số|đường)"
RESULT_WORDS = r"(?:hại|Không|cứu|dập|an toàn|chết|thương|ổn)"
DAMAGE = r"Thi[eệ]t\s*h[aạ]i\s*[:：]\s*([^.;\n]{0,120})"
RESULT_LABELS = [r"^(?:kết\s*quả|ket\s*qua)\s*:\s*", r"^(?:thiệt\s*hại|thiet\s*hai)\s*:\s*"]


def found(x: Column, pattern: str, group: int = 1, flags: str = "iU") -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(x, f"(?{flags}){pattern}", group), F.lit(""))


def first_found(x: Column, patterns: list[str], group: int = 1, flags: str = "iU") -> Column:
    return F.coalesce(*(found(x, p, group, flags) for p in patterns))


def lines(x: Column, wide: Column | None = None) -> Column:
    """The lines that aren't blank, trimmed; ``wide``: whether the text may have other white space than blanks (``spaced``), where that is known."""
    trim = lambda s: F.btrim(s, F.lit(WHITE))
    trimmed = trim if wide is None else lambda s: F.when(wide, trim(s)).otherwise(F.trim(s))
    return F.filter(F.transform(F.split(F.replace(x, F.lit("\r"), F.lit("\n")), "\n", -1), trimmed), lambda s: s != "")


def since(x: Column, at: Column, back: int = 0) -> Column:
    """A text from ``back`` characters before place ``at`` on, where a pattern's first match can begin; empty where there is no such place."""
    return let(at, lambda at: F.when(at > 0, F.substr(x, F.greatest(at - back, F.lit(1)))).when(at == 0, ""))


def header(x: Column) -> Column:
    """The first lines of a report."""
    return header_of(lines(x))


def header_of(held: Column) -> Column:
    """``header`` of a report's lines."""
    return F.array_join(F.slice(held, 1, HEADER_LINES), "\n")


def joined_dates(x: Column) -> Column:
    """Dates without spaces around their slashes."""
    return F.regexp_replace(x, r"(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", "$1/$2/$3")


def padded_date(x: Column) -> Column:
    """d/m/yyyy as dd/mm/yyyy."""
    return F.regexp_replace(F.regexp_replace(x, r"^(\d)/", "0$1/"), r"/(\d)/", "/0$1/")


def report_number(head: Column) -> Column:
    """The number of a report without white space; empty if there is none."""
    return F.regexp_replace(F.coalesce(first_found(head, REPORT_NUMBERS), F.lit("")), r"(?U)\s+", "")


def report_date(head: Column, upper: Column | None = None) -> Column:
    """The date in words, which has no slash to join at, else the first short date on a line that doesn't tell the period; empty if there is none. The head's lines are trimmed; ``upper``: it, or the whole text, in upper case."""

    def short(joined: Column, each: Callable[[Column], Column]) -> Column:
        free = F.filter(F.split(joined, "\n"), lambda s: s.contains("/") & ~(s.contains("Từ") | s.contains("đến") | s.rlike(r"(?iU)^\(?Từ\s+\d")))
        return F.get(F.filter(F.transform(free, lambda s: F.regexp_extract(each(s), f"(?iU){SHORT_DATE}", 1)), lambda s: s != ""), F.lit(0))

    # a date goes over the end of a line only where that is beside a slash
    found = F.when(says(head, "/\n", "\n/"), let(joined_dates(head), lambda joined: short(joined, lambda s: s))).otherwise(short(head, joined_dates))
    words = let(F.regexp_extract(head, f"(?iU){LONG_DATE}", 0), lambda m: F.when(m != "", F.concat_ws("/", *(F.regexp_extract(m, f"(?iU){LONG_DATE}", i) for i in (1, 2, 3)))))
    return padded_date(F.coalesce(F.when(says(F.upper(head) if upper is None else upper, "THÁNG"), words), found, F.lit("")))


def reporting_unit(head: Column) -> Column:
    """T9; empty if there is none."""
    return F.trim(F.coalesce(first_found(head, UNITS, 0, "U"), F.lit("")))


def reporting_period(head: Column) -> Column:
    """On one line, else over the ends of lines, else the first line that begins a period; empty if there is none."""
    begun = F.get(F.filter(F.split(head, "\n"), lambda s: s.rlike(r"(?iU)Từ\s+\d")), F.lit(0))
    return F.trim(F.coalesce(found(head, PERIOD_IN_LINE, 0), found(F.translate(head, "\n", " "), PERIOD_OVER_LINES, 0), F.regexp_replace(begun, r"^\(+|\)+$", ""), F.lit("")))


def counted(folded: Column, name: str) -> Column:
    """T11, over a folded text: the first pattern whose group is a number; a word for none is passed over; else 0."""
    # a cast that fails costs more than the pattern
    number = lambda m: F.when((m != "") & (m != "KHONG"), m.try_cast("int"))
    return F.coalesce(*(let(F.regexp_extract(folded, p, 1), number) for p in COUNTS[name]), F.lit(0))


def rescue_details(x: Column) -> Column:
    """The rescue section up to the next part, else the lines with a word of the matter."""
    return rescue_of(x, lines(x))


def rescue_of(x: Column, held: Column) -> Column:
    """``rescue_details`` of a text and its lines; the section begins at its number."""
    tail = let(F.regexp_extract(since(x, F.instr(x, "3.")), f"(?isU)({RESCUE_SECTION}.*)", 1), lambda t: F.when(t != "", t))
    section = let(tail, lambda t: F.when(t.isNotNull(), let(F.regexp_extract(t, f"(?s)^(.*?){NEXT_PART}", 1), lambda s: F.when(s != "", s).otherwise(F.substring(t, 1, DETAIL_CHARS)))))
    about = F.filter(held, lambda s: let(fold(s), lambda f: says(f, *DETAIL_WORDS)))
    return F.btrim(F.coalesce(section, F.array_join(F.slice(about, 1, DETAIL_LINES), "\n")), F.lit(WHITE))


def security_text(x: Column) -> Column:
    """The section on security, else what follows the word; T15's first scrub."""
    return let(collapse(x), security_of)


def numbered(flat: Column, number: str) -> Column:
    """A text from the character before ``number`` on; the whole where that is a mark, as the end of a word hangs on what has it."""
    part = lambda at: let(since(flat, at, 1), lambda t: F.when(F.substr(t, F.lit(1), F.lit(1)).rlike(r"\p{Mn}"), flat).otherwise(t))
    return let(F.instr(flat, number), part)


def security_of(flat: Column) -> Column:
    """``security_text`` of a collapsed text; whether there is an empty block is asked only where nothing was found."""
    block, said = (f"(?iU){p}" for p in SECURITY)
    told = lambda part: let(F.regexp_extract(part, block, 1), lambda c: F.when((c != "") | part.rlike(block), c).otherwise(F.regexp_replace(F.regexp_extract(flat, said, 1), ",+$", "")))
    return scrub_prefixes(let(numbered(flat, "1."), told))


def scrub_prefixes(x: Column) -> Column:
    """Up to three prefixes go."""
    return F.trim(F.regexp_replace(collapse(x), r"(?iU)^(?:P?CCC\s*:\s*){1,3}", ""))


def scrub_prefix(x: Column) -> Column:
    """T15, as aggregation does it: one prefix goes, unless nothing would be left."""
    kept = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"(?iU)^(?:pccc|ccc)\s*:\s*", ""), F.lit("")), kept)


def result_text(*fields: Column) -> Column:
    """The first of the fields that has text besides its labels; empty if none has."""
    out = []
    for x in fields:
        x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        for pattern in RESULT_LABELS * 3:
            x = F.regexp_replace(x, f"(?iU){pattern}", "")
        out.append(F.nullif(collapse(F.regexp_replace(x, r"^[ .;,:]+|[ .;,:]+$", "")), F.lit("")))
    return F.coalesce(*out, F.lit(""))


def advisory_section(x: Column) -> Column:
    """T17; empty if there is none."""
    return advisory_of(collapse(x))


def advisory_of(flat: Column) -> Column:
    """``advisory_section`` of a collapsed text."""
    return F.trim(F.coalesce(F.regexp_extract(numbered(flat, "2."), f"(?iU){ADVISORY}", 1), F.lit("")))


def vehicle(x: Column) -> Column:
    """One vehicle as (bien_so, tinh_trang): up to its plate, and the rest with its bracket closed."""
    def split_at(x: Column, upto: Column) -> Column:
        rest = F.regexp_replace(F.substr(x, F.length(upto) + 1), r"^[\s,]+|\s+$", "")
        return let(rest, lambda r: F.struct(F.regexp_replace(F.trim(upto), r"^[Xx]e\s+", "").alias("bien_so"), F.when(F.length(F.translate(r, "(", "")) < F.length(F.translate(r, ")", "")), F.concat(r, F.lit(")"))).otherwise(r).alias("tinh_trang")))

    def told(x: Column) -> Column:
        return let(F.regexp_extract(x, rf"^.*?{PLATE}", 0), lambda upto: F.when(upto != "", split_at(x, upto)).otherwise(F.struct(x.alias("bien_so"), F.lit("").alias("tinh_trang"))))

    return let(F.regexp_replace(collapse(x), r"\b(\d{2})\s+([A-Z]{1,2})-(\d{3}\.\d{2})\b", "$1$2-$3"), told)


def damaged_vehicles(x: Column) -> Column:
    """The vehicles of the sentence on damage; one without a condition takes the next one's."""
    return vehicles_of(F.array_join(lines(x), " "))


def vehicles_of(joined: Column, upper: Column | None = None) -> Column:
    """``damaged_vehicles`` of a report's lines with blanks between; ``upper``: that in upper case, of collapsed text too. Patterns are tried where it has a word of damage."""

    def parts(flat: Column) -> Column:
        cut = F.split(F.regexp_extract(flat, f"(?iU){VEHICLES}", 0), r"(?U)[,;]\s*(?=[Xx]e\b)|(?<=[.\d])\s+(?=[Xx]e\b)|\bvà\s+(?=[Xx]e\b)")
        cut = F.filter(F.transform(cut, lambda p: F.regexp_replace(p, r"^[\s,]+|[\s,]+$", "")), lambda p: p.rlike(r"(?iU)\d{2}[A-Z]{1,2}-\d{3}|xe|phương tiện"))
        return let(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(F.regexp_extract_all(flat, F.lit(f"(?iU){VEHICLES_ELSE}"), F.lit(0))))

    told = filled_back(F.transform(let(joined, parts), vehicle))
    if upper is None:
        return told
    none = F.array().cast("array<struct<bien_so:string,tinh_trang:string>>")
    return F.when(says(upper, *DAMAGED), told).when(upper.isNotNull(), none)


def filled_back(items: Column) -> Column:
    """An empty tinh_trang becomes the next one that isn't empty."""

    def one(v: Column, i: Column, all_: Column) -> Column:
        later = F.filter(F.slice(all_, i + 1, F.size(all_)), lambda w: w["tinh_trang"] != "")
        return F.struct(v["bien_so"].alias("bien_so"), F.when(v["tinh_trang"] != "", v["tinh_trang"]).otherwise(F.coalesce(F.get(later, F.lit(0))["tinh_trang"], F.lit(""))).alias("tinh_trang"))

    return let(items, lambda all_: F.transform(all_, lambda v, i: one(v, i, all_)))


def other_tasks(x: Column) -> Column:
    """The items of the section on other tasks, longer than five characters."""
    return tasks_of(lines(x))


def tasks_of(held: Column) -> Column:
    """``other_tasks`` of a report's lines."""
    return tasks_in(F.array_join(held, " "))


def tasks_in(joined: Column) -> Column:
    """``other_tasks`` of a report's lines with blanks between, or of their end that has the section."""
    block = F.regexp_extract(joined, f"(?isU){OTHER_TASKS}", 1)
    # lines have no end of a line within, and a split by more than one character makes its pattern anew for each row
    items = F.transform(F.split(F.regexp_replace(block, r";\s*|\d+\)\s*|\d+\.\s*(?=[A-Za-zÀ-ỹĐ])", "\n"), "\n"), lambda s: F.regexp_replace(collapse(s), r"[,;.]+$", ""))
    return F.filter(items, lambda s: F.length(s) > 5)


def tasks_part(joined: Column, upper: Column) -> Column:
    """The end of a collapsed text from where its section on other tasks can begin, told by its upper case of the same length."""
    first = lambda a, b: F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b))
    place = let(F.struct(*(F.instr(upper, w).alias(n) for n, w in zip("ab", TASKS_WORDS, strict=True))), lambda p: first(p["a"], p["b"]))
    return since(joined, place, len("công tác k"))


def summary_incidents(x: Column) -> Column:
    """For each time of an incident, the time, place and story within the characters that follow.

    The look-ahead makes the contexts overlap, as one incident's may reach into the next.
    """
    contexts = F.regexp_extract_all(joined_dates(x), F.lit(rf"(?isU)(?={INCIDENT_TIME})(?=(.{{0,{CONTEXT_CHARS}}}))"), F.lit(4))
    return F.transform(
        contexts,
        lambda c: F.struct(
            F.concat(F.lpad(found(c, INCIDENT_TIME, 1), 2, "0"), F.lit(":"), found(c, INCIDENT_TIME, 2), F.lit(" ngày "), found(c, INCIDENT_TIME, 3)).alias("thoi_gian"),
            F.substring(collapse(F.regexp_extract(c, f"(?isU){INCIDENT_PLACE}", 1)), 1, LOCATION_CHARS).alias("dia_diem"),
            collapse(F.regexp_extract(c, f"(?iU){INCIDENT_STORY}", 0)).alias("mo_ta"),
        ),
    )


def filled(chunk: Column, name: str) -> Column:
    """A field of an incident by its patterns; empty if none fits."""
    return F.regexp_replace(collapse(F.coalesce(first_found(chunk, FILL[name], 1, "isU"), F.lit(""))), "[,.]+$", "")


def plausible(value: Column, name: str) -> Column:
    """T22's gates: a notice that is long or tells a place, or a result without a word for one, is emptied."""
    if name == "noi_dung_tin_bao":
        return F.when((F.length(value) > 80) | value.rlike(f"(?U){LONG_NOTICE}"), "").otherwise(value)
    if name == "ket_qua_xu_ly":
        return F.when(~value.rlike(f"(?iU){RESULT_WORDS}"), "").otherwise(value)
    return value


def chunks(x: Column) -> Column:
    """A text cut at 5.1, 5.2 and so on, else at times, else whole."""
    held = lambda xs, other: let(xs, lambda c: F.when(F.size(c) > 0, c).otherwise(other))
    numbered = lambda flat: F.filter(F.split(flat, r"(?=\b5\.\d\b)"), lambda c: c.rlike(r"^5\.\d\b"))
    timed = lambda flat: F.filter(F.split(flat, r"(?U)(?=(?:Vào lúc|vào lúc)\s+\d)"), lambda c: c.rlike("lúc|giờ"))
    return let(collapse(x), lambda flat: held(numbered(flat), held(timed(flat), F.array(flat))))


def incident(chunk: Column, i: Column) -> Column:
    """An incident's fields; null without time, place and notice, which are read first."""

    def told(p: Column) -> Column:
        day = padded_date(F.coalesce(found(chunk, CHUNK_TIME, 3), F.nullif(filled(chunk, "ngay_xay_ra"), F.lit("")), F.lit("")))
        forces, people = (filled(chunk, n).alias(n) for n in ("luc_luong_tham_gia", "thong_tin_nan_nhan"))
        rest = lambda result: F.struct(
            (i + 1).cast("int").alias("stt"), p["thoi_gian"].alias("thoi_gian"), day.alias("ngay_xay_ra"), p["dia_diem"].alias("dia_diem"), p["noi_dung_tin_bao"].alias("noi_dung_tin_bao"),
            forces, people, result.alias("ket_qua_xu_ly"), F.regexp_replace(collapse(F.regexp_extract(result, f"(?iU){DAMAGE}", 1)), "[,.]+$", "").alias("thiet_hai"),
        )
        return F.when(F.concat(p["thoi_gian"], p["dia_diem"], p["noi_dung_tin_bao"]) != "", let(filled(chunk, "ket_qua_xu_ly"), rest))

    time = let(F.regexp_extract(chunk, f"(?iU){CHUNK_TIME}", 0), lambda m: F.when(m != "", F.concat(F.lpad(found(m, CHUNK_TIME, 1), 2, "0"), F.lit(":"), found(m, CHUNK_TIME, 2), F.lit(" ngày "), padded_date(found(m, CHUNK_TIME, 3)))))
    place = collapse(F.coalesce(found(chunk, CHUNK_PLACE, 1, "isU"), F.lit("")))
    return let(F.struct(F.coalesce(time, F.lit("")).alias("thoi_gian"), place.alias("dia_diem"), filled(chunk, "noi_dung_tin_bao").alias("noi_dung_tin_bao")), told)


def incidents(x: Column) -> Column:
    """The incidents of a text by patterns alone; those without time, place and notice are left out, and are looked for where the text has a word that these need."""
    listed = lambda t: F.filter(F.transform(chunks(t), incident), lambda r: r.isNotNull())
    of = "array<struct<stt:int,thoi_gian:string,ngay_xay_ra:string,dia_diem:string,noi_dung_tin_bao:string,luc_luong_tham_gia:string,thong_tin_nan_nhan:string,ket_qua_xu_ly:string,thiet_hai:string>>"
    return let(x, lambda t: F.when(collapse(t).rlike(f"(?iU){INCIDENT_MARK}"), F.when(let(F.upper(t), lambda u: says(u, *INCIDENT_WORDS)), listed(t)).otherwise(F.array().cast(of))))
