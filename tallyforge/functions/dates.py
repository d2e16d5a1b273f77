"""Date functions over text and dates (survey rows D1-D9, D11)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.numbers import stripped
from tallyforge.functions.text import let


def report_date(x: Column) -> Column:
    """The first of four formats that fits."""
    s = stripped(x)
    shaped = ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))
    return F.coalesce(*(F.when(s.rlike(shape), F.try_to_date(s, fmt)) for shape, fmt in shaped))


def date_code(x: Column, year_min: int = 2020, year_max: int = 2030) -> Column:
    """An error code, or null if the text is a valid dd/mm/yyyy; 29 February passes in any year."""
    s = stripped(F.coalesce(x, F.lit("")))
    day, month, year = (F.substring(s, a, n).try_cast("int") for a, n in ((1, 2), (4, 2), (7, 4)))
    longest = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (
        F.when(~s.rlike(r"^\d{2}/\d{2}/\d{4}$"), "invalid_date_format").when(~month.between(1, 12), "date_month_out_of_range").when(~day.between(1, 31), "date_day_out_of_range")
        .when(~year.between(year_min, year_max), "date_year_out_of_range").when(day > longest, "date_day_exceeds_month")
    )


def clean_date(x: Column) -> Column:
    """No spaces around slashes, two digits for day and month."""
    s = F.regexp_replace(x, r"(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})", "$1/$2/$3")
    part = lambda i: F.regexp_extract(stripped(s), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i)
    return F.when(stripped(s).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))).otherwise(stripped(s))


def dates_in(x: Column) -> Column:
    """The valid dates of a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), F.lit(0)), lambda d: F.try_to_date(d, "d/M/yyyy")), lambda d: d.isNotNull())


def week_start(d: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_sub(d, F.weekday(d))


def first_report_date(*candidates: Column) -> Column:
    """D3: the first candidate that is a date by one of the four formats."""
    return F.coalesce(*map(report_date, candidates))


#: Names of months by their first letters, of weekdays, and words that dates are written with.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
FILLERS = ["at", "on", "and", "ad", "t", "of", "st", "nd", "rd", "th"]
#: A time of day with what may follow it: seconds, a half of the day, a zone.
TIME_OF_DAY = r"(?:(?<=\d)t|\b)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,6})?)?\s*(?:(am|pm|a|p)\b)?\s*(?:z\b|utc\b|gmt\b)?\s*(?:[+-]\d{2}:?\d{2}\b)?"


def free_date(x: Column) -> Column:
    """D1's general reading of a date, day first: null if ``x`` isn't one with a day, a month and a year.

    The text is cut into numbers and words. A time of day goes; months and weekdays may be named; 8 or 6 digits are three numbers, 14 or 12 with a time behind.
    Of the three parts a named month and a number of three digits or more are what they are; a year that comes first has the day before the month
    (where that can be); otherwise the day comes first where the second can be a month. A year of two digits is the one within 50 years.
    """
    low = F.lower(x)
    hour, minute, second, half = (F.regexp_extract(low, TIME_OF_DAY, k) for k in range(1, 5))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    fits = (number(minute) < 60) & (number(second) < 60) & F.when(half != "", number(hour).between(1, 12)).otherwise(number(hour) < 24)
    rest = F.regexp_replace(F.regexp_replace(low, TIME_OF_DAY, " "), r"\b(\d{8})t(\d{4}|\d{6})\b", "$1")
    named = {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {m: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
    ignored = [*WEEKDAYS, *(d[:3] for d in WEEKDAYS), *FILLERS, *".,;-/'"]

    def parts_of(t: Column) -> Column:
        digits, size = t.rlike(r"^\d+$"), F.length(t)
        part = lambda *cuts: F.array(*(F.substring(t, a, n) for a, n in cuts))
        month = F.coalesce(*(F.when(t == name, F.lit(f"m{k}")) for name, k in named.items()))
        return (
            F.when(digits & size.isin(8, 12, 14), part((1, 4), (5, 2), (7, 2))).when(digits & (size == 6), part((1, 2), (3, 2), (5, 2))).when(digits & (size <= 4), F.array(t))
            .when(month.isNotNull(), F.array(month)).when(t.isin(ignored), F.array().cast("array<string>")).otherwise(F.array(F.lit("?")))
        )

    def resolved(p: Column) -> Column:
        is_month = [p[k].startswith("m") for k in range(3)]
        value = [F.regexp_replace(p[k], "^m", "").try_cast("int") for k in range(3)]
        is_year = [~is_month[k] & (F.length(p[k]) > 2) for k in range(3)]
        order = lambda y, m, d: F.struct(value[y].alias("y"), value[m].alias("m"), value[d].alias("d"), (F.length(p[y]) > 2).alias("whole"))
        ways = (
            F.when(is_month[0], F.when(is_year[1] | (~is_year[2] & (value[1] > 31)), order(1, 0, 2)).otherwise(order(2, 0, 1)))
            .when(is_month[1], F.when(is_year[0] | (~is_year[2] & (value[0] > 31)), order(0, 1, 2)).otherwise(order(2, 1, 0)))
            .when(is_month[2], F.when(is_year[1] | (~is_year[0] & (value[1] > 31)), order(1, 2, 0)).otherwise(order(0, 2, 1)))
            .when(is_year[0] | (value[0] > 31), F.when(value[2] <= 12, order(0, 2, 1)).otherwise(order(0, 1, 2)))
            .when((value[0] > 12) | (value[1] <= 12), order(2, 1, 0)).otherwise(order(2, 0, 1))
        )
        return F.when((F.size(p) == 3) & ~F.exists(p, lambda t: t == "?") & (F.size(F.filter(p, lambda t: t.startswith("m"))) <= 1), ways)

    def day(w: Column) -> Column:
        now = F.year(F.current_date())
        near = w["y"] + F.floor(now / 100).cast("int") * 100
        year = F.when(w["whole"], w["y"]).when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        made = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(w["m"].cast("string"), 2, "0"), F.lpad(w["d"].cast("string"), 2, "0"))
        return F.when(w["y"].isNotNull() & w["m"].between(1, 12) & w["d"].between(1, 31) & year.between(1, 9999), F.try_to_date(made, "yyyy-MM-dd"))

    tokens = F.regexp_extract_all(rest, F.lit(r"(\d+|[a-z]+|[^a-z0-9\s])"), F.lit(1))
    return F.when(fits, let(F.flatten(F.transform(tokens, parts_of)), lambda p: let(resolved(p), day)))


#: A time of day, dates by day, by year, and in words.
CLOCK = r"^(\d{1,2})\s*[hH:]\s*(\d{2})$"
BY_DAY = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
BY_YEAR = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$"
IN_WORDS = r"^(?i)(?:ngày|ngay)?\s*(\d{1,2})\s+(?:tháng|thang)\s*(\d{1,2})\s+(?:năm|nam)\s*(\d{4})"


def coerced_date(x: Column) -> Column:
    """(value, note). A time as HH:MM; a date by day, month and year, by year, month and day, in words, or in a free form (``free_date``) as dd/MM/yyyy; else the text as it is.

    The note is null where nothing changed, else ``time``, ``date``, ``words``, ``free`` or ``not_recognised``. Blank texts give null.
    """
    return let(stripped(x), _told_date)


def _told_date(s: Column) -> Column:
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    hour, minute = part(CLOCK, 1).try_cast("int"), part(CLOCK, 2).try_cast("int")
    time = F.when(hour.between(0, 23) & minute.between(0, 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(CLOCK, 2)))

    def day(pattern: str, d: int, m: int, y: int) -> Column:
        made = F.concat_ws("-", part(pattern, y), F.lpad(part(pattern, m), 2, "0"), F.lpad(part(pattern, d), 2, "0"))
        return F.date_format(F.when(F.regexp_like(s, F.lit(pattern)), F.try_to_date(made, "yyyy-MM-dd")), "dd/MM/yyyy")

    told = lambda value, note: F.struct(value.cast("string").alias("value"), note.cast("string").alias("note"))
    found = lambda value, note: let(value, lambda v: F.when(v.isNotNull(), told(v, note(v))))
    as_ = lambda name: lambda v: F.lit(name)
    numbers = F.coalesce(day(BY_DAY, 1, 2, 3), day(BY_YEAR, 3, 2, 1))
    forms = (found(time, as_("time")), found(numbers, lambda v: F.when(v != s, "date")), found(day(IN_WORDS, 1, 2, 3), as_("words")), found(F.date_format(free_date(s), "dd/MM/yyyy"), as_("free")))
    return F.when(s != "", F.coalesce(*forms, told(s, F.lit("not_recognised")))).otherwise(told(F.lit(None), F.lit(None)))


#: The forms of an incident's time.
TIME_FORMS = [
    r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}$", r"^\d{2}:\d{2}\s+\d{2}/\d{2}/\d{4}$", r"^\d{2}:\d{2}\s+ngày\s+\d{2}/\d{2}/\d{4}$", r"^\d{2}:\d{2}$",
    r"^\d{1,2}\s*giờ\s*\d{1,2}\s*phút\s*ngày\s*\d{2}/\d{2}/\d{4}$",
]


def incident_time(x: Column) -> Column:
    """(value, valid). 7h30 becomes 07:30, dates get two digits for day and month; valid if the result has one of six forms or is empty."""
    s = stripped(F.coalesce(x, F.lit("")))
    clock = r"^(\d{1,2})\s*[hH]\s*(\d{2})$"
    s = F.when(s.rlike(clock), F.concat(F.lpad(F.regexp_extract(s, clock, 1), 2, "0"), F.lit(":"), F.regexp_extract(s, clock, 2))).otherwise(s)
    s = F.regexp_replace(s, r"(\d{1,2})/(\d{1,2})/(\d{4})", "0$1/0$2/$3")
    s = F.regexp_replace(s, r"0(\d{2})/", "$1/")
    valid = s == ""
    for form in TIME_FORMS:
        valid = valid | s.rlike(f"(?iU){form}")
    return F.struct(s.alias("value"), valid.alias("valid"))


def date_in_words(x: Column) -> Column:
    """d/m/yyyy or yyyy-m-d in words, as written there; other texts as they are."""
    s = stripped(F.coalesce(x, F.lit("")))
    dmy, ymd = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    say = lambda p, d, m, y: F.concat(F.lit("ngày "), F.regexp_extract(s, p, d), F.lit(" tháng "), F.regexp_extract(s, p, m), F.lit(" năm "), F.regexp_extract(s, p, y))
    return F.when(s.rlike(dmy), say(dmy, 1, 2, 3)).when(s.rlike(ymd), say(ymd, 3, 2, 1)).otherwise(s)


def short_date(x: Column) -> Column:
    """Yyyy-m-d as d/m/yyyy; other texts as they are."""
    s = stripped(F.coalesce(x, F.lit("")))
    ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    part = lambda i: F.regexp_extract(s, ymd, i)
    return F.when(s.rlike(ymd), F.concat_ws("/", part(3), part(2), part(1))).otherwise(s)
