"""Rules as data, compiled to aggregates (survey rows A1-A11, P6, A19): one grouped pass for a whole rule table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.numbers import DECIMAL, garbage_number


@dataclass(frozen=True)
class Rule:
    """``source`` may be a column's name; ``stt`` a code of the stat table."""

    output: str
    source: str = ""
    method: str = "SUM"
    round_digits: int | None = None
    stt: int | None = None


def numeric(x: Column, kind: T.DataType) -> Column:
    """N1 by a column's type: texts as it reads them, booleans as 1 and 0, lists as the sum of their items, numbers as they are; nulls stay null."""
    if isinstance(kind, T.StringType):
        return F.when(x.isNotNull(), garbage_number(x))
    if isinstance(kind, T.BooleanType):
        return x.cast("int")
    if isinstance(kind, T.ArrayType):
        inner = F.transform(x, lambda i: F.coalesce(numeric(i, kind.elementType).cast(DECIMAL), F.lit(0).cast(DECIMAL)))
        return F.aggregate(inner, F.lit(0).cast(DECIMAL), lambda total, i: (total + i).cast(DECIMAL))
    return x


def aggregate_of(rule: Rule, kinds: dict[str, T.DataType], order: Column | None = None, code: str = "code", value: str = "value") -> Column:
    """A rule's aggregate; null, where its source isn't there or its method isn't known. Overflows give null, so no rule ends the others."""
    method, zero = (rule.method or "SUM").upper(), F.lit(0)
    kind = kinds.get(rule.source, T.NullType())
    x = F.col(rule.source) if rule.source in kinds else None
    if x is None and method != "STT_SUM":
        return F.lit(None).alias(rule.output)
    read = isinstance(kind, (T.StringType, T.ArrayType))
    n = numeric(x, kind) if x is not None else None
    if method == "SUM":
        out = F.coalesce(F.try_sum(n), zero)
    elif method == "AVG":
        out = F.try_avg(n)
    elif method == "MAX":
        out = F.coalesce(F.max(n), zero)
    elif method == "MIN":
        out = F.coalesce(F.min(n), zero)
    elif method == "COUNT":
        out, read = F.count(x), False
    elif method == "LAST":
        out, read = F.max_by(x, F.when(x.isNotNull(), order)), False
    elif method == "CONCAT":
        listed = F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x"))))), lambda p: p["x"])
        out, read = F.flatten(listed) if isinstance(kind, T.ArrayType) else listed, False
    elif method == "STT_SUM":
        out, read = F.coalesce(F.try_sum(F.when(F.col(code) == rule.stt, numeric(F.col(value), kinds[value]))), zero), isinstance(kinds[value], T.StringType)
    else:
        return F.lit(None).alias(rule.output)
    out = half_even(out.cast("double"), rule.round_digits) if rule.round_digits is not None else out
    return (out.cast("double") if read else out).alias(rule.output)


def half_even(x: Column, digits: int) -> Column:
    """The double ``x`` rounded to ``digits`` by its exact binary value, ties to even: 2.5 to 2, 2.675 to 2.67 (it is a little less than it is written).

    Only where the number as it is written ends in a 5 behind the last digit can its exact value matter; there whole numbers are compared,
    the mantissa times a power of ten with the written number times a power of two. Numbers below 0.01 or of a million and more, and more than six digits, are rounded half up as they are written.
    """
    written = x.try_cast("decimal(38,18)")
    ten = 10 ** (digits + 1)
    scaled = written * F.lit(ten).cast("decimal(20,0)")
    tie = F.pmod(scaled, F.lit(10).cast("decimal(20,0)")) == 5
    power = F.lit(52) - F.floor(F.log2(F.abs(x))).cast("int")  # the mantissa is x times 2 to this
    mantissa = (x * F.pow(F.lit(2.0), power)).cast("bigint").cast("decimal(20,0)") * F.lit(ten).cast("decimal(18,0)")
    target = scaled.cast("decimal(20,0)") * F.pow(F.lit(2.0), power).cast("decimal(38,0)").cast("decimal(18,0)")
    side = F.signum((mantissa - target).cast("double"))
    down = (scaled - 5) / F.lit(10)
    exact = F.when(side > 0, down + 1).when(side < 0, down).otherwise(F.bround(scaled / F.lit(10), 0))
    fixed = (exact.cast("decimal(30,0)").cast("double")) / F.lit(float(10**digits))
    return F.when(tie & (F.abs(x) < 1e6) & (F.abs(x) > 0.01), fixed).otherwise(F.round(x, digits)) if 0 <= digits <= 6 else F.round(x, digits)


def apply_rules(rows: DataFrame, keys: list[str], rules: list[Rule], order: Column | None = None, **names: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.groupBy(*keys).agg(*(aggregate_of(r, kinds, order, **names) for r in rules))


def pivot_codes(rows: DataFrame, keys: list[str], fields: dict[int, str], code: str, value: Column) -> DataFrame:
    """Codes to named columns, their values summed; null where a code doesn't occur. Conditional sums need one shuffle, on the keys."""
    return rows.groupBy(*keys).agg(*(F.sum(F.when(F.col(code) == c, value)).alias(name) for c, name in fields.items()))


def derive_additive(rows: DataFrame, equations: list[tuple[str, list[str]]]) -> DataFrame:
    """A missing total is the sum of its parts if all are there; a single missing part is what the others leave of the total, at least 0."""
    for total, parts in equations:
        cols = [F.col(p) for p in parts]
        missing = sum((c.isNull().cast("int") for c in cols[1:]), cols[0].isNull().cast("int"))
        known = sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0)))
        new = {p: F.when(F.col(total).isNotNull() & (missing == 1) & c.isNull(), F.greatest(F.lit(0), F.col(total) - known)).otherwise(c) for p, c in zip(parts, cols, strict=True)}
        new[total] = F.when(F.col(total).isNull() & (missing == 0), known).otherwise(F.col(total))
        rows = rows.withColumns(new)
    return rows


#: Stat codes whose total is the sum of others.
EQUATIONS = {15: (16, 17), 31: (32, 33), 35: (36, 37, 38, 39), 55: (56, 57, 58, 59, 60, 61)}


def overlay(reviewed: Column, extracted: Column, enriched: Column) -> Column:
    """Which source speaks: what was reviewed, else the extraction with what was enriched, else the extraction."""
    return F.when(reviewed.isNotNull(), "reviewed").when(extracted.isNotNull() & enriched.isNotNull(), "stage1+stage2").otherwise("stage1_only")
