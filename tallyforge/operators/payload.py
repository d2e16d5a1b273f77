"""Reshaping of report payloads (survey rows P1-P5, P8, P10-P19, P22-P24).

All are projections of one row but ``summary``, ``sources_used`` and ``refilled``, which group or join by the report's key. A null
payload, list or record is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import collapse

#: Lists that tell a wrapped payload, nested parts that a summary keeps, keys that no export shows, heads of a preview.
WRAPPED = ["bang_thong_ke", "danh_sach_cnch", "danh_sach_phuong_tien_hu_hong", "danh_sach_cong_tac_khac"]
PASSED = ["header", "phan_I_va_II_chi_tiet_nghiep_vu", "narrative"]
INTERNAL = ["records", "_source_records", "_flat_records", "_metadata", "metrics"]
TABLE_HEAD, LIST_HEAD = 50, 20
PLATE = r"(\d{2})\s*([A-Za-z]{1,2})\s*-\s*(\d{3}\.\d{2})"
DATE = r"\d{1,2}/\d{1,2}/\d{4}"


def shown(name: str) -> bool:
    return name not in INTERNAL and not name.startswith("_")


def promoted(df: DataFrame, header: str) -> DataFrame:
    """Each field of the struct ``header`` as a column; a column that is there wins, unless it is null."""
    out = df
    for f in df.schema[header].dataType.names:
        inner = F.col(f"`{header}`.`{f}`")
        out = out.withColumn(f, F.coalesce(F.col(f"`{f}`"), inner) if f in df.columns else inner)
    return out


def date_parts(x: Column) -> list[Column]:
    """Day, month and year of a text that is a date and nothing else; empty otherwise."""
    return [F.coalesce(F.regexp_extract(x, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i), F.lit("")).alias(n) for i, n in ((1, "ngay_xuat"), (2, "thang_xuat"), (3, "nam_xuat"))]


def period(x: Column) -> list[Column]:
    """The first two dates of a text."""
    found = F.regexp_extract_all(x, F.lit(DATE), F.lit(0))
    return [F.get(found, F.lit(i)).alias(n) for i, n in ((0, "tu_ngay"), (1, "den_ngay"))]


def first_part(*parts: Column) -> Column:
    """The first of the alternatives that is there."""
    return F.coalesce(*parts)


def total(given: Column, *parts: Column) -> Column:
    """P5: the total as given, or else the sum of its parts (none counts as 0); null if a part is no number."""
    numbers = [F.coalesce(F.nullif(F.trim(p.cast("string")), F.lit("")), F.lit("0")).try_cast("bigint") for p in parts]
    added = numbers[0]
    for n in numbers[1:]:
        added = added + n
    return F.coalesce(F.nullif(given.try_cast("bigint"), F.lit(0)), added)


def normalised(df: DataFrame, sep: str = "_") -> DataFrame:
    """Fields of structs, however deep, as columns named by their path; lists stay whole; of equal names the first stays."""
    found: dict[str, Column] = {}

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at)
            else:
                found.setdefault(sep.join(at), F.col(".".join(f"`{p}`" for p in at)))

    walk(df.schema, [])
    return df.select(*(c.alias(n) for n, c in found.items()))


def unwrapped(payload: Column, keys: list[str] | None = WRAPPED) -> Column:
    """P10: ``data`` of a JSON payload where it has one of ``keys``. P11 (``keys`` None): where it has any. Else the payload; {} if that is no object."""
    inner = F.get_json_object(payload, "$.data")
    names = F.json_object_keys(inner)
    fits = F.size(names) > 0 if keys is None else F.arrays_overlap(names, F.array(*map(F.lit, keys)))
    return F.when(F.coalesce(fits, F.lit(False)), inner).when(F.json_object_keys(payload).isNotNull(), payload).otherwise(F.lit("{}"))


def _default(kind: str, of: T.DataType | None) -> Column:
    """The value of a missing field of a declared type, as the type its column has."""
    if isinstance(of, T.StructType):
        return F.from_json(F.lit("{}"), of)
    plain = {"array": F.array().cast("array<string>"), "object": F.create_map().cast("map<string,string>"), "number": F.lit(0), "boolean": F.lit(False)}.get(kind, F.lit(""))
    return plain.cast(of) if of is not None else plain


def shaped(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Every declared field (name to type) is there and not null; a single value of an array field becomes a list of one."""
    out = df
    for name, kind in fields.items():
        if name not in df.columns:
            out = out.withColumn(name, _default(kind, None))
            continue
        col, of = F.col(f"`{name}`"), df.schema[name].dataType
        if kind == "array" and not isinstance(of, T.ArrayType):
            out = out.withColumn(name, F.when(col.isNull(), F.array().cast(T.ArrayType(of))).otherwise(F.array(col)))
        else:
            out = out.withColumn(name, F.coalesce(col, _default(kind, of)))
    return out


def summary(results: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The results of rules, and of each key's last row the columns they lack; nested parts only if in ``PASSED``."""
    other = [f.name for f in rows.schema if f.name not in (*results.columns, key) and (f.name in PASSED or not isinstance(f.dataType, (T.StructType, T.MapType)))]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*other), F.struct(order)).alias("_last"))
    return results.join(last, key, "left").select(*results.columns, *(F.col(f"_last.`{c}`").alias(c) for c in other))


def context(df: DataFrame, records: str = "records", index: str = "record_index", extra: dict[str, Column] | None = None) -> DataFrame:
    """The record at ``index`` (the first, if there is none), its fields as columns before the report's own; ``extra`` before both."""
    at = F.coalesce(F.col(index), F.lit(0))
    at = F.when((at >= 0) & (at < F.coalesce(F.size(records), F.lit(0))), at).otherwise(0)
    picked = df.withColumn("record", F.get(records, at)).withColumn("record_index", at.cast("int"))
    columns = {"records": F.col(records), "record": F.col("record"), "record_index": F.col("record_index")}
    inner = df.schema[records].dataType.elementType.names
    for f in inner:
        own = F.when(F.col("record").isNull(), F.col(f"`{f}`")) if f in df.columns and shown(f) else None
        columns.setdefault(f, F.col(f"record.`{f}`") if own is None else F.coalesce(own, F.col(f"record.`{f}`")))
    for c in df.columns:
        if shown(c):
            columns.setdefault(c, F.col(f"`{c}`"))
    columns |= extra or {}
    return picked.select(*(c.alias(n) for n, c in columns.items()))


def _without_noun(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s*[Xx]e\s+", "")


def vehicle(text: Column, condition: Column | None = None) -> Column:
    """(bien_so, tinh_trang) of a text, or of a plate with its condition: what follows the plate is the condition where none is given."""
    clean = collapse(F.coalesce(text, F.lit("")))
    bare = _without_noun(F.regexp_replace(clean, PLATE, "$1$2-$3"))
    plate = F.regexp_extract(bare, rf"^.*?{PLATE}", 0)
    after = F.regexp_replace(F.substring(bare, F.length(plate) + 1, F.length(bare)), r"^\s*,*\s*|\s+$", "")
    split = F.struct(F.when(plate == "", bare).otherwise(plate).alias("bien_so"), F.when(plate == "", "").otherwise(after).alias("tinh_trang"))
    if condition is None:
        return split
    given = F.trim(F.coalesce(condition, F.lit("")))
    return F.when(given != "", F.struct(_without_noun(F.trim(F.coalesce(text, F.lit("")))).alias("bien_so"), given.alias("tinh_trang"))).otherwise(split)


def scrubbed(x: Column, of: T.DataType) -> Column:
    """NaN and infinities as null, however deep in structs and lists."""
    if isinstance(of, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if isinstance(of, T.ArrayType):
        return F.transform(x, lambda v: scrubbed(v, of.elementType))
    if isinstance(of, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(scrubbed(x[f.name], f.dataType).alias(f.name) for f in of)))
    return x


def display_name(file: Column, job: Column) -> Column:
    """P17."""
    short = F.substring(job.cast("string"), 1, 8)
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(file, F.lit(" ("), short, F.lit(")"))).otherwise(F.concat(F.lit("Job "), short))


def sources_used(jobs: DataFrame, key: str, job: str, created: str, file: str) -> DataFrame:
    """Per report the count of its jobs, their first and last time, and the list of them in order of time."""
    listed = F.array_sort(F.collect_list(F.struct(created, F.col(job).cast("string").alias("id"), F.coalesce(file, F.lit("")).alias("file_name"))))
    rows = jobs.groupBy(key).agg(F.count("*").alias("row_count"), F.min(created).alias("start"), F.max(created).alias("end"), listed.alias("_jobs"))
    return rows.select(key, "row_count", "start", "end", F.transform("_jobs", lambda j: F.struct(j["id"].alias("id"), j["file_name"].alias("file_name"))).alias("jobs"))


def rendered(x: Column, of: T.ArrayType) -> Column:
    """A list in the place of a value: the sum of ``k_t_qu`` (six decimals) where some item has a number there, plain items with commas between, else JSON."""
    item = of.elementType
    if not isinstance(item, (T.StructType, T.MapType, T.ArrayType)):
        return F.array_join(F.transform(x, lambda v: v.cast("string")), ", ", "")
    text = F.when(F.size(x) > 0, F.to_json(x)).otherwise("")
    if not isinstance(item, T.StructType) or "k_t_qu" not in item.names:
        return text
    number = F.filter(F.transform(x, lambda v: F.replace(F.trim(v["k_t_qu"].cast("string")), F.lit(","), F.lit(".")).try_cast("decimal(30,6)")), lambda v: v.isNotNull())
    added = F.aggregate(number, F.lit(0).cast("decimal(38,6)"), lambda a, b: (a + b).cast("decimal(38,6)"))
    return F.when(F.size(number) > 0, F.regexp_replace(added.cast("string"), r"\.?0+$", "")).otherwise(text)


def refilled(enriched: DataFrame, first: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """``enriched`` with its blank ``fields`` taken from the row of ``first`` with the same keys (the last, if several)."""
    kept = first.groupBy(*keys).agg(*(F.max_by(f, order).alias(f"_{f}") for f in fields))
    fill = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f)) for f in fields}
    return enriched.join(kept, keys, "left").select(*(fill.get(c, F.col(c)).alias(c) for c in enriched.columns))


def preview(df: DataFrame) -> DataFrame:
    """What an export shows before it is made: plain values, and of each list its size and its head (the feature); no internal keys, no nested parts."""
    out = []
    for f in df.schema:
        if not shown(f.name) or isinstance(f.dataType, (T.StructType, T.MapType)):
            continue
        if isinstance(f.dataType, T.ArrayType):
            head = TABLE_HEAD if isinstance(f.dataType.elementType, (T.StructType, T.MapType)) else LIST_HEAD
            out += [F.coalesce(F.size(f.name), F.lit(0)).alias(f"{f.name}_n"), F.slice(f.name, 1, head).alias(f.name)]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
