"""Exports of reports (survey rows S13-S15, S17, S18): folders of CSV and JSON that Spark writes in parallel."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tallyforge.operators.payload import normalised, shown

log = logging.getLogger(__name__)


def _said(f: T.StructField, sized: bool) -> Column:
    col = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.ArrayType) and sized:
        return F.concat(F.lit("["), F.size(col), F.lit(" phần tử]"))
    return F.to_json(col) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else col.cast("string")


def _pairs(df: DataFrame, key: str, names: tuple[str, str], leave: list[str], sized: bool) -> DataFrame:
    """Each column but ``key`` and those to leave as a row (key, name, value)."""
    pairs = [F.struct(F.lit(f.name).alias(names[0]), _said(f, sized).alias(names[1])) for f in df.schema if f.name != key and f.name not in leave]
    kind = f"array<struct<`{names[0]}`:string,`{names[1]}`:string>>"
    return df.select(key, F.inline(F.array(*pairs).cast(kind)))


def summary_sheet(df: DataFrame, key: str) -> DataFrame:
    """(key, field, value) of what is not internal; a list is its size."""
    return _pairs(df, key, ("Trường", "Giá trị"), [c for c in df.columns if not shown(c)], True)


def key_values(df: DataFrame, key: str) -> DataFrame:
    """(key, Field, Value) of all but ``_metadata``."""
    return _pairs(df, key, ("Field", "Value"), ["_metadata"], False)


def detail_sheet(jobs: DataFrame, keep: list[str], reviewed: str, extracted: str) -> DataFrame:
    """A row a job: the columns ``keep``, and the fields of the struct that was reviewed, or else extracted; lists and parts as JSON."""
    data = jobs.select(*keep, F.coalesce(reviewed, extracted).alias("_data"))
    fields = data.schema["_data"].dataType
    return data.select(*keep, *((F.to_json(F.col(f"_data.`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"_data.`{f.name}`").cast("string")).alias(f.name) for f in fields))


def export_key(tenant: Column, day: Column, report: Column, kind: str) -> Column:
    """Where a day's export of a tenant lies."""
    return F.concat(F.lit("exports/"), tenant.cast("string"), F.lit("/daily/"), F.date_format(day, "yyyyMMdd"), F.lit("/"), report.cast("string"), F.lit(f".{kind}"))


def sheets(df: DataFrame, key: str, detail: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sheets of a workbook by name; those for which there is no column are left out, as is ``detail`` (see ``detail_sheet``) without jobs."""
    out = {"summary": summary_sheet(df, key)}
    if detail is not None:
        out["detail"] = detail
    if "_source_records" in df.columns:
        records = df.select(key, F.explode("_source_records").alias("r")).select(key, "r.*")
        flat = normalised(records)
        out["source_records"] = flat.select(*(_said(f, False).alias(f.name) for f in flat.schema))
    if "_metadata" in df.columns:
        out["metadata"] = df.select(key, F.to_json("_metadata").alias("metadata"))
    return out


def write_workbook(df: DataFrame, key: str, path: str, detail: DataFrame | None = None) -> None:
    for name, sheet in sheets(df, key, detail).items():
        sheet.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_csv(df: DataFrame, key: str, path: str) -> None:
    key_values(df, key).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """The reports as they are; with ``by`` (tenant, day) a folder for each."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def auto_export(stream: DataFrame, key: str, path: str) -> DataStreamWriter:
    """Each batch as workbook and JSON. An export that fails is logged and holds up neither the other nor the stream."""

    def export(batch: DataFrame, number: int) -> None:
        for name, write in (("workbook", lambda to: write_workbook(batch, key, to)), ("json", lambda to: write_json(batch, to))):
            try:
                write(f"{path}/{name}/{number}")
            except Exception:
                log.exception("batch %d: no %s", number, name)

    return stream.writeStream.foreachBatch(export)
