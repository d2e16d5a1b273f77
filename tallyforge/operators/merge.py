"""Ordered dedup (survey rows A14-A16, A22, A23, A28, A26, R5): the first of each signature by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import stripped


def signature(columns: list[Column], lower: bool = False) -> Column:
    parts = [stripped(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    text = F.concat_ws("\u0001", *parts)
    return F.lower(text) if lower else text


def first_of(rows: DataFrame, sig: Column, order: list[Column], scope: list[str] | None = None, drop_empty: bool = True) -> DataFrame:
    """The first row of each signature (in each scope). An aggregate with map-side partial results, so a signature that very many rows share is no single task's work."""
    keyed = rows.withColumn("_sig", sig)
    if drop_empty:
        keyed = keyed.where(F.translate("_sig", "\u0001", "") != "")
    best = keyed.groupBy(*(scope or []), "_sig").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def canonical(columns: list[str]) -> Column:
    """All fields as sorted key:value pairs."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)))
