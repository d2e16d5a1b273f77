"""Rules that a template's fields and aggregation rules keep (survey row V9), checked over all templates at once: codes as rows, names repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a name may look like, the types of fields, the methods of rules.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
FIELD_TYPES = ("string", "number", "boolean", "array", "object")
METHODS = ("SUM", "AVG", "MAX", "MIN", "COUNT", "CONCAT", "LAST")


def repaired(name: Column) -> Column:
    """A name that is an identifier, trimmed; else with underscores for what else it has, if that makes one; else null."""
    trimmed = F.trim(name)
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, r"[^A-Za-z0-9_]", "_"), r"^_+|_+$", ""), r"_+", "_")
    return F.when(trimmed.rlike(IDENTIFIER), trimmed).when(made.rlike(IDENTIFIER), made)


def unique_names(fields: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``fields`` with ``unique``: ``name``, or with a number behind it where one before by ``order`` has it, so that no two of ``keys`` are alike.

    A number that makes a name which is there already is left out. A name's holders but the first get its free numbers from 2 on in their order: the k-th gets
    k + 1 and one more for each taken number that fewer than k free ones go before.
    """
    numbered = r"(?s)^(.*)_([1-9][0-9]{0,17})\z"
    ranked = fields.withColumn("_k", F.when(F.col(name).isNotNull(), F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) - 1).otherwise(0).cast("long"))
    # names as they are written win over numbered ones
    taken = fields.where(F.col(name).rlike(numbered)).select(*keys, F.regexp_extract(name, numbered, 1).alias(name), F.regexp_extract(name, numbered, 2).try_cast("long").alias("_t")).where("_t > 1").distinct()
    free = F.col("_t") - 1 - F.row_number().over(Window.partitionBy(*keys, name).orderBy("_t"))
    both = ranked.withColumn("_taken", F.lit(0)).unionByName(taken.select(*keys, name, free.alias("_k"), F.lit(1).alias("_taken")), allowMissingColumns=True)
    skipped = F.sum("_taken").over(Window.partitionBy(*keys, name).orderBy("_k", "_taken").rowsBetween(Window.unboundedPreceding, 0))
    number = F.concat(F.col(name), F.lit("_"), (F.col("_k") + 1 + skipped).cast("string"))
    return both.withColumn("unique", F.when(F.col("_k") > 0, number).otherwise(F.col(name))).where("_taken = 0").select(*fields.columns, "unique")


def field_codes(fields: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys``, ``order`` and a code for each rule that a field (name, type) breaks: empty_name, invalid_name, renamed, type_not_allowed, duplicate_name (each that has another's name)."""
    made = fields.withColumn("_fixed", repaired(F.col("name")))
    twice = made.where("_fixed is not null").groupBy(*keys, "_fixed").agg(F.count("*").alias("_many")).where("_many > 1")
    made = made.join(twice, [*keys, "_fixed"], "left")
    empty = F.trim(F.coalesce("name", F.lit(""))) == ""
    codes = F.array(
        F.when(empty, "empty_name"),
        F.when(~empty & F.col("_fixed").isNull(), "invalid_name"),
        F.when(F.col("_fixed") != F.trim("name"), "renamed"),
        F.when(~F.coalesce(F.col("type").isin(*FIELD_TYPES), F.lit(False)), "type_not_allowed"),
        F.when(F.col("_many").isNotNull(), "duplicate_name"),
    )
    return made.select(*keys, order, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def rule_codes(rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and a code for each that a rule (output_field, source_field, method) breaks: missing_output, missing_source, method_not_allowed."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    codes = F.array(F.when(blank("output_field"), "missing_output"), F.when(blank("source_field"), "missing_source"), F.when(~F.coalesce(F.upper("method").isin(*METHODS), F.lit(False)), "method_not_allowed"))
    return rules.select(*keys, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
