"""Predicates and admissions (survey rows F1-F3, F9-F12, F14, F15, F19, O9, K1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(rows: DataFrame, tenant: object, **equal: object) -> DataFrame:
    """one tenant's rows, and of these those equal in each column that a value is given for. All conditions reach the scan."""
    out = rows.where(F.col("tenant") == tenant)
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def on_day(at: Column, day: str) -> Column:
    """from the day's midnight to before the next one's."""
    start = F.expr(f"timestamp_ntz'{day} 00:00:00'")
    return (at >= start) & (at < start + F.expr("interval 1 day"))


def has_all(tags: Column, wanted: list[str]) -> Column:
    """the array holds each of ``wanted``."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


#: The keys of a payload that stands for a job that failed.
PLACEHOLDER_KEYS = ["_manual_review_path", "_manual_review_metadata"]


def placeholder(payload: Column) -> Column:
    """null, no object, or an object with no other keys than those of a placeholder."""
    keys = F.map_keys(F.from_json(payload, "map<string,string>"))
    return F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, PLACEHOLDER_KEYS)))) == 0, F.lit(True))


#: States in which a job may be deleted, and the seconds after which a waiting one may be.
DELETABLE = ("ready_for_review", "approved", "rejected", "failed", "aggregated")
PENDING_SECONDS = 300


def deletable(state: Column, updated: Column, now: Column) -> Column:
    """F14."""
    return state.isin(*DELETABLE) | ((state == "pending") & (updated < now - F.expr(f"interval {PENDING_SECONDS} seconds")))


#: File types by their first bytes (tried in this order) and by extension, and the extensions that are let in.
MAGIC = {"%PDF": "application/pdf", "PK\u0003\u0004": "application/vnd.openxmlformats-officedocument", "{\n": "application/json", "{\r\n": "application/json", "[": "application/json"}
EXTENSIONS = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".txt": "text/plain", ".md": "text/markdown", ".json": "application/json", ".csv": "text/csv"}


def admitted(name: Column, content: Column, limit: int) -> Column:
    """(error, mime) of a file: too large, an extension that isn't let in, or the type by its first bytes or else its name."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    mime = F.lit(None).cast("string")
    for ending, kind in EXTENSIONS.items():
        mime = F.when(extension == ending, kind).otherwise(mime)
    for first, kind in reversed(MAGIC.items()):
        mime = F.when(content.startswith(first), kind).otherwise(mime)
    mime = F.when(F.hex(F.encode(F.substring(content, 1, 4), "ISO-8859-1")) == "D0CF11E0", "application/msword").otherwise(mime)
    error = F.when(F.octet_length(content) > limit, "too_large").when(~extension.isin(*EXTENSIONS), "extension_not_allowed")
    return F.struct(error.alias("error"), F.when(error.isNull(), F.coalesce(mime, F.lit("application/octet-stream"))).alias("mime"))


#: States shown together by the review list's filter.
STATUS_GROUPS = {"ready_for_review": ("ready_for_review",), "approved": ("approved",), "failed": ("failed", "rejected")}


def searched(rows: DataFrame, text: str = "", status_group: str | None = None, template: object = None) -> DataFrame:
    """rows (name, status, template) whose name holds ``text`` in any case, of a group of states and a template."""
    out = rows.where(F.col("status").isin(*STATUS_GROUPS[status_group])) if status_group else rows
    out = out.where(F.col("template") == template) if template is not None else out
    return out.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else out


def capped(rows: DataFrame, batch: list[str], order: list[str], cap: int) -> DataFrame:
    """Rows with ``error``, which tells that a batch holds more than ``cap`` rows before this one; none is dropped."""
    place = F.row_number().over(Window.partitionBy(*batch).orderBy(*order))
    return rows.withColumn("error", F.when(place > cap, F.lit(f"backpressure: queue full ({cap} max)")))


#: Levels of roles.
ROLE_LEVELS = {"owner": 3, "admin": 2, "viewer": 1}


def role_allows(role: Column, needed: Column) -> Column:
    """K1: a role that isn't known has level 0."""
    level = lambda r: F.coalesce(*(F.when(r == name, n) for name, n in ROLE_LEVELS.items()), F.lit(0))
    return level(role) >= level(needed)
