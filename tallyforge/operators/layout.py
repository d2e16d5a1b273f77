"""Lines and texts of pages from placed words (survey rows P20, T6).

Words have (doc, page, ord, width, text, x0, x1, top); a page's words meet in one group, a document's pages in another. Empty and
null words are left out, a null place counts as 0, and equal places keep ``ord``; a page or document without words has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words closer than this are one word; the boundaries where a space is put back.
JOINED = -1.0
BOUNDARIES = [
    (r"([A-Za-zÀ-ỹ])([0-9])", "$1 $2"),
    (r"([0-9])([A-Za-zÀ-ỹ])", "$1 $2"),
    (r"([a-zàáạảãăắằẵặẳâấầẫậẩđèéẹẻẽêếềễệểìíịỉĩòóọỏõôốồỗộổơớờỡợởùúụủũưứừữựửỳýỵỷỹ])([A-Z])", "$1 $2"),
]


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _joined(words: Column) -> Column:
    """A space before each word but the first, unless it overlaps the word before it."""
    gap = lambda w, i: w["x0"] - F.get(words, i - 1)["x1"]
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & (gap(w, i) > JOINED), F.concat(F.lit(" "), w["text"])).otherwise(w["text"])), "")


def lines(words: DataFrame) -> DataFrame:
    """(doc, page, side, row, line): each half of a page has its own lines; ``side`` is 0 left of the middle."""
    place = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    words = words.select("doc", "page", "ord", _stripped(F.col("text")).alias("text"), place("x0").alias("x0"), place("x1").alias("x1"), F.bround(place("top"), 1).alias("row"), (place("width") / 2).alias("middle"))
    halves = words.where("text <> ''").withColumn("side", F.when(F.col("x0") < F.col("middle"), 0).otherwise(1))
    rows = halves.groupBy("doc", "page", "side", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "ord", "x1", "text"))).alias("words"))
    return rows.select("doc", "page", "side", "row", _joined(F.col("words")).alias("line"))


def texts(words: DataFrame) -> DataFrame:
    """(doc, text): lines from the top down, left before right; then pages; spaces put back between letters and digits."""
    said = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x[by[-1]]), "\n")
    pages = lines(words).groupBy("doc", "page").agg(said("row", "side", "line").alias("text"))
    text = F.col("text")
    for pattern, to in BOUNDARIES:
        text = F.regexp_replace(text, pattern, to)
    return pages.groupBy("doc").agg(said("page", "text").alias("text")).select("doc", text.alias("text"))
