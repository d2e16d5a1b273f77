"""Document fingerprints by SpotSigs, with DataFrame functions only.

A signature is a common word (an anchor) with the next two content words after it. Words
are runs of letters and digits in lower case; of neighbouring anchors the last counts. A
text's fingerprint is the set of its signatures, each as the first 32 bits of its MD5, in
rising order; a text without a signature shows its words instead, one without words itself.

Likeness is the Jaccard similarity of two fingerprints. ``similar_documents`` joins a whole
table: fingerprints are partitioned by set length, so that a set meets only partitions whose
lengths allow the threshold, and within these only sets that share a signature among their
rarest; the pairs left are compared in full, shortest bound first.

Cases: null and empty texts have the empty fingerprint, which is like another empty one (1)
and unlike any other (0); texts are read whole; equal texts have equal fingerprints; of one
document alone the next is itself; rows that share an id follow each other by their text's
hash; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, released, table

#: Common words of the languages at hand: English, German, French, Spanish.
ANCHORS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine einer für ich im ist mit nicht sich und von zu "
    "au aux avec ce dans du elle est et il je la le les ne par pas pour que qui sur un une "
    "como con de del el en es las lo los más no para por se su una y"
).split()


def _anchor_pattern() -> str:
    """The anchors as one pattern, by first letter."""
    letters: dict[str, list[str]] = {}
    for word in sorted(set(ANCHORS)):
        letters.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{x}(?:{'|'.join(sorted(rest, reverse=True))})" for x, rest in letters.items())


def _digest(x: Column) -> Column:
    """The first 32 bits of the MD5, as an integer of the same order."""
    return (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") - (1 << 31)).cast("int")


def with_signatures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the fingerprint of a text column as array<int>, sorted and distinct. In steps, so that none is computed twice."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " ")))
    # each part: an anchor, then the content words up to the next; of neighbouring anchors only the last has any
    marked = F.split(F.regexp_replace(F.col("_plain"), f" ({_anchor_pattern()})(?= |$)", "\u0001$1"), "\u0001")
    parts = F.filter(F.transform(marked, lambda p: F.split(p, " ")), lambda p, i: (i > 0) & (F.size(p) > 1))
    shifted = F.concat(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), F.array(F.array(F.lit(""), F.lit(""))))
    chains = F.zip_with("_parts", shifted, lambda p, n: F.when(F.size(p) > 2, _digest(F.concat_ws(" ", p[0], p[1], p[2]))).when(n[1] != "", _digest(F.concat_ws(" ", p[0], p[1], n[1]))))
    words = F.transform(F.filter(F.split("_plain", " "), lambda w: w != ""), _digest)
    itself = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.array(_digest(F.col(text))))
    return (
        docs.withColumn("_plain", plain)
        .withColumn("_parts", parts)
        .withColumn("_sigs", F.filter(chains, lambda h: h.isNotNull()))
        .withColumn("_words", F.when(F.size("_sigs") == 0, words))
        .withColumn(out, F.array_sort(F.array_distinct(F.when(F.size("_sigs") > 0, F.col("_sigs")).when(F.size("_words") > 0, F.col("_words")).otherwise(itself))))
        .drop("_plain", "_parts", "_sigs", "_words")
    )


def written(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + (1 << 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; sets whose intersection is surely empty are not intersected."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0) | (F.array_max(a) < F.array_min(b)) | (F.array_max(b) < F.array_min(a)), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _splits(docs: DataFrame) -> list[int]:
    """Ids that cut the table into parts of about equal size; so many as the session's shuffle partitions tell, whatever the table's size."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    (cuts,) = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)])).first()
    return sorted(set(cuts or []))


def _part(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the cuts lie below the id: first of every sixteenth or so, then of those between."""
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = F.lit(cuts[step - 1 :: step]) if len(cuts) >= step and cuts else None, F.lit(cuts) if cuts else None
    if not cuts:
        return F.lit(0)
    below = F.size(F.filter(coarse.cast("array<long>"), lambda c: c < doc_id)) * step
    return below + F.size(F.filter(F.slice(fine.cast("array<long>"), below + 1, step), lambda c: c < doc_id))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, sigs) with the text and signatures of the next one, by falling id; after the last comes the first.

    The table is cut into parts by ranges of the id, with a window in each; the first row of the part that follows is added
    to each part's end. So the order is global and no window is.
    """
    cuts = _splits(docs)
    parted = docs.withColumn("part", _part(F.col("doc_id"), cuts))
    heads = [r for r in parted.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()]
    out = parted.withColumn("own", F.lit(True))
    if heads:
        before = {heads[i].head: heads[(i + 1) % len(heads)].part for i in range(len(heads))}
        spark = docs.sparkSession
        follow = F.broadcast(spark.createDataFrame([(h, p) for h, p in before.items()], "doc_id long, part int"))
        out = out.unionByName(docs.join(follow, "doc_id").withColumn("own", F.lit(False)))
    order = Window.partitionBy("part").orderBy(F.desc("own"), F.desc("doc_id"), F.xxhash64("text"))
    return out.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs")).where("own").drop("own", "part")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_signatures(docs, "text", "sigs")
    pairs = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    shown = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    shown = with_signatures(shown, "edited", "edited_sigs")
    return shown.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("sigs")).alias("fingerprint"), written(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of representatives of equal fingerprints, and the members: (doc_id, a).

    Returns the pairs; ``docs`` has doc_id and text. Equal fingerprints are one set, shown by its smallest id.
    """
    t = float(threshold)
    sets = with_signatures(docs.select(F.col("doc_id").cast("long"), "text"), "text", "sigs").where("size(sigs) > 0")
    ones = materialise(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sigs", F.size("sigs").alias("n")))
    values = ones.select("doc_id", "n", F.explode("sigs").alias("sig"))
    df = values.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = values.join(df, "sig").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    # partition of a length: lengths that a set of length n can meet lie in its own or the next one
    length_part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / t))).cast("int")
    rare = ranked.select("doc_id", "n", length_part.alias("p"), F.explode(F.expr(f"slice(by_df, 1, n - cast(ceil({t} * n) as int) + 1)")).alias("x")).select("doc_id", "n", "p", F.col("x.sig").alias("sig"), F.col("x.df").alias("df")).where("df > 1")
    mine = rare.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "p", "sig")
    theirs = rare.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("p"), "sig")
    met = mine.join(theirs, ["p", "sig"]).where(f"(na < nb or na = nb and a < b) and na >= {t} * nb").select("a", "b").distinct()
    full = lambda s: ones.select(F.col("doc_id").alias(s), F.col("sigs").alias(f"sigs_{s}"))
    compared = met.join(full("a"), "a").join(full("b"), "b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b")))
    out = materialise(compared.where(F.col("likeness") >= t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"))
    released(ones)
    return out


_SQL_SETS = r"""
{0}w AS (SELECT doc_id, text, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM {1}),
{0}p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {0}w WHERE w <> ['']),
{0}q AS (SELECT *, word IN ({anchors}) AS anchor, lag(word) OVER o AS before FROM {0}p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
{0}c AS (SELECT doc_id, before, word, lead(word) OVER o AS after FROM {0}q WHERE NOT anchor WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
{0}s AS (SELECT doc_id, before || ' ' || word || ' ' || after AS sig FROM {0}c WHERE before IN ({anchors}) AND after IS NOT NULL),
{0}v AS (SELECT * FROM {0}s UNION ALL SELECT doc_id, word FROM {0}p WHERE doc_id NOT IN (SELECT doc_id FROM {0}s)
    UNION ALL SELECT doc_id, text FROM {0}w WHERE w = [''] AND text <> ''),
{0} AS (SELECT doc_id, list_sort(list_distinct(list(substr(md5(sig), 1, 8)))) AS sigs FROM {0}v GROUP BY doc_id)"""


def _sql_sets(out: str, source: str) -> str:
    quoted = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    return _SQL_SETS.replace("{0}", out).replace("{1}", source).replace("{anchors}", quoted).strip()


#: The same by windows over words; ids are taken to be distinct.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
    FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, next_id, length(text) AS n_chars, substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS text FROM n),
{_sql_sets("f", "d")},
{_sql_sets("g", "e")},
r AS (SELECT e.doc_id, n_chars, e.text, coalesce(f.sigs, []) AS a, coalesce(g.sigs, []) AS b, coalesce(h.sigs, []) AS c
    FROM e LEFT JOIN f ON f.doc_id = e.doc_id LEFT JOIN g ON g.doc_id = e.doc_id LEFT JOIN f h ON h.doc_id = e.next_id)
SELECT doc_id, n_chars, sha256(text) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
    CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
    CASE WHEN len(a) = 0 AND len(c) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next FROM r
"""
