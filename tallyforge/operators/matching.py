"""Templates matched to files by an index of what must occur (survey rows J8, J9, O7, I7).

A pattern that matches a name, and a field that a page contains, have runs of characters in
common with it. Of each pattern's or field's runs of three characters (of a shorter one all of it) the one that the fewest
others have is its key; names and pages are spread to their runs of one to three characters (where the index has few keys, to these alone), a hash
join brings candidates together, and only these are verified. So no name meets every pattern and no page every field,
however many templates there are. Patterns that need no character at all (``\\d+``) are packed into blocks that names meet by
the number of the block.

Joins ask for sorting: a plan of so many joins would otherwise hold as many small tables in the driver at once.

Patterns are searched in names as Python's ``re`` does, whatever the case. One that doesn't compile
is left out and listed by ``bad_patterns``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

parser = re._parser  # the parsed form of a pattern, which the standard library has no other name for

#: Characters of a key at most; candidates of a page that are verified together; patterns of a block; keys of an index that tasks may know beforehand; rows of a batch of runs.
GRAM, TOGETHER, BLOCK, FEW, OUT = 3, 1000, 256, 10_000, 20_000
#: Share of a template's fields that a first page must name, and characters it must have more than.
COVERAGE, LEAST = 0.7, 20
#: Other characters that match an ASCII letter if case doesn't count.
_FOLD = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def folded(text: str) -> str:
    return text.translate(_FOLD).lower()


def required(pattern: str) -> list[str]:
    """Runs of ASCII characters that each match of ``pattern`` contains, in lower case."""
    runs = [""]

    def walk(parts) -> None:
        for op, value in parts:
            name = str(op)
            if name == "LITERAL" and value < 128:
                runs[-1] += chr(value).lower()
            elif name == "AT":
                continue
            else:
                runs.append("")
                if name == "SUBPATTERN":
                    walk(value[-1])
                elif name == "ATOMIC_GROUP":
                    walk(value)
                elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                    walk(value[2])
                runs.append("")

    walk(parser.parse(pattern, re.IGNORECASE))
    return [r for r in runs if r]


@functools.lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None


def keys_of(run: str) -> list[str]:
    return [run[k : k + GRAM] for k in range(max(1, len(run) - GRAM + 1))]


def _runs(s: str, wanted: frozenset[str] | None) -> list[str]:
    """The distinct runs of one to three characters of ``s``, or those of them that are wanted."""
    if wanted is not None and len(wanted) <= GRAM * len(s):
        return [g for g in wanted if g in s]
    runs = {s[k : k + n] for n in range(1, GRAM + 1) for k in range(len(s) - n + 1)}
    return list(runs if wanted is None else runs & wanted)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the keys a pattern could have, and why it doesn't compile, to (tenant, template, place, pattern)."""
    for batch in batches:
        grams, errors = [], []
        for pattern in batch.column("pattern").to_pylist():
            try:
                re.compile(pattern, re.IGNORECASE)
                longest = max((len(r) for r in required(pattern)), default=0)
                grams.append(sorted({g for r in required(pattern) if len(r) >= min(GRAM, longest) for g in keys_of(r)}))
                errors.append(None)
            except (re.error, OverflowError, RecursionError) as e:
                grams.append([])
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grams, pa.list_(pa.string())), pa.array(errors, pa.string())], names=[*batch.schema.names, "grams", "error"])


def _parsed(templates: DataFrame) -> DataFrame:
    rows = templates.where("coalesce(pattern, '') <> ''").select("tenant", "template", "place", "pattern")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_patterns, f"{fields}, grams array<string>, error string")


def bad_patterns(templates: DataFrame) -> DataFrame:
    """tenant, template, pattern, error: patterns that don't compile."""
    return _parsed(templates).where("error is not null").select("tenant", "template", "pattern", "error")


def few_grams(indexed: DataFrame) -> frozenset[str] | None:
    """The keys of an index if they are at most ``FEW``, which tasks may know beforehand; else none."""
    rows = indexed.select("gram").distinct().limit(FEW + 1).collect()
    return frozenset(r.gram for r in rows) if len(rows) <= FEW else None


def spread(rows: DataFrame, text: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """``rows`` without the column ``text``, once for each distinct run of one to three characters of it, in ``gram``; with ``wanted``, for each of these alone."""
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_at: list[int] = []
            grams: list[str] = []
            for i, s in enumerate(batch.column(len(kept)).to_pylist()):
                found = _runs(s or "", wanted)
                rows_at.extend([i] * len(found)), grams.extend(found)
                if len(grams) >= OUT or i == batch.num_rows - 1:
                    at = pa.array(rows_at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(kept))), pa.array(grams, pa.string())], names=[*kept, "gram"])
                    rows_at, grams = [], []

    return rows.select(*kept, text).mapInArrow(run, f"{schema}, gram string")


def _keyed(rows: DataFrame, item: list[str]) -> DataFrame:
    """``rows`` (tenant, ``item``, grams) with the ``gram`` that the fewest of a tenant have, the first of several."""
    each = rows.select("tenant", *item, F.explode("grams").alias("gram"))
    often = each.groupBy("tenant", "gram").agg(F.count("*").alias("n"))
    return each.join(often.hint("merge"), ["tenant", "gram"]).groupBy("tenant", *item).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def by_name(names: DataFrame, templates: DataFrame) -> DataFrame:
    """tenant, name, template: the first template by ``place`` whose pattern each of the distinct ``names`` (tenant, name) has."""
    parsed = _parsed(templates).where("error is null")
    item = ["template", "place", "pattern"]
    indexed = _keyed(parsed.where(F.size("grams") > 0), item)
    fold = F.lower(F.translate("name", "".join(map(chr, _FOLD)), "".join(_FOLD.values())))
    met = spread(names.withColumn("text", fold), "text", few_grams(indexed)).join(indexed.hint("merge"), ["tenant", "gram"]).select("tenant", "name", F.array(F.struct(*item)).alias("items"))
    # patterns that any name could have: blocks of a tenant's, which its names meet
    free = parsed.where(F.size("grams") == 0)
    blocks = free.groupBy("tenant").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    packed = free.join(blocks, "tenant").groupBy("tenant", F.expr("pmod(xxhash64(template, pattern), blocks)").alias("block")).agg(F.collect_list(F.struct(*item)).alias("items"))
    any_name = names.join(blocks, "tenant").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)"))).join(packed, ["tenant", "block"]).select("tenant", "name", "items")
    schema = ", ".join(f"{c} {templates.schema[c].dataType.simpleString()}" for c in ("tenant",)) + f", name string, template {templates.schema['template'].dataType.simpleString()}, place {templates.schema['place'].dataType.simpleString()}"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, templates_, places = [], [], []
            for i, (name, items) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                fits = [(x["place"], x["template"]) for x in items if (p := _compiled(x["pattern"])) and p.search(name)]
                if fits:
                    place, template = min(fits)
                    rows.append(i), templates_.append(template), places.append(place)
            at = pa.array(rows, pa.int64())
            kinds = batch.schema.field(2).type.value_type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(templates_, kinds.field("template").type), pa.array(places, kinds.field("place").type)], names=["tenant", "name", "template", "place"])

    found = met.unionByName(any_name).mapInArrow(verify, schema)
    return found.groupBy("tenant", "name").agg(F.min(F.struct("place", "template"))["template"].alias("template"))


def coverage(pages: DataFrame, key: str, templates: DataFrame) -> DataFrame:
    """tenant, ``key``, template, place, score: the share of a template's ``fields`` that each page (tenant, ``key``, page) contains, where it is not 0."""
    listed = templates.select("tenant", "template", "place", F.explode("fields").alias("field")).where("coalesce(field, '') <> ''").withColumn("field", F.lower("field"))
    wanted = listed.groupBy("tenant", "template", "place", "field").agg(F.count("*").alias("m"))
    sizes = listed.groupBy("tenant", "template", "place").agg(F.count("*").alias("n"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [sorted(set(keys_of(f))) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.list_(pa.string()))], names=["tenant", "field", "grams"])

    tenant = templates.schema["tenant"].dataType.simpleString()
    indexed = _keyed(listed.select("tenant", "field").distinct().mapInArrow(grams, f"tenant {tenant}, field string, grams array<string>"), ["field"])
    met = spread(pages.select("tenant", key, F.lower("page").alias("page")), "page", few_grams(indexed)).join(indexed.hint("merge"), ["tenant", "gram"]).select("tenant", key, "field")
    # a page's candidates come to its text some at a time
    many = met.groupBy("tenant", key).agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    some = met.join(many.hint("merge"), ["tenant", key]).groupBy("tenant", key, F.expr("pmod(xxhash64(field), parts)").alias("part")).agg(F.collect_list("field").alias("fields"))
    low = F.lower("page")
    told = pages.select("tenant", key, "page").join(some.hint("merge"), ["tenant", key]).select("tenant", key, F.explode(F.filter("fields", lambda f: F.contains(low, f))).alias("field"))
    hits = told.join(wanted.hint("merge"), ["tenant", "field"]).groupBy("tenant", key, "template", "place").agg(F.sum("m").alias("hits"))
    return hits.join(sizes.hint("merge"), ["tenant", "template", "place"]).select("tenant", key, "template", "place", (F.col("hits") / F.col("n")).alias("score"))


def detected(files: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """The template of each file (tenant, ``key``, name, page): the first of its tenant whose pattern its name has, else the one most of whose fields its first page names
    (``COVERAGE`` at least; of equals the first), else the only one there is.

    ``templates``: (tenant, template, place, pattern, fields), active ones, in the order of ``place``.
    """
    named = by_name(files.where("name is not null").select("tenant", "name").distinct(), templates).withColumnRenamed("template", "by_name")
    best = coverage(files.where(F.length("page") > LEAST).select("tenant", key, "page"), key, templates).where(F.col("score") >= COVERAGE)
    best = best.groupBy("tenant", key).agg(F.max_by("template", F.struct("score", -F.col("place"))).alias("by_page"))
    only = templates.groupBy("tenant").agg(F.when(F.count("*") == 1, F.min("template")).alias("only")).where("only is not null")
    out = files.select("tenant", key, "name").join(named.hint("merge"), ["tenant", "name"], "left").join(best.hint("merge"), ["tenant", key], "left").join(only, "tenant", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_page").isNotNull(), "page").when(F.col("only").isNotNull(), "only")
    return out.select("tenant", key, F.coalesce("by_name", "by_page", "only").alias("template"), how.alias("how"))
