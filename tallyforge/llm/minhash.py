"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct 5-word shingles; its sketch the k
smallest. Texts with equal sets are one text. Inverted lists of the sketches' values
generate overlaps: two sets of similarity s share about s * k of the k smallest values of
their union, and by far more than ``SHARE`` of them, so it is enough to look up each
sketch's rarest values, all but ``SHARE * k - 1``. A value that very many documents hold (a
licence, a passage) is looked up only by those that hold little else.

Documents that meet in lists, directly or through others, form candidate groups. A group is
sorted by set size and cut into blocks; pairs of blocks whose sizes can be similar are
compared, first by the overlap of the union's sketch, and what that leaves by the exact
Jaccard similarity of full sets. A pair of blocks returns the links that connect what it
found (a spanning forest), not every pair; components of these are the classes. Chance of
missing one link (binomial tail of fewer than 14 in 32): 1e-8 at similarity 0.85, 1.2e-6 at 0.80;
a class has more than one link as a rule.

Cases: null texts and texts without words have an empty set, link with nothing and are kept;
with fewer words than a shingle, the whole sequence is the one shingle; very long texts give
a block of their own; equal rows link and share a verdict; of rows that share an id each text
is compared by itself; a row without an id is kept if no row of its class has one (of several
such texts that of least hash), with a null component_id; no rows give no rows; ``near_duplicates`` keeps other columns out and ``stage`` keeps them all, whatever their names.

Very frequent keys (the digests of a text that very many copies have, a value of very many sketches, a hub of links) are
joined by ``split_join``, map-side, so none is one task's work.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import WordHasher, connected_components, materialise, mix, own_name, released, signed, split_join, table, utf8_parts, word_bounds

SHINGLE = 5
#: Values of a sketch, and the share of a smaller sketch that two similar sets have in common at least.
SKETCH, SHARE = 32, 14 / 32
#: Documents and shingles of a block at most (one longer document is a block).
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 19


@functools.cache
def _hasher() -> WordHasher:
    return WordHasher(51, fold_case=True)


def _sets(data: np.ndarray, off: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    starts, ends, heads = word_bounds(data, off)
    hasher = _hasher()
    words = hasher.words(data, starts, ends)
    runs = hasher.runs(words, shingle)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(runs[a : b - shingle + 1])
        elif b > a:
            yield hasher.runs(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in utf8_parts(batch.column(1)):
                n, d1, d2, low, cuts = [], [], [], [], [0]
                for values in _sets(data, off, shingle):
                    n.append(len(values))
                    d1.append(int(values.sum(dtype=np.uint64)))
                    d2.append(int(mix(values + np.uint64(1)).sum(dtype=np.uint64)))
                    low.append(values[:SKETCH])
                    cuts.append(cuts[-1] + len(low[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(n, pa.int64()), *(pa.array(signed(np.array(x, np.uint64))) for x in (d1, d2)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(signed(np.concatenate(low))))],
                    names=["doc_id", "h", "n_shingles", "d1", "d2", "sketch"],
                )

    return run


def _blocks(shingle: int):
    """Texts in order of (grp, n) to blocks: first and last group, least and greatest set, ids, groups, set ends, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, np.ndarray]] = []
        weight = 0

        def out() -> pa.RecordBatch:
            nonlocal held, weight, made
            ids, groups, sets = zip(*held, strict=True)
            sizes = np.array([len(s) for s in sets])
            row = {
                "block": part << 32 | made, "first": groups[0], "last": groups[-1], "least": int(sizes.min()), "greatest": int(sizes.max()),
                "ids": np.array(ids, np.int64).tobytes(), "groups": np.array(groups, np.int64).tobytes(), "ends": np.cumsum(sizes).tobytes(), "hashes": np.concatenate(sets).tobytes(),
            }
            held, weight, made = [], 0, made + 1
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            ids, groups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, _, data, off in utf8_parts(batch.column(1)):
                for i, values in enumerate(_sets(data, off, shingle), lo):
                    if held and (len(held) >= BLOCK_DOCS or weight + len(values) > BLOCK_SHINGLES):
                        yield out()
                    held.append((ids[i], groups[i], values))
                    weight += len(values)
        if held:
            yield out()

    return run


_BLOCK = "block long, first long, last long, least long, greatest long, ids binary, groups binary, ends binary, hashes binary"
_BLOCK_ARROW = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in _BLOCK.split(", "))])


def _unpack(row, side: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    get = lambda name, kind: np.frombuffer(getattr(row, f"{name}_{side}"), kind)
    ends = get("ends", np.int64)
    return get("ids", np.int64), get("groups", np.int64), np.split(get("hashes", np.uint64), ends[:-1])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``: products of 0/1 matrices, some thousand values at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(va, vb)
    ia, ib = np.searchsorted(common, va), np.searchsorted(common, vb)
    if not len(common):
        return out
    ka, kb = common[np.minimum(ia, len(common) - 1)] == va, common[np.minimum(ib, len(common) - 1)] == vb
    ra, ia, rb, ib = ra[ka], ia[ka], rb[kb], ib[kb]
    width = 4096
    order_a, order_b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ra, ia, rb, ib = ra[order_a], ia[order_a], rb[order_b], ib[order_b]
    for at in range(0, len(common), width):
        sa, sb = slice(*np.searchsorted(ia, [at, at + width])), slice(*np.searchsorted(ib, [at, at + width]))
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ma[ra[sa], ia[sa] - at] = 1
        mb[rb[sb], ib[sb] - at] = 1
        out += ma @ mb.T
    return out


def _similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union. The smallest values of the union estimate it first: only rows and
    columns with some pair above half the threshold are compared in full."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    found = np.zeros((len(a), len(b)), bool)
    low = _overlaps([x[:SKETCH] for x in a], [x[:SKETCH] for x in b])
    near = low >= np.maximum(1, np.floor(SHARE * np.minimum(np.minimum(na[:, None], nb[None, :]), SKETCH)))
    near &= (100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])) & (na[:, None] > 0)
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return found
    if near.sum() <= 4 * max(len(rows), len(cols)):
        for i, j in zip(*np.nonzero(near), strict=True):
            both = len(np.intersect1d(a[i], b[j], assume_unique=True))
            found[i, j] = 100 * both >= percent * (na[i] + nb[j] - both)
        return found
    both = _overlaps([a[i] for i in rows], [b[j] for j in cols]).astype(np.int64)
    found[np.ix_(rows, cols)] = (100 * both >= percent * (na[rows][:, None] + nb[cols][None, :] - both)) & near[np.ix_(rows, cols)]
    return found


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links, as many as connect what they connect."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = ([], [])
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept[0].append(a)
            kept[1].append(b)
    return kept


def _links(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids_a, groups_a, sets_a = _unpack(row, "a")
                ids_b, groups_b, sets_b = _unpack(row, "b")
                for group in np.intersect1d(groups_a, groups_b):
                    at_a, at_b = (slice(*np.searchsorted(g, [group, group + 1])) for g in (groups_a, groups_b))
                    if row.block_a == row.block_b and at_a.stop - at_a.start < 2:
                        continue
                    i, j = np.nonzero(_similar(sets_a[at_a], sets_b[at_b], percent))
                    a, b = _forest(ids_a[at_a][i], ids_b[at_b][j])
                    yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _row_key() -> tuple[Column, Column]:
    """What tells rows apart: the id, where there is one, and a hash of the text."""
    h = F.xxhash64(F.col("text").cast("string"))
    return F.coalesce(F.col("doc_id").cast("long"), h), h


def _classes(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h (hash of the text), n_shingles, component_id, kept."""
    i, h = _row_key()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), h.alias("h"), i.alias("i"))
    sketches = materialise(docs.select("doc_id", "text", "h").mapInArrow(_sketches(shingle), "doc_id long, h long, n_shingles long, d1 long, d2 long, sketch array<long>"))
    # a row of least id stands for its set; one without an id only where no other has it
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    same = sketches.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(row).alias("rep"), F.count("*").alias("n"))
    sized = sketches.select("doc_id", "h", "n_shingles", "d1", "d2")
    apart = sized.where("n_shingles = 0").select("doc_id", "h", "n_shingles", row.alias("rep"))
    n_rows = sketches.count()
    reps = materialise(split_join(sized.where("n_shingles > 0"), same, ["d1", "d2", "n_shingles"], n_rows).select("doc_id", "h", "n_shingles", "rep").unionByName(apart))
    keys = reps.where("h = rep.h and doc_id <=> rep.doc_id and n_shingles > 0").select(F.coalesce("doc_id", "h").alias("i"), "h", "n_shingles").distinct()
    ones = materialise(sketches.withColumn("i", F.coalesce("doc_id", "h")).join(keys.select("i", "h"), ["i", "h"], "left_semi").select("h", "sketch"))
    released(sketches)

    # the rarest values of each sketch, of those that occur elsewhere
    values = ones.select("h", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").withColumn("n", F.col("df"))
    rare = split_join(values, often, ["value"], SKETCH * n_rows).groupBy("h", "k").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("often"))
    reach = F.col("k") - F.greatest(F.lit(1), F.floor(SHARE * F.col("k"))).cast("int") + 1  # values to look up, with those that occur once
    looked = rare.withColumn("n", reach - (F.col("k") - F.size("often"))).where("n > 0").select("h", F.explode(F.expr("slice(often, 1, n)")).alias("x"))
    lists = materialise(looked.select("h", "x.value"))
    released(ones)
    heads = lists.groupBy("value").agg(F.min("h").alias("b"), F.count("*").alias("n"))
    groups = materialise(connected_components(split_join(lists, heads, ["value"], lists.count()).select(F.col("h").alias("a"), "b")))
    released(lists)

    grouped = groups.withColumnRenamed("node", "h").join(keys, "h")
    texts = docs.join(grouped.hint("merge"), ["i", "h"]).dropDuplicates(["i", "h"])
    ordered = texts.repartitionByRange("component", "n_shingles", "h").sortWithinPartitions("component", "n_shingles", "h")
    blocks = materialise(ordered.select("h", "text", "component").mapInArrow(_blocks(shingle), _BLOCK))
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in blocks.columns))
    light = blocks.select("block", F.explode(F.array_distinct(F.array("first", "last"))).alias("grp"), "least", "greatest")
    spans = light.alias("x").join(light.alias("y"), F.expr("x.grp = y.grp and x.block < y.block")).where(F.expr(f"100 * x.greatest >= {percent} * y.least and 100 * y.greatest >= {percent} * x.least"))
    pairs = spans.select(F.col("x.block").alias("block_a"), F.col("y.block").alias("block_b")).distinct().unionByName(blocks.select(F.col("block").alias("block_a"), F.col("block").alias("block_b")))
    compared = side("a").join(pairs.repartition("block_a"), "block_a").join(side("b"), "block_b")
    links = materialise(connected_components(compared.mapInPandas(_links(percent), "a long, b long")).select(F.col("node").alias("rep_h"), "component"))
    released(blocks)
    heads = reps.select("rep").distinct().withColumn("rep_h", F.col("rep.h")).join(links, "rep_h").groupBy("component").agg(F.min("rep").alias("head"))
    linked = links.join(heads, "component").select("rep_h", "head")
    out = reps.withColumn("rep_h", F.col("rep.h")).join(linked, "rep_h", "left").withColumn("top", F.coalesce("head", "rep"))
    return out.select("doc_id", "h", "n_shingles", F.col("top.doc_id").alias("component_id"), F.expr("doc_id <=> top.doc_id and h = top.h").alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_shingles, component_id (smallest document of its class), kept (whether it is that one).

    Documents are linked if the similarity of their sets is ``percent`` hundredths or more.
    """
    return _classes(docs, percent, shingle).select("doc_id", "n_shingles", "component_id", "kept")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (similarity 0.8 or more) stays."""
    key, text_hash = own_name(docs.columns, "_row_id"), own_name(docs.columns, "_text_hash")
    kept = _classes(docs, 80, SHINGLE).where("kept").select(F.coalesce("doc_id", "h").alias(key), F.col("h").alias(text_hash)).distinct()
    i, h = _row_key()
    return docs.withColumn(key, i).withColumn(text_hash, h).join(kept.hint("merge"), [key, text_hash], "left_semi").select(*docs.columns)


#: The same by counting the shingles that each two documents share.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, pos, n, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS shingle FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE pos + 4 <= n UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT b.a, b.b FROM b JOIN c x ON x.doc_id = b.a JOIN c y ON y.doc_id = b.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
k AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, k.component_id, doc_id = k.component_id AS kept FROM documents JOIN k ON k.node = doc_id LEFT JOIN c USING (doc_id)
"""
