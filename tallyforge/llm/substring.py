"""Substring dedup by level-wise doubling.

A window is a run of words. Level by level, windows that occur in more than one place at
one length alone are extended to twice that length (at last to the length asked for), and
looked up again, until no candidates survive or the length is reached. What survives tells
of each window the smallest document in which its words start.

At each level a text shows only the windows that a candidate of the length asked for must
contain anyway: of the shorter windows inside a candidate the one of least hash. Equal
candidates choose equal windows; one whose choice occurs nowhere else can't be repeated and
is no candidate any more. So a fraction of the positions is shuffled, and fewer texts at each
level. Texts with the same words are one text in all this: the copy with the smallest id
stands for them.

Windows are compared by hashes of 64 bits while candidates are sought and of 128 bits
where words are removed, texts with the same words by 128 bits. Counts are grouped with
partial sums and joined back by ``salted_join``, which cuts the rows of a very frequent
window into parts, so a passage that a third of the documents hold is no single task's work.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; of
equal rows the one with the smaller id stays whole; rows that share an id are the same
document (none comes before the other), each with its own text; a row without an id comes
before no other and loses nothing; no rows give no rows; ``dedup_substrings`` keeps other
columns, whatever their names, and the query does not read them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import WordHasher, materialise, mix, own_name, released, salted_join, signed, table, utf8_parts, word_bounds

#: Words of a window, and of the shortest windows that are looked up.
WINDOW, SHORTEST = 13, 7


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths of windows, each about twice the one before, up to ``length``; none under ``shortest`` but ``length`` itself."""
    out = [length]
    while -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


@functools.cache
def _hashers() -> tuple[WordHasher, WordHasher]:
    return WordHasher(31), WordHasher(32)


def _positions(heads: np.ndarray, length: int) -> np.ndarray:
    """Which words begin a window of ``length`` that stays inside its text. ``heads``: first word of each text, and the end."""
    n = int(heads[-1])
    left = np.repeat(heads[1:], np.diff(heads)) - np.arange(n)
    return left >= length


def _least(runs: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbours, by spans of one, two, four and so on."""
    n, reach = len(runs) - span + 1, 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while 2 * reach <= span:
        runs = np.minimum(runs[:-reach], runs[reach:])
        reach *= 2
    return np.minimum(runs[:n], runs[span - reach : span - reach + n])


def _candidates(words: np.ndarray, heads: np.ndarray, length: int, level: int, wanted: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where windows of ``length`` begin whose least window of ``level`` words is among their own text's ``wanted`` hashes (``count`` for each text)."""
    inside = _positions(heads, length)
    least = _least(_hashers()[0].runs(words, level), length - level + 1)
    text = np.repeat(np.arange(len(count), dtype=np.uint64), np.diff(heads))
    owner = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    found = np.isin(mix(least ^ mix(text[: len(least)])), mix(wanted ^ mix(owner)))
    return np.flatnonzero(inside[: len(least)] & found)


def _shown(words: np.ndarray, heads: np.ndarray, at: np.ndarray, length: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of ``length`` that begin ``at``: the hashes of their least windows of ``level`` words, each once a text, and where each text's begin."""
    least = _least(_hashers()[0].runs(words, level), length - level + 1)[at]
    text = np.searchsorted(heads, at, "right").astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    least, text = least[new], text[new]
    once = np.sort(np.unique(mix(least ^ mix(text)), return_index=True)[1])
    return least[once], np.searchsorted(text[once], np.arange(1, len(heads) + 1, dtype=np.uint64)).astype(np.int32)


def _sketch(length: int, level: int):
    """Per text: id, hash, words' digest, count of words, and the hashes of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _hashers()
        for batch in batches:
            for lo, hi, data, off in utf8_parts(batch.column(2)):
                starts, ends, heads = word_bounds(data, off)
                words = first.words(data, starts, ends)
                place = np.arange(len(words)) - np.repeat(heads[:-1], np.diff(heads))
                keyed = mix(words + mix(place.astype(np.uint64) + np.uint64(7)))
                keyed2 = mix(second.words(data, starts, ends) ^ mix(place.astype(np.uint64) + np.uint64(11)))
                zero = np.zeros(1, np.uint64)
                d1, d2 = (np.diff(np.concatenate([zero, np.cumsum(x)])[heads]) for x in (keyed, keyed2))
                seeds, cuts = _shown(words, heads, np.flatnonzero(_positions(heads, length)), length, level)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(signed(d1)), pa.array(signed(d2)), pa.array(np.diff(heads)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(seeds)))],
                    names=["doc_id", "h", "d1", "d2", "n_words", "seeds"],
                )

    return run


def _found(batch: pa.RecordBatch, length: int, level: int):
    """For each slice of texts: their place in the batch, words, and the candidates that the last column's hashes of ``level`` leave."""
    first, second = _hashers()
    for lo, hi, data, off in utf8_parts(batch.column(2)):
        starts, ends, heads = word_bounds(data, off)
        words = first.words(data, starts, ends)
        held = batch.column(3)[lo:hi]
        count = np.asarray(pc.fill_null(pc.list_value_length(held), 0))
        at = _candidates(words, heads, length, level, np.asarray(held.flatten()).view(np.uint64), count)
        yield lo, hi, words, second.words(data, starts, ends) if len(at) else words, heads, at


def _longer(length: int, level: int, now: int):
    """Per text: the hashes of level ``now`` of the candidates that level ``level`` left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, _, heads, at in _found(batch, length, level):
                seeds, cuts = _shown(words, heads, at, length, now)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(seeds)))], names=["doc_id", "h", "seeds"])

    return run


def _windows(length: int, level: int):
    """The windows of ``length`` that are still candidates: 128 bits of hash, the document, and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _hashers()
        for batch in batches:
            for lo, hi, words, words2, heads, at in _found(batch, length, level):
                if not len(at):
                    continue
                text = np.searchsorted(heads, at, "right") - 1
                h1, h2 = first.runs(words, length)[at], second.runs(words2, length)[at]
                ids, hashes = (batch.column(k)[lo:hi].take(pa.array(text)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), ids, hashes, pa.array((at - heads[text]).astype(np.int32))], names=["h1", "h2", "doc_id", "h", "pos"])

    return run


def repeated_windows(docs: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, h, text), ``h`` a hash of the text: per text (doc_id, h, twin, n_words), and where in it windows begin that start in a smaller document too (doc_id, h, found).

    ``twin`` is the smallest document with the same words; the windows are of twins only.
    """
    docs = docs.where("doc_id is not null")
    steps = levels(length)
    sketch = "doc_id long, h long, d1 long, d2 long, n_words long, seeds array<long>"
    seeds = materialise(docs.mapInArrow(_sketch(length, steps[0]), sketch))
    twins = seeds.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("twin"), F.count("*").alias("n"))
    texts = materialise(salted_join(seeds.select("doc_id", "h", "d1", "d2", "n_words"), twins, ["d1", "d2", "n_words"], "doc_id", seeds.count()).select("doc_id", "h", "twin", "n_words"))
    ones = texts.where("doc_id = twin").select("doc_id", "h").distinct()
    shown = materialise(seeds.join(ones, ["doc_id", "h"], "left_semi").select("doc_id", "h", "seeds"))
    released(seeds)

    looked = steps[:-1] or steps
    for k, level in enumerate(looked):
        each = shown.select("doc_id", "h", F.explode("seeds").alias("seed"))
        often = each.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
        (total,) = shown.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0))).first()
        wanted = materialise(salted_join(each, often, ["seed"], "doc_id", total).groupBy("doc_id", "h").agg(F.collect_set("seed").alias("seeds")))
        released(shown)
        if k + 1 == len(looked) or wanted.isEmpty():
            break
        # candidates choose again, among windows of twice the length
        shown = materialise(docs.join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "seeds").mapInArrow(_longer(length, level, looked[k + 1]), "doc_id long, h long, seeds array<long>"))
        released(wanted)

    windows = materialise(docs.join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "seeds").mapInArrow(_windows(length, level), "h1 long, h2 long, doc_id long, h long, pos int"))
    released(wanted)
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    cover = materialise(salted_join(windows, first, ["h1", "h2"], "doc_id", windows.count()).where("first < doc_id").groupBy("doc_id", "h").agg(F.collect_set("pos").alias("found")))
    released(windows)
    return texts, cover


def _kept(length: int, batch: pa.RecordBatch, text: int, ids: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Of each row: words, words removed, and the words left, joined by a space. The last two columns are where windows to remove begin, and the twin."""
    found, twins = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for lo, hi, data, off in utf8_parts(batch.column(text)):
        starts, ends, heads = word_bounds(data, off)
        raw = data.tobytes()
        for i in range(lo, hi):
            a, b = heads[i - lo : i - lo + 2]
            n = int(b - a)
            gone = np.zeros(n + 1, np.int32)
            if twins[i].is_valid and ids[i].as_py() != twins[i].as_py() and n >= length:
                gone[0] = 1
            elif found[i].is_valid:
                at = np.asarray(found[i].values)
                np.add.at(gone, at, 1)
                np.add.at(gone, np.minimum(at + length, n), -1)
            keep = np.flatnonzero(np.cumsum(gone[:n]) == 0)
            s, e = starts[a:b][keep].tolist(), ends[a:b][keep].tolist()
            yield n, n - len(keep), b" ".join(map(raw.__getitem__, map(slice, s, e)))


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with two more columns: where windows to remove begin, and the twin."""
    key, found, twin = (own_name(docs.columns, x) for x in ("_text_hash", "_found", "_twin"))
    h = F.xxhash64(F.col("text").cast("string"))
    texts, cover = repeated_windows(docs.select(F.col("doc_id").cast("long"), h.alias("h"), F.col("text").cast("string")), length)
    marks = texts.groupBy("doc_id", "h").agg(F.min("twin").alias("twin")).join(cover, ["doc_id", "h"], "left").select("doc_id", F.col("h").alias(key), F.col("found").alias(found), F.col("twin").alias(twin))
    return docs.withColumn(key, h).join(marks.hint("merge"), ["doc_id", key], "left").select(*docs.columns, found, twin)


def removed_digests(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_words, n_removed, and the SHA-256 of the words left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, hashlib.sha256(text).hexdigest()) for n, gone, text in _kept(length, batch, 1, batch.column(0))]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _marked(docs, length).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, without the words that a repeated window covers. A text that loses nothing stays as it is; one of which nothing is left goes."""
    names = docs.columns
    text, key = names.index("text"), names.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text)
            new, stay = [], []
            for i, (n, gone, left) in enumerate(_kept(length, batch, text, batch.column(key))):
                new.append(left.decode() if gone else old[i].as_py())
                stay.append(gone < n or not gone)
            columns = [pa.array(new, old.type) if k == text else batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return _marked(docs, length).mapInArrow(run, docs.schema)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document before them has."""
    return dedup_substrings(docs, length=50).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


#: The same by all windows of all documents. A word goes if one of the 13 windows that can cover it begins in a smaller document too.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d),
g AS (SELECT doc_id, pos, n, word, {window} AS win FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT win, min(doc_id) AS first FROM g WHERE pos + 12 <= n GROUP BY win),
m AS (SELECT g.doc_id, g.pos, g.word, coalesce(f.first < g.doc_id AND g.pos + 12 <= g.n, false) AS twice FROM g LEFT JOIN f USING (win)),
r AS (SELECT doc_id, pos, word, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
t AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)
""".replace("{window}", " || ' ' || ".join(["word", *(f"coalesce(lead(word, {k}) OVER o, '')" for k in range(1, WINDOW))]))
