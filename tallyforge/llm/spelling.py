"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

An edit changes few letter counts: words that differ by one replaced code point have a squared
distance of 2 between their count vectors, by one inserted or deleted code point of 1. So NumPy
products of blocks of count vectors (|x|^2 + |y|^2 - 2xy) give all pairs at most two apart in
adjacent lengths, and only these are compared letter by letter.

Which words meet in a block: the alphabet is cut into ``GROUPS`` groups of letters, and a word
has a cell, its counts by group. Each edit joins words that are in one cell, or that come to
one cell when a letter is taken from the longer or from both. A word is therefore sent to its
cell and to the cells with one letter less (nine places at most), and a place holds two adjacent
lengths. A pair meets in one place only, but for words of one cell, which are compared in the
place of their first group. Tasks take the places in order, as many together as fill a block;
a place with more than ``PART`` words is cut by a hash of the word and its parts meet in pairs,
so no task or product grows with it and no pair is lost.

Words are counted per document inside the tasks that read the texts, and each task sends a
word once for some hundred thousand; from then on only distinct words move.

Cases: null texts have no words; rows without an id keep their words as they are (there is nothing to
hash), rows that share an id count each; very long texts are cut between words, and a run of any
length is one word; equal texts count each; no rows or no frequent words give no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, released, salted_join, table

#: Code points of a word, and its occurrences, at least; a run is changed if this divides its hash.
LENGTH, OFTEN, CHANGED = 5, 3, 97
#: Groups of letters; words of a block; words of a place's part.
GROUPS, BLOCK, PART = 8, 256, 1024
#: Words that a task counts before it sends them; code points of a text looked at together; words longer than this are compared one pair at a time.
HELD, PIECE, LONG = 200_000, 1 << 20, 64
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters, which all have one byte in latin-1: 26 and 64.
_LETTER = np.full(256, -1)
_LETTER[[*range(97, 123), *range(192, 256)]] = np.arange(90)
_GROUP = np.arange(90) % GROUPS


def _pieces(text: str) -> Iterator[str]:
    """``text``, in pieces that end between words."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and _RUN.match(text, end, end + 1):
            end += 1
        yield text[start:end]
        start = end


def spelled(doc_id: int | None, run: str) -> str:
    """The word that a document's run counts for."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % CHANGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            for piece in _pieces(text.encode().lower().decode()):  # bytes lower only A-Z
                for run, n in Counter(_RUN.findall(piece)).items():
                    word = spelled(doc_id, run)
                    if len(word) >= LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield _words(held)
                    held = Counter()
    if held:
        yield _words(held)


def _words(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """A row of 90 counts for each word in latin-1."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    letters = _LETTER[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(owner * 90 + letters, minlength=90 * len(words)).reshape(len(words), 90)


def _cells(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts[:, _GROUP == g].sum(1) for g in range(GROUPS)], axis=1)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to a row for each place: its cell, a byte a group, and the group that lost a letter (-1: none)."""
    unit = np.uint64(1) << (np.uint64(8) * np.arange(GROUPS, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            words = [w.encode("latin-1") for w in part.column(0).to_pylist()]
            counts = letter_counts(words)
            cells = _cells(counts)
            own = (cells.astype(np.uint64) & np.uint64(255)) @ unit
            row, group = np.nonzero(cells)
            place = np.concatenate([own, own[row] - unit[group]])
            rows = pa.array(np.concatenate([np.arange(len(words)), row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.view(np.int64)), pa.array(np.concatenate([np.full(len(words), -1), group]).astype(np.int8)), part.column(0).take(rows), part.column(1).take(rows)], names=["place", "lost", "word", "n"]
            )


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words are one inserted, deleted or replaced byte apart."""
    if len(a) > len(b):
        a, b = b, a
    front = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) < 2 and a[front + (len(a) == len(b)) :] == b[front + 1 :]


def _edits(words: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; the words of ``j`` are as long or one longer."""
    size = np.array([len(w) for w in words])
    width = int(min(size.max(), LONG)) + 1
    letters = np.zeros((len(words), width), np.uint8)
    short = np.flatnonzero(size <= LONG)
    for k in short:
        letters[k, : size[k]] = np.frombuffer(words[k], np.uint8)
    found = np.zeros(len(i), bool)
    brief = size[j] <= LONG
    x, y = letters[i[brief]], letters[j[brief]]
    same = size[i[brief]] == size[j[brief]]
    differ = x != y
    shifted = np.zeros_like(differ)
    shifted[:, :-1] = x[:, :-1] != y[:, 1:]
    front = np.where(differ.any(1), differ.argmax(1), width)  # the first place where they part
    behind = np.where(shifted.any(1), width - 1 - shifted[:, ::-1].argmax(1), -1)  # the last where they part if one letter is left out
    found[brief] = np.where(same, differ.sum(1) == 1, behind < front)
    for k in np.flatnonzero(~brief):
        found[k] = one_edit(words[i[k]], words[j[k]])
    return found


def near_pairs(key: np.ndarray, lost: np.ndarray, side: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart among rows of one ``key``, each once. Rows of two sides (1, 2) are only compared across."""
    counts = letter_counts(words).astype(np.float32)
    square, size = (counts * counts).sum(1), counts.sum(1)
    distance = square[:, None] + square[None, :] - 2 * (counts @ counts.T)
    # the shorter word first, of equally long ones the earlier row
    i, j = np.nonzero((distance < 2.5) & (distance > 0.5) & (key[:, None] == key[None, :]))
    kept = (size[i] < size[j]) | ((size[i] == size[j]) & (i < j))
    # words of one cell meet in the place of each of their groups: only that of the first counts
    first = lost == (_cells(counts) > 0).argmax(1)
    kept &= ((lost[i] != lost[j]) | first[i]) & ((side[i] == 0) | (side[i] != side[j])) & (distance[i, j] < np.where(size[i] == size[j], 2.5, 1.5))
    i, j = i[kept], j[kept]
    if len(i):
        kept = _edits(words, i, j)
        i, j = i[kept], j[kept]
    return i, j


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_KEY = ["place", "a", "b"]


def _new(rows: pa.Table) -> np.ndarray:
    """Whether a row's key is another than that of the row before, from the second on."""
    keys = [np.asarray(rows.column(c)) for c in _KEY]
    return np.logical_or.reduce([k[1:] != k[:-1] for k in keys])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of place and parts, in blocks of whole keys."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([rest, rows]) if rest else rows).combine_chunks()
        start = 0
        for edge in (np.flatnonzero(_new(rows)) + 1).tolist():
            if edge - start >= BLOCK:
                yield rows.slice(start, edge - start)
                start = edge
        rest = rows.slice(start)
    if rest:
        yield rest


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word finds in a place: how many near words, and the best of them."""
    for rows in _blocks(batches):
        words = rows.column("word").to_pylist()
        lost, part, n, a, b = (np.asarray(rows.column(c)) for c in ("lost", "part", "n", "a", "b"))
        key = np.concatenate([[0], np.cumsum(_new(rows))])
        side = np.where(a == b, 0, np.where(part == a, 1, 2))
        best: dict[int, tuple[int, str]] = {}
        many: Counter[int] = Counter()
        for x, y in zip(*(k.tolist() for k in near_pairs(key, lost, side, [w.encode("latin-1") for w in words])), strict=True):
            for me, other in ((x, y), (y, x)):
                many[me] += 1
                better = (-int(n[other]), words[other])
                if me not in best or better < best[me]:
                    best[me] = better
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in best]), pa.array([many[k] for k in best]), pa.array([-v[0] for v in best.values()]), pa.array([v[1] for v in best.values()])], schema=_FOUND)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of the distinct ``words`` (word, n) that have a near word; the best is of largest n, then the first in order."""
    placed = materialise(words.mapInArrow(_places, "place long, lost byte, word string, n long"))
    # a place of many words is cut into parts, of which each two (and each alone) are a task's work
    parts = placed.groupBy("place").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    cut = placed.join(parts, "place", "left").withColumn("part", F.coalesce(F.expr("pmod(xxhash64(word), parts)").cast("int"), F.lit(0)))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.expr("sequence(0, parts - 1)")))
    met = cut.withColumn("other", other).select("place", "lost", "word", "n", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    found = met.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_matched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), F.col("x.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: ``forms`` (word, form), which make no circle, followed to their ends; the way known doubles in each round."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        many = at.groupBy("root").count()
        step = materialise(at.select(F.col("word").alias("root"), F.col("root").alias("next")).join(many, "root"))
        if not step.limit(1).count():
            return at
        after = materialise(salted_join(at, step, ["root"], "word", at.count(), "count", "left").select("word", F.coalesce("next", "root").alias("root")))
        released(at)
        released(step)
        at = after


def variants(docs: DataFrame) -> DataFrame:
    """Frequent words of ``docs`` (doc_id, text): form (the near word at least twice as frequent of largest n), root (the end of the forms), n, n_near, form_n."""
    words = materialise(vocabulary(docs))
    near = materialise(words.join(near_words(words), "word", "left").withColumn("formed", F.col("best_n") >= 2 * F.col("n")))
    form = lambda c: F.when(F.col("formed"), F.col(c))
    ends = roots(near.where("formed").select("word", F.col("best").alias("form")))
    out = near.join(ends, "word", "left")
    return out.select("word", form("best").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form("best_n").alias("form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Near words by the words with one code point left out.
ORACLE = r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS c FROM run WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT doc_id, run, c, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS bytes FROM once),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
w AS (SELECT word, sum(c)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w),
less AS (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM p),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM less x JOIN less y ON x.place = y.place AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT less.word, w.word, w.n FROM less JOIN w ON less.rest = w.word UNION SELECT w.word, less.word, less.n FROM less JOIN w ON less.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT r.word, f.form, d + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, d) AS root FROM r GROUP BY word) USING (word)
"""
