"""Language identification by string kernels.

The kernel of two texts is blended over n-grams of one to three bytes: the cosine of
their presence vectors (an n-gram counts once, however often it occurs). Landmarks are
training texts; the n-grams that occur in them are the feature set, and the Nyström map
sends a text to K(text, landmarks) K(landmarks, landmarks)^-1/2. On it, one ridge
regression a language (one against the rest) is solved in closed form. Scoring is a
presence matrix of a batch of whole texts times landmarks, times map, times weights.

Trained on a bounded sample: ``TRAIN`` whole texts a language at most, of which ``LANDMARKS``
are landmarks. Tasks find the n-grams of each text of the sample; those of most texts are the
features, and only which of these a text has, a bit each, comes to the driver. Scored texts
are whole as well.

Cases: null texts and texts without a letter are ``und`` with score 0; very long texts are
scored in pieces whose presence is joined; equal rows score equally; without labelled rows
every text is ``und``; no rows give no rows; rows keep their ids, repeated or not; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, released, table, utf8_parts

#: Bounds of the training sample: texts a language, landmarks in all; n-grams kept; ridge.
TRAIN, LANDMARKS, GRAMS, RIDGE = 400, 240, 6000, 1e-2
#: Bytes of a text that are looked at together.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[*range(9, 14), *range(48, 58)]] = 32


def _codes(data: np.ndarray) -> list[np.ndarray]:
    """Numbers of the n-grams at each byte: one, two and three bytes, in ranges of their own."""
    x = _LOWER[data].astype(np.int32)
    two = (x[:-1] << 8 | x[1:]) + 256
    three = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) + 256 + 65536
    return [x, two, three]


def _distinct_codes(data: np.ndarray) -> np.ndarray:
    """The n-grams of a text, each once; long texts in pieces that overlap by an n-gram."""
    found = [np.unique(np.concatenate(_codes(data[at : at + PIECE + 2]))) for at in range(0, max(len(data), 1), PIECE)]
    return np.unique(np.concatenate(found))


class KernelModel:
    """``grams``: numbers of the n-grams that are features, sorted; ``present``: which of them each text of the sample has; ``labels``: its language."""

    def __init__(self, grams: np.ndarray, present: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.index = np.full(256 + 65536 + (1 << 24), len(grams), np.uint16)
        self.index[grams] = np.arange(len(grams))
        self.size = len(grams)
        if not labels:
            return
        order = np.random.default_rng(9).permutation(len(labels))
        rows = self.unit(present.astype(np.float32))
        self.landmarks = rows[order[:LANDMARKS]]
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        self.map = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        z = np.hstack([rows @ self.landmarks.T @ self.map, np.ones((len(rows), 1), np.float32)]).astype(np.float64)
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        share = (y > 0).mean(0)
        weight = np.where(y > 0, 0.5 / share, 0.5 / np.maximum(1 - share, 1e-9))
        self.weights = np.stack([np.linalg.solve((z * w[:, None]).T @ z + RIDGE * len(z) * np.eye(z.shape[1]), (z * w[:, None]).T @ t) for w, t in zip(weight.T, y.T, strict=True)], axis=1)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[:, : self.size]
        return rows / np.maximum(np.sqrt(rows.sum(1, keepdims=True)), 1)

    def presence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row of 0 and 1 for each text, and a last column for n-grams that are no features."""
        n = len(off) - 1
        flat = np.zeros(n * (self.size + 1), np.float32)
        for start in range(0, len(data), PIECE):
            some = data[start : start + PIECE + 2]
            lo, hi = int(np.searchsorted(off, start, "right")) - 1, int(np.searchsorted(off, start + len(some)))
            text = np.repeat(np.arange(lo, hi) * (self.size + 1), np.diff(np.clip(off[lo : hi + 1], start, start + len(some))))
            for k, codes in enumerate(_codes(some)):
                base = text[: len(codes)]
                at = base + self.index[codes]
                flat[at if not k else at[base == text[k:]]] = 1
        return flat.reshape(n, -1)

    def scores(self, presence: np.ndarray) -> np.ndarray:
        """A number for each language, 0 to 1, that sum to 1."""
        z = self.unit(presence) @ self.landmarks.T @ self.map
        raw = z @ self.weights[:-1] + self.weights[-1]
        e = np.exp(4 * (raw - raw.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def least_hashes(rows: DataFrame, label: str, each: int) -> DataFrame:
    """Of ``rows`` (doc_id and ``label``, a column of few values), those of least hash of the id, ``each`` of a label.

    The labels are counted first; a threshold on the hash then leaves about twice as many rows as are wanted, all over the table, and
    only these are ranked. A label with fewer than ``each`` above that (the chance is under 1e-20) would give those it has.
    """
    h = F.xxhash64("doc_id")
    counts = rows.groupBy(label).count().collect()
    if not counts:
        return rows
    scale = float(1 << 63)
    most = lambda n: int(min(1.0, (2 * each + 200) / n) * 2 * scale - scale) if (2 * each + 200) < n else (1 << 63) - 1
    below = F.create_map(*(F.lit(x) for r in counts for x in (r[label], most(r["count"]))))
    few = rows.where(h <= F.try_element_at(below, F.col(label)))
    order = Window.partitionBy(label).orderBy(h, "doc_id")
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_rank")


def _sample_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_distinct_codes(data[a:b]) for _, _, data, off in utf8_parts(batch.column(2)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "lang", "codes"])


def train(docs: DataFrame, per_language: int = TRAIN) -> KernelModel:
    """A model of a bounded sample of ``docs`` (doc_id, text, lang): those of least hash in each language. Of rows that share an id and a language one is taken."""
    ids = docs.where("lang is not null and doc_id is not null and text is not null and trim(text) <> ''").select("doc_id", "lang").distinct()
    picked = least_hashes(ids, "lang", per_language)
    texts = docs.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", "text")
    sample = materialise(texts.mapInArrow(_sample_codes, "doc_id long, lang string, codes array<int>"))
    grams = sample.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy(F.desc("count"), "code").limit(GRAMS).collect()
    grams = np.sort(np.array([r.code for r in grams], np.int64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(np.isin(grams, np.asarray(x.values))).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "lang", "present"])

    rows = sample.mapInArrow(bits, "doc_id long, lang string, present binary").orderBy("doc_id", "lang").collect()
    released(sample)
    present = np.array([np.unpackbits(np.frombuffer(r.present, np.uint8))[: len(grams)] for r in rows], np.uint8).reshape(len(rows), len(grams))
    return KernelModel(grams, present, [r.lang for r in rows])


def predict(docs: DataFrame, model: KernelModel) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, lang_pred, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages = np.array([*m.languages, "und"], object)
        for batch in batches:
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False))
            best = np.full(batch.num_rows, len(m.languages))
            score = np.zeros(batch.num_rows)
            if m.languages:
                for lo, hi, data, off in utf8_parts(batch.column(1)):
                    for a in range(lo, hi, 256):
                        b = min(a + 256, hi)
                        part = off[a - lo : b - lo + 1]
                        s = m.scores(m.presence(data[part[0] : part[-1]], part - part[0]))
                        best[a:b], score[a:b] = s.argmax(1), s.max(1)
            best[~letters], score[~letters] = len(m.languages), 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
