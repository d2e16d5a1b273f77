"""Quality classifier: a convolutional network over bytes, in numpy.

A text is covered by overlapping chunks of ``CHUNK`` bytes. In a chunk each byte is a
learned vector, learned filters of ``WIDTH`` bytes slide over them, and each filter's
largest and mean answer go through a small hidden layer to the chunk's evidence. The
text's probability is the logistic of the evidence of its chunks, weighted by their bytes:
every byte of the text takes part. Trained by gradient descent (Adam) on the log loss.

Trained on a bounded sample: ``TRAIN`` labelled texts of each label at most, and of each
text ``KEPT_CHUNKS`` chunks, spread evenly over the whole of it and cut out by the tasks that
read it, of which each pass draws ``TRAIN_CHUNKS``. So the driver gets some 20 MB at most.
Scored texts are always whole.

Cases: null and empty texts are one empty chunk (the zero vector in each place) and get its
score; very long texts are scored a few MB at a time; equal rows score equally; without
labelled rows every score is 0.5; no rows give no rows; rows keep their ids, repeated or
not; other columns are not read by ``score_quality`` and are kept by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table, utf8_parts
from tallyforge.llm.langid import held_out, least_hashes

CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 512, 64, 8, 3, 6, 24, 16
#: Bounds of the training sample: texts a label, chunks of a text, of those in a pass, passes.
TRAIN, KEPT_CHUNKS, TRAIN_CHUNKS, PASSES = 1200, 8, 4, 12
#: A text is accepted from this probability on.
ACCEPTED = 0.3
_AT = (np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)).ravel()
_PLACES = len(_AT) // WIDTH


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover ``n`` bytes."""
    return np.arange(0, max(n - OVERLAP, 1), CHUNK - OVERLAP)


def _chunks(data: np.ndarray, start: int, end: int, starts: np.ndarray) -> np.ndarray:
    """Rows of CHUNK byte numbers, 256 beyond the text's end."""
    at = start + starts[:, None] + np.arange(CHUNK)
    out = np.full(at.shape, 256, np.int32)
    inside = at < end
    out[inside] = data[at[inside]]
    return out


class ByteNet:
    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": normal(257, EMBED, scale=0.5), "filter": normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5), "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.2), "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][256] = 0
        self.trained = False

    def forward(self, x: np.ndarray, keep: bool = False):
        """Evidence of each chunk."""
        p = self.p
        windows = p["embed"][x[:, _AT]].reshape(len(x) * _PLACES, WIDTH * EMBED)
        answers = np.maximum(windows @ p["filter"] + p["bias"], 0).reshape(len(x), _PLACES, FILTERS)
        top = answers.max(1)
        pooled = np.hstack([top, answers.mean(1)])
        hidden = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
        evidence = hidden @ p["out"] + p["out_bias"]
        return (evidence, (windows, answers, top, pooled, hidden)) if keep else evidence

    def gradients(self, x: np.ndarray, weight: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Of the loss, of which ``weight`` is the derivative by each chunk's evidence."""
        windows, answers, top, pooled, hidden = kept
        p, g = self.p, {}
        g["out"], g["out_bias"] = hidden.T @ weight, weight.sum(keepdims=True)
        dh = np.outer(weight, p["out"]) * (hidden > 0)
        g["hidden"], g["hidden_bias"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["hidden"].T
        first = answers.argmax(1)
        da = np.repeat((dp[:, FILTERS:] / _PLACES)[:, None, :], _PLACES, axis=1)
        i, f = np.indices(first.shape)
        da[i, first, f] += dp[:, :FILTERS]
        da = (da * (answers > 0)).reshape(-1, FILTERS)
        g["filter"], g["bias"] = windows.T @ da, da.sum(0)
        dw = (da @ p["filter"].T).reshape(-1, EMBED)
        codes = x[:, _AT].ravel()
        g["embed"] = np.stack([np.bincount(codes, dw[:, k], 257) for k in range(EMBED)], axis=1).astype(np.float32)
        g["embed"][256] = 0
        return g

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> ByteNet:
        """``texts``: the chunks of each, as rows of byte numbers."""
        rng = np.random.default_rng(66)
        share = np.clip(labels.mean(), 0.02, 0.98)
        balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for turn in range(max(PASSES, min(60, 12_000 // max(1, len(texts))))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 32):
                docs, parts, owner = order[at : at + 32], [], []
                for i, d in enumerate(docs):
                    some = rng.choice(len(texts[d]), min(TRAIN_CHUNKS, len(texts[d])), replace=False)
                    parts.append(texts[d][some].astype(np.int32))
                    owner += [i] * len(some)
                x, owner = np.concatenate(parts), np.array(owner)
                evidence, kept = self.forward(x, keep=True)
                count = np.bincount(owner, minlength=len(docs))
                logit = np.bincount(owner, evidence, len(docs)) / count
                slope = (1 / (1 + np.exp(-logit)) - labels[docs]) * balance[docs] / len(docs)
                g = self.gradients(x, (slope / count)[owner].astype(np.float32), kept)
                step += 1
                rate = 4e-3 * (0.97**turn)
                for k, v in self.p.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                    square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                    v -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
        self.trained = True
        return self

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not self.trained:
            return np.full(n, 0.5)
        total, weight = np.zeros(n), np.zeros(n)
        parts: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size: list[np.ndarray] = []

        def flush() -> None:
            x, who, bytes_ = np.concatenate(parts), np.concatenate(owner), np.concatenate(size)
            np.add.at(total, who, self.forward(x) * bytes_)
            np.add.at(weight, who, bytes_)
            parts.clear(), owner.clear(), size.clear()

        held = 0
        for i in range(n):
            a, b = int(off[i]), int(off[i + 1])
            starts = chunk_starts(b - a)
            for s in range(0, len(starts), 256):
                some = starts[s : s + 256]
                parts.append(_chunks(data, a, b, some))
                owner.append(np.full(len(some), i))
                size.append(np.clip(b - a - some, 1, CHUNK))
                held += len(some)
                if held >= 256:
                    flush()
                    held = 0
        if parts:
            flush()
        return 1 / (1 + np.exp(-total / np.maximum(weight, 1)))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, quality, chunks) of (doc_id, quality, text): chunks spread over the whole text, as 16-bit byte numbers."""
    for batch in batches:
        cut = []
        for _, _, data, off in utf8_parts(batch.column(2)):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                starts = chunk_starts(b - a)
                some = starts[np.unique(np.linspace(0, len(starts) - 1, KEPT_CHUNKS).astype(int))]
                cut.append(_chunks(data, a, b, some).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary())], names=["doc_id", "quality", "chunks"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN) -> ByteNet:
    """A network fitted on a bounded sample: of ``docs`` (doc_id, text), those of least hash among each label of ``labels`` (doc_id, quality)."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = least_hashes(marked, "quality", per_label)
    # rows that share an id come to at most so many again; of those the least texts are taken
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", F.col("text").cast("string"))
    chunks = rows.mapInArrow(_spread, "doc_id long, quality int, chunks binary")
    found = chunks.groupBy("doc_id", "quality").agg(F.min("chunks").alias("chunks")).orderBy("doc_id").collect()
    net = ByteNet()
    y = np.array([r.quality for r in found], float)
    return net.fit([np.frombuffer(r.chunks, "<u2").reshape(-1, CHUNK) for r in found], y) if len(set(y)) == 2 else net


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.probabilities(data, off) for _, _, data, off in utf8_parts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    net = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, net).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= ACCEPTED, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    net = train(documents, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.probabilities(data, off) for _, _, data, off in utf8_parts(batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= ACCEPTED))

    return docs.mapInArrow(run, docs.schema)  # the documents themselves go through, so nothing is shuffled
