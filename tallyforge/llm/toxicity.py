"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters look at a text and fire or don't. Most are lexicons, mined from labelled rows: whole
words and beginnings of words (stems, so that inflected forms count) that are several times as
frequent among toxic texts; they are dealt in order of evidence to ``LEXICONS`` lexicons, each
of which votes twice (fires on a hit; on several). Others are fixed lexicons of insults, patterns
(shouting, masked or spelled-around words, being addressed) and one that fires where no entry is found.

The label model knows the votes' means and covariances over all documents, two moments that are
summed in one pass. If votes were independent given the class, the covariance of voters i and j would
be v_i v_j with v_i = sqrt(p (1 - p)) (P(i fires | toxic) - P(i fires | clean)); so v is a
rank-one fit of the off-diagonal part, first by medians; pairs that fit badly are correlated and leave the fit.
Labels give the share p of toxic rows and the start of the fit. Accuracies follow from v; a voter's
weight is divided by its correlated company. The posterior of each document's class follows by
Bayes.

The classifier, a logistic regression over the counts of words and stems, learns from a bounded
sample of texts with posterior labels: ``TEXTS`` a class. Its features are chosen by that sample, so it
knows words that no lexicon has. Only it scores; every word of every text takes part.

Labels are read at most for ``TRAIN`` texts a label. Cases: null and empty texts have no words and get
the score of the intercept; very long texts are read piece by piece; equal texts score equally; without labels of both
classes every score is 0; no rows give no rows; rows keep their ids, repeated or not; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import WordHasher, materialise, mix, released, table, utf8_parts, word_bounds
from tallyforge.llm.langid import held_out, least_hashes

#: Bounds: labelled texts a label from which lexicons are mined; entries mined; texts a class that the classifier learns from; its features.
TRAIN, ENTRIES, TEXTS, FEATURES = 3000, 600, 3000, 4096
#: Lexicons that mined entries are dealt to, hits that are several, and how much more frequent an entry is among toxic texts at least; the same of a feature.
LEXICONS, SEVERAL, TIMES, TELLING = 12, 3, 6.0, 2.5
#: Bytes of the beginnings of words that are features (0: the whole word); bytes of a text looked at together.
STEMS, PIECE = (0, 4, 5, 6, 7), 1 << 20
#: Words to which a count is related; penalty on the classifier's weights; steps of its fit.
PER, SPARSE, STEPS = 200, 1.5e-4, 400
#: A text is toxic from this probability on.
TOXIC = 0.5

#: Insults by language.
INSULTS = {
    "en": "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb jerk bastard imbecile",
    "de": "idiot dummkopf trottel abschaum versager widerlich erbärmlich schwachkopf vollidiot arschloch",
    "fr": "idiot imbécile crétin connard salaud ordure débile minable abruti pourriture",
    "es": "idiota imbécil estúpido basura escoria perdedor asqueroso inútil payaso cabrón",
}
#: Patterns of the text as it stands; phrases of it in lower case (ASCII) are one voter more.
PATTERNS = [
    rb"(?:\b[A-Z]{4,}\b[ ,]*){3,}!",
    rb"[!?]{2,}",
    rb"(?<=[A-Za-z])[*@#$%]{2,}[A-Za-z]",
    rb"(?<=[A-Za-z])[013457@$][A-Za-z]",
    rb"\b[Yy][Oo][Uu](?:'re| are)? (?:a|an|such|all|so)\b",
]
PHRASES = [b"shut up", b"get lost", b"go away", b"drop dead", b"hate you"]
_PATTERNS = [re.compile(p) for p in PATTERNS]
#: A lexicon votes twice; then come the fixed lexicons, the patterns and the voter for clean texts.
VOTERS = 2 * LEXICONS + len(INSULTS) + len(PATTERNS) + 2

_FOLD = np.full(256, 32, np.uint8)
_FOLD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_FOLD[65:91] = np.arange(97, 123)
_HASHER = WordHasher(1313)


def letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 in lower case (ASCII and latin-1 letters), blanks for all but letters."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, index of the text) of the words and stems of texts; a stem is shorter than its word."""
    starts, ends, heads = word_bounds(data, off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(heads))
    for size in STEMS:
        if size:
            some = ends - starts > size
            yield mix(_HASHER.words(data, starts[some], starts[some] + size) + np.uint64(size)), owner[some]
        else:
            yield _HASHER.words(data, starts, ends), owner


def _parts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Folded bytes and offsets, a very long text in pieces that end between words."""
    low = letters(data)
    if len(off) > 2 or len(low) <= PIECE:
        yield low, off
        return
    start = 0
    while start < len(low):
        end = min(start + PIECE, len(low))
        while end < len(low) and low[end] != 32:
            end += 1
        yield low[start:end], np.array([0, end - start])
        start = end


class Known:
    """Positions of hashes in a sorted list."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (text * entries + entry) that occur, and how often."""
        found = []
        for low, part in _parts(data, off):
            for h, owner in features(low, part):
                maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.searchsorted(self.hashes, h[maybe])
                hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[maybe] if len(self.hashes) else np.zeros(len(maybe), bool)
                found.append(owner[maybe[hit]] * len(self.hashes) + at[hit])
        return np.unique(np.concatenate(found), return_counts=True)


def associated(texts: DataFrame, limit: int, times: float, least: int) -> np.ndarray:
    """Hashes of the words and stems that tell the classes of a bounded sample ``texts`` (label 0 or 1, text) apart best, ``limit`` at most.

    Those come that are ``times`` as frequent in class 1, by rates of texts, and occur in ``least`` of its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(0))
            for lo, hi, data, off in utf8_parts(batch.column(1)):
                each: list[np.ndarray] = []
                for low, part in _parts(data, off):
                    for h, owner in features(low, part):
                        pair = np.unique(np.stack([h, owner.astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                        each.append(pair)
                pairs = np.unique(np.concatenate(each, axis=1), axis=1)
                h, inverse = np.unique(pairs[0], return_inverse=True)
                toxic = np.bincount(inverse, label[lo:hi][pairs[1].astype(np.int64)], len(h)).astype(np.int64)
                both = np.bincount(inverse, minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], names=["h", "toxic", "clean"])

    sizes = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    one, none = sizes.get(1, 0), sizes.get(0, 0)
    if not one or not none:
        return np.zeros(0, np.uint64)
    seen = texts.select("label", "text").mapInArrow(run, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (one + 1.0)) - F.log((F.col("b") + 0.5) / (none + 1.0))
    picked = seen.withColumn("ratio", ratio).where((F.col("a") >= least) & (F.col("ratio") >= float(np.log(times))))
    return np.array([r.h for r in picked.orderBy(F.desc(F.col("ratio") * F.col("a")), "h").limit(limit).collect()], np.int64).view(np.uint64)


class Voters:
    """``entries``: mined hashes, those of most evidence first."""

    def __init__(self, entries: np.ndarray):
        fixed = [np.unique([_HASHER.words(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in words.split()]) for words in INSULTS.values()]
        self.known = Known(np.unique(np.concatenate([entries, *fixed])))
        # the lexicon of a mined entry (LEXICONS: none), and which fixed ones have it
        self.mined = len(entries) > 0
        self.lexicon = np.full(len(self.known.hashes), LEXICONS)
        self.lexicon[np.searchsorted(self.known.hashes, entries)] = np.arange(len(entries)) % LEXICONS
        self.fixed = np.stack([np.isin(self.known.hashes, f) for f in fixed], axis=1)

    def votes(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """0 or 1 of each voter (a column) for each text."""
        n, size = len(off) - 1, len(self.known.hashes)
        out = np.zeros((n, VOTERS), np.uint8)
        at, often = self.known.counts(data, off)
        row, entry = at // size, at % size
        hits = np.bincount(row * (LEXICONS + 1) + self.lexicon[entry], often, n * (LEXICONS + 1)).reshape(n, LEXICONS + 1)[:, :LEXICONS]
        out[:, :LEXICONS] = hits >= 1
        out[:, LEXICONS : 2 * LEXICONS] = hits >= SEVERAL
        out[:, -1] = (hits.sum(1) == 0) & self.mined
        which, language = np.nonzero(self.fixed[entry])
        out[row[which], 2 * LEXICONS + language] = 1
        text, ends = data.tobytes(), off.tolist()
        low = text.lower()
        each = list(zip(ends[:-1], ends[1:], strict=True))
        for k, pattern in enumerate(_PATTERNS, 2 * LEXICONS + len(INSULTS)):
            out[:, k] = [pattern.search(text, a, b) is not None for a, b in each]
        out[:, -2] = [any(low.find(p, a, b) >= 0 for p in PHRASES) for a, b in each]
        return out


class LabelModel:
    """Accuracies and correlations of the voters from moments of their votes.

    ``n``: rows; ``both``: in how many rows each two voters fire; ``share``: of toxic rows; ``start``: P(fires | toxic) - P(fires | clean) of each, as labels have it.
    """

    def __init__(self, n: int, both: np.ndarray, share: float, start: np.ndarray):
        self.share = share
        mean = np.diag(both) / max(n, 1)
        cov = both / max(n, 1) - np.outer(mean, mean)
        scale = np.sqrt(share * (1 - share))
        known = scale * start
        v = known.copy()
        free = ~np.eye(len(v), dtype=bool)
        deviation = np.sqrt(np.maximum(np.outer(np.diag(cov), np.diag(cov)), 1e-12))
        weight = 1e-2 * scale**2  # of the labels' own estimate
        for turn in range(80):
            if turn >= 20 and turn % 10 == 0:
                # what the classes don't explain, as a correlation; pairs far off depend on each other beyond the class
                free = (np.abs((cov - np.outer(v, v)) / deviation) < 0.15) & ~np.eye(len(v), dtype=bool)
            said = v.copy()
            for i in range(len(v)):
                if turn >= 20:
                    w = free[i]
                    said[i] = (cov[i, w] @ v[w] + weight * known[i]) / (v[w] @ v[w] + weight)
                    continue
                # at first the weighted median of what the other voters say, which few correlated ones don't move
                w = free[i] & (np.abs(v) > 1e-9)
                votes, much = np.append(cov[i, w] / v[w], known[i]), np.append(v[w] ** 2, weight)
                order = np.argsort(votes)
                said[i] = votes[order[np.searchsorted(np.cumsum(much[order]), much.sum() / 2)]]
            v = (v + said) / 2
        gap = np.clip(v / max(scale, 1e-6), -1, 1)
        self.toxic = np.clip(mean + (1 - share) * gap, 1e-3, 1 - 1e-3)
        self.clean = np.clip(mean - share * gap, 1e-3, 1 - 1e-3)
        self.correlation = np.where(np.eye(len(v), dtype=bool), 0, (cov - np.outer(v, v)) / deviation)
        company = 1 + np.maximum(self.correlation, 0).sum(1)
        self.fires, self.silent = np.log(self.toxic / self.clean) / company, np.log((1 - self.toxic) / (1 - self.clean)) / company

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.share / (1 - self.share)) + votes @ (self.fires - self.silent) + self.silent.sum()
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Linear:
    """Logistic regression on known words and stems: of each, log(1 + count) and the same of its count in ``PER`` words."""

    def __init__(self, hashes: np.ndarray):
        self.known = Known(hashes)
        self.weights = np.zeros(2 * len(hashes))
        self.bias = -30.0

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and value of all that is not 0."""
        at, often = self.known.counts(data, off)
        size = max(len(self.known.hashes), 1)
        row, feature = at // size, at % size
        words = np.array([sum(len(word_bounds(low, part)[0]) for low, part in _parts(data[a:b], np.array([0, b - a]))) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        dense = np.log1p(often * PER / (words[row] + PER / 2))
        return np.concatenate([row, row]), np.concatenate([feature, feature + len(self.known.hashes)]), np.concatenate([np.log1p(often), dense])

    def fit(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Linear:
        """``label``: posterior of each text, ``weight``: how much it counts. Accelerated proximal steps on the log loss with the penalty ``SPARSE`` on weights, so that words that tell nothing have none."""
        n, m = len(label), len(self.weights)
        weight = weight / weight.sum()
        dot = lambda w, b: np.bincount(row, value * w[feature], n) + b
        back = lambda x: (np.bincount(feature, value * x[row], m), x.sum())
        rng = np.random.default_rng(13)
        w, b = rng.standard_normal(m), 1.0
        for _ in range(12):  # the steepest curvature, by power iteration
            size = np.sqrt((w * w).sum() + b * b)
            w, b = back(weight * dot(w / size, b / size))
        step = 1 / (0.25 * np.sqrt((w * w).sum() + b * b) + 1e-12)
        w, b = np.zeros(m), 0.0
        ahead, ahead_b, t = w, b, 1.0
        for _ in range(STEPS):
            g, gb = back(weight * (1 / (1 + np.exp(-np.clip(dot(ahead, ahead_b), -30, 30))) - label))
            new = ahead - step * g
            new, new_b = np.sign(new) * np.maximum(np.abs(new) - step * SPARSE, 0), ahead_b - step * gb
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead, ahead_b = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
            w, b = new, new_b
        self.weights, self.bias = w, b
        return self

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, feature, value = self.rows(data, off)
        odds = np.bincount(row, value * self.weights[feature], len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _labelled(docs: DataFrame, marked: DataFrame, each: int) -> DataFrame:
    """doc_id, label, text: of ``docs`` those of ``marked`` (doc_id, label) with least hashes, ``each`` of a label; of rows that share an id one."""
    picked = least_hashes(marked, "label", each)
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return materialise(rows.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")))


def _voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, votes (a byte each)."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in utf8_parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([v.tobytes() for v in shared.value.votes(data, off)], pa.binary())], names=["doc_id", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VOTERS)


def _moments(votes: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and in how many each two voters fire. A partial sum a batch; these are added by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOTERS, VOTERS))
        rows = 0
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float32)
            total += x.T @ x
            rows += len(x)
        cells = np.append(total.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["place", "n"])

    sums = votes.select("votes").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(VOTERS * VOTERS + 1)
    for r in sums:
        cells[r.place] = r.n
    return int(cells[-1]), cells[:-1].reshape(VOTERS, VOTERS)


def label_model(docs: DataFrame, labels: DataFrame) -> tuple[LabelModel, DataFrame] | None:
    """The label model and all votes (doc_id, votes) on ``docs`` (doc_id, text), or nothing without ``labels`` (doc_id, toxic) of both kinds."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    sample = _labelled(docs, marked, TRAIN)
    voters = Voters(associated(sample, ENTRIES, TIMES, 3))
    votes = materialise(_voted(docs, voters))
    n, both = _moments(votes)
    known = {}
    for label in (0, 1):
        m, fired = _moments(_voted(sample.where(F.col("label") == label), voters))
        known[label] = np.diag(fired) / max(m, 1)
    released(sample)
    share = counts[1] / (counts[0] + counts[1])
    return LabelModel(n, both, share, known[1] - known[0]), votes


def train(docs: DataFrame, labels: DataFrame, learned: DataFrame | None = None) -> Linear:
    """The classifier. ``learned`` (doc_id, text): those of ``docs`` whose posterior labels it learns from, all where it isn't given."""
    made = label_model(docs, labels)
    if made is None:
        return Linear(np.zeros(0, np.uint64))
    model, votes = made
    learned = docs if learned is None else learned

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = model.posterior(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array((q >= 0.5).astype(np.int32))], names=["doc_id", "q", "label"])

    believed = materialise(votes.mapInArrow(posteriors, "doc_id long, q double, label int").where("doc_id is not null").groupBy("doc_id").agg(F.max("q").alias("q"), F.max("label").alias("label")))
    released(votes)
    own = believed.join(learned.select("doc_id").distinct(), "doc_id", "left_semi")
    many = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    sample = _labelled(learned, own.select("doc_id", "label"), TEXTS)
    net = Linear(associated(sample, FEATURES, TELLING, 3))
    if not len(net.weights):
        return net

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in utf8_parts(batch.column(1)):
                row, feature, value = net.rows(data, off)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [np.stack([feature[a:b].astype(np.float32), value[a:b].astype(np.float32)]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(packed, pa.binary())], names=["doc_id", "counts"])

    rows = sample.select("doc_id", "text").mapInArrow(counted, "doc_id long, counts binary").join(believed, "doc_id").orderBy("doc_id").collect()
    released(believed)
    released(sample)
    parts = [np.frombuffer(r.counts, np.float32).reshape(2, -1) for r in rows]
    q = np.array([r.q for r in rows])
    hard = (q >= 0.5).astype(int)
    # a class that the sample has less of than all rows counts for more, up to even shares
    weight = np.array([max(many.get(k, 0), 1) for k in (0, 1)])[hard] ** 0.5 / np.bincount(hard, minlength=2)[hard]
    row = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
    both = np.concatenate(parts, axis=1)
    return net.fit(row, both[0].astype(np.int64), both[1].astype(np.float64), q, weight)


def score_toxicity(docs: DataFrame, net: Linear) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.probabilities(data, off) for _, _, data, off in utf8_parts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    net = train(docs, table(spark, sf_dir, "labels").where(~held_out()), docs.where(~held_out()))
    return score_toxicity(docs, net).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
