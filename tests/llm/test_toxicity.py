"""Voters, label model and classifier on small tables, and held-out accuracy on planted and given ones."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("tallyforge.llm")

from pyspark.sql import functions as F  # noqa: E402

from tallyforge.llm import toxicity as tox  # noqa: E402
from tallyforge.llm.langid import held_out  # noqa: E402


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_words_and_stems_by_the_text_as_it_stands():
    texts = ["ÉTÉ d'Hiver, idiots!", "", "a1bcdefgh été", "x"]
    data, off = buffers(texts)
    low = tox.letters(data)
    for size, (h, owner) in zip(tox.STEMS, tox.features(low, off), strict=True):
        want = []
        for i, t in enumerate(texts):
            for w in re.findall("[a-zÀ-ÿ]+", t.lower()):
                raw = w.encode()
                if not size or len(raw) > size:
                    want.append((i, raw[:size] if size else raw))
        assert owner.tolist() == [i for i, _ in want]
        by = {}
        for key, value in zip([w for _, w in want], h.tolist(), strict=True):
            assert by.setdefault(key, value) == value
        assert len(set(by.values())) == len(by)


def test_counts_of_a_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["stupid", "stupidity", "été", "b"]) for _ in range(500))
    data, off = buffers([text])
    entries = np.unique(np.concatenate([h for h, _ in tox.features(tox.letters(data), off)]))
    whole = [x.tolist() for x in tox.Known(entries).counts(data, off)]
    monkeypatch.setattr(tox, "PIECE", 64)
    assert [x.tolist() for x in tox.Known(entries).counts(data, off)] == whole


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    n, share = 40_000, 0.1
    y = rng.random(n) < share
    a, b = np.array([0.7, 0.5, 0.6, 0.8, 0.3, 0.5]), np.array([0.02, 0.01, 0.05, 0.1, 0.0, 0.5])
    votes = (rng.random((n, 6)) < np.where(y[:, None], a, b)).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # a voter that repeats the first
    model = tox.LabelModel(n, votes.T @ votes, share, np.append(a - b, a[0] - b[0]) * 0.6)
    assert np.abs(model.toxic[:6] - a).max() < 0.1 and np.abs(model.clean[:6] - b).max() < 0.03
    assert model.correlation[0, 6] > 0.4 and np.abs(model.correlation[1:6, 1:6]).max() < 0.1
    assert model.fires[0] < 0.8 * np.log(model.toxic[0] / model.clean[0])  # two that are one share their weight
    q = model.posterior(votes)
    assert ((q >= 0.5) == y).mean() > 0.96


def planted(spark, n=500):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeilmnorstué") for _ in range(rng.randrange(3, 9)))
    usual = [word() for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = rng.choices(usual, k=rng.randrange(20, 200))
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["Zorgak", "zorgakste", "zorgakkend", "vilmuk", "VILMUKS!"])
        rows.append((i, " ".join(words), "xx", 1))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, label int").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_of_planted_stems(spark):
    docs, labels = planted(spark)
    net = tox.train(docs.select("doc_id", "text"), labels.where(~held_out()), docs.where(~held_out()).select("doc_id", "text"))
    got = {r.doc_id: r.score for r in tox.score_toxicity(docs, net).collect()}
    assert len(got) == 500
    wrong = [i for i, s in got.items() if (s >= tox.TOXIC) != (i % 6 == 0)]
    assert len(wrong) <= 5


def test_cases_and_a_plain_score(spark):
    docs, labels = planted(spark, 200)
    net = tox.train(docs.select("doc_id", "text"), labels)
    long = "zorgak " + "ma " * 400_000
    more = [(1000, None), (1001, ""), (1002, "  \n"), (None, "zorgak vilmuk"), (1003, "zorgak vilmuk"), (1003, "zorgak vilmuk"), (1004, long)]
    got = tox.score_toxicity(spark.createDataFrame([(*r, 1, "x") for r in more], "doc_id long, text string, label int, score string"), net).collect()
    assert len(got) == len(more) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1002] < 0.5 and by[None] == by[1003]
    # the same by words of the text
    for text in ("zorgak vilmuk", "Zorgakste été", ""):
        words = [w.encode() for w in re.findall("[a-zÀ-ÿ]+", text.lower())]
        counts = {}
        for w in words:
            for size in tox.STEMS:
                if not size or len(w) > size:
                    raw = np.frombuffer(w[:size] if size else w, np.uint8)
                    h = tox._HASHER.words(raw, np.array([0]), np.array([len(raw)]))
                    h = tox.mix(h + np.uint64(size)) if size else h
                    counts[int(h[0])] = counts.get(int(h[0]), 0) + 1
        odds = net.bias
        for k, h in enumerate(net.known.hashes.tolist()):
            if h in counts:
                odds += np.log1p(counts[h]) * net.weights[k] + np.log1p(counts[h] * tox.PER / (len(words) + tox.PER / 2)) * net.weights[k + len(net.known.hashes)]
        assert net.probabilities(*buffers([text]))[0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 1)]])
def test_without_labels_of_both_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    net = tox.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.score for r in tox.score_toxicity(docs, net).collect()] == pytest.approx([0, 0], abs=1e-9)
    assert tox.score_toxicity(docs.limit(0), net).count() == 0


def test_held_out_rows_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    got = tox.op13_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    by = {r.toxic: r.p for r in got}
    assert by[0] <= 0.05 and by[1] >= 0.75
