"""Spelling variants against every pair of words compared, with places cut into parts and chains of forms."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm import spelling  # noqa: E402

SCHEMA = "doc_id long, text string, word int, place string, root string"


def edits(w, letters):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    letters = {c for w in n for c in w}
    near = {w: sorted((edits(w, letters) & n.keys()) - {w}, key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "p", "r") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_equals_every_pair(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdeéü") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    words = [w for b in base for w in [b] * rng.randrange(3, 40) + [rng.choice(sorted(edits(b, "abé"))) for _ in range(30)]]
    chain = ["aaaaaa"] * 400 + ["aaaaab"] * 100 + ["aaaabb"] * 30 + ["aaabbb"] * 10 + ["aabbbb"] * 3 + ["Öffne", "öffne"] * 5
    words += chain
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "_1\n"]).join(w.capitalize() if rng.random() < 0.2 else w for w in words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))]
    rows += [(None, "abcde abcde abcde"), (1, None), (2, ""), (3, "  "), rows[0], rows[0]]
    want = brute(rows)
    assert got(spark, rows) == want
    assert any(w[2] not in (w[0], w[1]) for w in want)  # a chain of forms


def test_a_place_cut_into_parts(spark, monkeypatch):
    """Anagrams share a cell, here more than a part holds."""
    monkeypatch.setattr(spelling, "PART", 20)
    rng = random.Random(3)
    words = sorted({"".join(rng.sample("abcabcdd", 8)) for _ in range(150)} | {"".join(rng.sample("abcabcd", 7)) for _ in range(100)})
    rows = [(i, " ".join([w] * rng.randrange(3, 9))) for i, w in enumerate(words)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "ab ab ab")], [(1, "x" * 70_000 + " " + ("y" * 300 + " ") * 3 + ("y" * 301 + " ") * 7 + ("y" * 80 + "z ") * 3 + ("y" * 81 + " ") * 9)],
                                  [(1, ("a" * 256 + "b" * 3 + " ") * 3 + ("a" * 256 + "bbj ") * 9 + ("a" * 256 + "bbbc ") * 4)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_a_long_text_is_cut_between_words(spark, monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "alphas", "betas", "é" * 9, "gamma" * 5]) for _ in range(3000))
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert "".join(spelling._pieces(text)) == text
    assert Counter(w for p in spelling._pieces(text) for w in re.findall("[a-zé]+", p)) == Counter(text.split())


def test_edits_word_by_word():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7, 70, 71]))) for _ in range(300)]
    words = sorted(set(words), key=len)
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if len(words[j]) - len(words[i]) < 2]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    said = spelling._edits([w.encode() for w in words], i, j)
    assert said.tolist() == [words[b] in edits(words[a], "ab") for a, b in pairs]
