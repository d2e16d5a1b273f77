"""The manifest against trees built level by level, on tables with nulls, repeated rows, one row and several stages."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("tallyforge.llm")

from pyspark.sql import functions as F  # noqa: E402

from tallyforge.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp int, rank string, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for g in langs:
        for i, r in enumerate(groups[g]):
            proof, hit = [], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for tree, at in ((trees[g], i), (top, langs.index(g))):
                for level in tree[:-1]:
                    pair = level[at & ~1 : (at & ~1) + 2]
                    other = [x for k, x in enumerate(pair, at & ~1) if k != at]
                    proof += other
                    node = sha(*([*other, node] if at & 1 else [node, *other]))
                    at >>= 1
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]) if n > 3 else i, rng.choice(["s", None, "ü"]), rng.choice(["en", "en", None, "é", "zh"]), rng.choice([None, 5, -7]), rng.choice([None, "", "x" * 9, "日本語"])) for i in range(n)]
    return rows + rows[: n // 5]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 60])
@pytest.mark.parametrize("bits", [1, 3, 12])
def test_equals_trees_level_by_level(spark, n, bits):
    rows = rows_of(n)
    docs = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA).repartition(3)
    assert sorted(_manifest(docs, bits), key=repr) == brute(rows)


def _manifest(docs, bits):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, tampered, bits).collect()
    return [tuple(r)[:7] for r in out]


def postorder(n):
    """(level, index) in the order in which nodes are complete, then the right edge."""
    out = []
    for r in range(n):
        out.append((0, r))
        level = 1
        while (r + 1) % (1 << level) == 0 and (1 << level) <= 1 << merkle.height(n):
            out.append((level, r >> level))
            level += 1
    return out + [(h, n >> h) for h in range(1, merkle.height(n) + 1) if n % (1 << h)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 11, 16, 37, 64, 100])
def test_positions_in_closed_form(n):
    order = postorder(n)
    assert [merkle.log_position(n, level, i) for level, i in order] == list(range(len(order)))
    nodes = merkle.segment_nodes([sha(str(i)).encode() for i in range(n)], merkle.height(n))
    tree = levels([sha(str(i)) for i in range(n)])
    assert [x.decode() for x in nodes] == [tree[level][i] for level, i in order]


@pytest.mark.parametrize("n", [1, 5, 8, 37])
def test_the_log_is_gapless(spark, n):
    leaves = spark.createDataFrame([("g", sha(str(i)), i, None) for i in range(n)], "grp string, digest string, doc_id long, tampered string").repartition(2)
    stages = merkle.build(merkle.ranked(leaves, "grp", ["doc_id"]), 2)
    got = merkle.append_log(stages, 2).orderBy("position").collect()
    tree = levels([sha(str(i)) for i in range(n)])
    assert [(r["level"], r["index"]) for r in got] == postorder(n)
    assert [r.position for r in got] == list(range(len(got)))
    assert all(r.digest == tree[r["level"]][r["index"]] for r in got)


def test_a_very_long_text(spark):
    rows = [(1, "s", "en", 3, "ab " * 700_000), (2, "s", "en", 3, "b")]
    assert sorted(_manifest(spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA), 12), key=repr) == brute(rows)
