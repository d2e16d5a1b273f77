"""Each operator on small tables with nulls, empty and very long texts, ties, repeated rows, no rows and extra columns."""

import base64
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("tallyforge.llm")
sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from tallyforge.llm import bpe, html, minhash, packing, pii, spotsigs, substring, topk  # noqa: E402

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Ábc", "x1", "longer", "ende,", "è", "日本"])
    base = [" ".join(f"{word()}{rng.randrange(50)}" for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    near = [b.replace("x1", "y1", 1) + " tail" for b in base[:8]]
    passage = " ".join(f"p{i}" for i in range(60))
    shared = [f"{b} {passage} {rng.random()}" for b in base[:5]]
    return [None, "", "  \n", "one", "a b c d", "a b c d", LONG, LONG + " end", *base, *base[:4], *near, *shared]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i + 1, t, "en", "s", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, d1 string, twin string, component int").repartition(3)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_packing(docs, pairs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = packing.pack_documents(docs, packing.word_bpe())
    got = [tuple(r)[:7] for r in out.collect()]
    assert not brute.packing_faults(dict(pairs), got, lambda t: tk.encode(t, add_special_tokens=False).ids)
    sums = {}
    for r in got:
        sums[r[5]] = sums.get(r[5], 0) + r[2]
    assert all(n & (n - 1) == 0 for n in sums.values())
    assert packing.pack_documents(docs.where("false"), packing.word_bpe()).count() == 0


def test_word_ids_equal_the_library():
    import public_tokenizers as P

    e = packing.WordEncoder(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = "abcde THE'sd\n\t  éÉ́ß12²½.,!?#  中日ΣσİÅ\x1c\x85-_<|endoftext|>😀가"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_bpe(docs, pairs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    alphabet = "abcde THE'sd\n\t  éÉ́ß12²½.,!?#  中日ΣσİÅ\x1c\x85-_😀가"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert "".join(own.decode_stream(ids[i : i + 4] for i in range(0, len(ids), 4))) == t
    want = [(d, len(x := lib.encode_ordinary(t or "")), brute.sha(np.array(x, "<u4").tobytes()), brute.sha((t or "").encode())) for d, t in pairs]
    assert rows(bpe.digest_documents(docs)) == sorted(want)


def test_broken_utf8_streams():
    for data in (b"\xe4\xb8", b"a\xffb", b"\xf0\x9f\x98\x80\xe4\xb8\xad\xc3", b"\xed\xa0\x80x", b"\xe0\x80"):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(bytes([b])) for b in data) + s.close() == data.decode("utf-8", "replace")


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = {i: rng.integers(-4, 4, 3).tolist() for i in range(150)} | {200 + i: [1, 1, 1] for i in range(40)}
    table = spark.createDataFrame(list(v.items()), "id long, v array<long>").repartition(3)
    assert rows(topk.top_k(table, table.where("id % 50 = 0"), 5)) == sorted(brute.top_k(v, [i for i in v if i % 50 == 0], 5))
    few = table.where("id < 3")
    assert rows(topk.top_k(few, few, 5)) == sorted(brute.top_k({i: v[i] for i in range(3)}, [0, 1, 2], 5))
    assert topk.top_k(table.where("false"), table.where("false"), 5).count() == 0


def test_top_k_query_leaves_out_broken_vectors(spark, tmp_path):
    rows_ = [(0, [0.5, 0.25]), (1, [0.1, None]), (2, None), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [-0.1, 0.3]), (50, [0.2, 0.2])]
    spark.createDataFrame(rows_, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in topk.op2_topk(spark, str(tmp_path)).collect()}
    assert got == {(0, 5), (0, 50), (50, 0), (50, 5)}


@pytest.mark.parametrize("length", [2, 13, 50])
def test_substrings(docs, pairs, length):
    assert rows(substring.removed_digests(docs, length)) == sorted(brute.substrings(pairs, length))
    kept = {r.doc_id: r.text for r in substring.dedup_substrings(docs, length).collect()}
    for d, n, gone, sha in brute.substrings(pairs, length):
        assert (d not in kept) == (gone == n > 0)
        assert not gone or d not in kept or brute.sha(kept[d].encode()) == sha
    assert substring.removed_digests(docs.where("false")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, pairs, percent):
    assert rows(minhash.near_duplicates(docs, percent)) == sorted(brute.near(pairs, percent))
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_across_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(80)]
    made = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"n{rng.random()}"
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(minhash.near_duplicates(df)) == sorted(brute.near(made, 85))


def test_html():
    page = """<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First <a href=x>link</a> and
      more words here.</p><p>End.</p><form><p>Mail</p></form></article><div class="comments"><p>I think this is a long comment by some reader.</p></div><footer><p>&copy; 2020</p></footer><foo"""
    assert html.main_text(page) == "A & B\nFirst link and more words here.\nEnd."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""


def test_spotsigs(spark, docs, pairs):
    out = spotsigs.with_signatures(docs.select("doc_id", "text"), "text", "sigs").collect()
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text or "", r.sigs) == r.sigs == sorted(set(r.sigs))
    found = {(r.a, r.b) for r in spotsigs.similar_documents(docs, 0.6).collect()}
    ones = {}
    for r in sorted(out, key=lambda r: r.doc_id):
        if r.sigs:
            ones.setdefault(tuple(r.sigs), r.doc_id)
    sets = [(d, set(s)) for s, d in ones.items()]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) / len(x | y) >= 0.6}
    assert found == want


def test_pii(spark):
    said = [
        (1, "Mail ann.34@mail7.example.com or +1 (017) 555-7713.", "k"), (2, "Again ann.34@mail7.example.com from 10.2.33.4", "k"), (3, None, "k"), (4, "", "k"),
        (5, "4111 1111 1111 1111 but not 4111111111111112", "k"), (6, "Mrs. Smith met Mr. Smith", "k"), (7, "nothing here", "k"), (8, 'token = "' + "0a" * 20 + '"', "k"),
    ]
    out = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(said, "doc_id long, text string, value string"), "key").collect()}
    assert out[3].text is None and out[4].text == "" and out[7].text == "nothing here" and out[7].n_entities == 0
    first, second = (out[i].text.split()[1] for i in (1, 2))
    assert first == second != "ann.34@mail7.example.com" and "@" in first and "example." in first
    assert "4111111111111112" in out[5].text and "4111 1111 1111 1111" not in out[5].text and out[5].n_entities == 1
    names = out[6].text.split()
    assert names[0] == "Mrs." and names[3] == "Mr." and "Smith" not in out[6].text
    assert len(out[8].text) == len(said[7][1]) and "0a" * 20 not in out[8].text
