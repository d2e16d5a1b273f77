"""What is kept from row to row, cut at borders or grouped: transducer states, UTF-8, caches, step groups. No Spark."""

import random

import numpy as np
import pytest

pytest.importorskip("tallyforge.llm")

import public_tokenizers as P  # noqa: E402

from tallyforge.llm import bpe, packing  # noqa: E402


def test_utf8_machine_equals_the_codec_on_any_bytes_in_any_cut():
    rng = random.Random(1)
    odd = [65, 0x80, 0xBF, 0xC2, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2, 0x82, 0xAC]
    for _ in range(5000):
        data = bytes(rng.choice(odd) for _ in range(rng.randrange(14)))
        machine, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rng.randint(1, 4)
            out += machine.feed(data[at : at + step])
            at += step
        assert out + machine.close() == data.decode("utf-8", "replace")


def test_few_states_and_pieces_give_the_same_ids():
    whole, small = (bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN) for _ in range(2))
    small.machine.MOST_STATES, small.machine.MOST_PAIRS, small.KEEP = 3, 5, 2
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abcdeéß 12\n中日_") for _ in range(rng.randrange(40)))
        assert small.encode(t) == whole.encode(t)
    assert len(small.machine.paths) <= 4 and len(small.pieces) <= 2


@pytest.mark.parametrize(("states", "together", "block"), [(None, 1 << 22, 50_000), (None, 300, 7), (200, 1 << 22, 50_000), (40, 300, 5), (3, 300, 7)])
def test_texts_together_give_the_ids_of_each(states, together, block):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(path, P.PATTERN)
    own.TOGETHER, own.machine.BLOCK = together, block
    own.machine.MOST_STATES = states or own.machine.MOST_STATES
    rng = random.Random(4)
    alphabet = "abcde THE'sd\n\t  éÉ́ß12²½.,!?#  中日ΣσİÅ\x1c\x85\xa0-_😀가"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["", " ", "  ", "a ", " a", "x  y", "\n \n", "a\n b", "日本" * 400 + " a b", "a" * 2000, "", "  x \n  y z " * 60, "one two.\n" * 90, "same words same words", "same words same words"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts)]
    assert got == [lib.encode_ordinary(t) for t in texts]
    assert len(own.machine.paths) <= own.machine.MOST_STATES + 1
    assert list(own.encode_all([])) == [] and list(own.encode_all([""])) == [b""]


def test_transitions_made_together_are_those_made_one_by_one():
    one, many = (bpe.Transducer(bpe._load(None, None).ranks) for _ in range(2))
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 12))).encode() for _ in range(2000)]
    pieces[700:700], pieces[0:0] = [b"abc" * 200], [b"e" * 300]
    ids, counts = many.encode_all(pieces)
    want = [one.encode(x) for x in pieces]
    assert ids.tobytes() == b"".join(want) and counts.tolist() == [len(x) // 4 for x in want]

    def spelled(m):
        return {(m.paths[step >> 8], step & 255): (m.paths[to], m.last[to]) for step, to in m.step.items()}

    assert spelled(one) == spelled(many)


def test_new_words_of_many_texts_are_split_and_looked_up_together():
    own = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    split, whole, calls = own.split, own.machine.encode, {"split": 0, "encode": 0}

    def counted(name, f):
        def run(x):
            calls[name] += 1
            return f(x)

        return run

    own.split, own.machine.encode = counted("split", split), counted("encode", whole)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("aeiounrst") for _ in range(9)) + "." for _ in range(100)) for _ in range(40)]
    digests = getattr(own, "encode_all", lambda xs: map(own.encode, xs))
    assert len(list(digests(texts))) == 40
    assert calls["split"] <= len(texts) + 1 and calls["encode"] == 0


def test_long_pieces_are_not_kept():
    e = packing.WordEncoder(P.path("word_bpe_49k.json"))
    text = "x" * 5000 + " short " + "日" * 3000
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids
    assert max(map(len, e.known)) <= e.KEEP_BYTES
    b = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    b.encode("日本" * 2000 + " a b")
    assert max(map(len, b.pieces)) <= b.KEEP_CHARS


@pytest.mark.parametrize("longest", [300, 9000])
def test_step_groups_have_equal_token_counts(longest):
    rng = random.Random(3)
    packer = packing.Packer(0, pool_tokens=1 << 15)
    rows, lengths = [], {}
    for doc in range(900):
        n = rng.randint(1, longest if doc % 7 == 0 else 200)
        lengths[doc] = n
        rows += packer.add(doc, np.full(n, doc, "<u4").tobytes())
    rows += packer.close()
    groups, sequences, seen = {}, {}, {}
    for doc, start, length, _, _, sequence, offset, tier, group in rows:
        groups[group] = groups.get(group, 0) + length
        sequences.setdefault(sequence, []).append((offset, length, tier, group))
        seen.setdefault(doc, []).append((start, length))
    for pieces in sequences.values():
        assert sum(n for _, n, _, _ in pieces) == pieces[0][2] and len({g for *_, g in pieces}) == 1
    assert all(sum(n for _, n in sorted(parts)) == lengths[d] for d, parts in seen.items()) and len(seen) == len(lengths)
    assert sorted(groups.values())[1:] == [packing.STEP_TOKENS] * (len(groups) - 1)
