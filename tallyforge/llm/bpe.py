"""Byte-level BPE by a finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges give for its bytes exactly when each two
neighbours are what the merges give for the two together. That makes a nondeterministic
transducer: read a token's bytes down the vocabulary's trie, emit it, go on with any token
that may follow. ``Transducer`` determinises it lazily: a state is the set of the paths that
are still possible; a transition is computed when a byte is first read in a state and kept.
The bytes read so far have one sequence of tokens, so of a state's paths one alone stands
between tokens, and the state's output is that path's last token. Read back from the end,
each output tells its token and, by the token's length, where the next to read stands.

Cases: null and empty texts have no ids; a text is encoded whole however long it is; equal
rows are encoded each for itself; no rows give no rows; other columns are not read. Ids
that do not decode to UTF-8 give U+FFFD for each maximal invalid part. All that is kept from
text to text (states, pieces, chunks) is bounded in number and in the bytes of each. Texts
are encoded together up to a bound of characters; a longer one is cut where no piece crosses.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Transducer:
    """Bytes to token ids by the merge ranks; ``encode`` runs over one piece of text, ``encode_all`` over many in step."""

    #: States, and pairs of tokens, that are kept; beyond that the machine forgets all but the states that it is in.
    MOST_STATES, MOST_PAIRS = 200_000, 1_000_000
    #: Pieces that are read in step, and the bytes of the longest.
    BLOCK, IN_STEP = 50_000, 256

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = np.zeros(1 + max(ranks.values()), np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.child: dict[int, int] = {}
        #: By node: the token that ends there or -1, and whether longer ones go on.
        self.ends, self.inner = [-1], [False]
        self.pairs: dict[int, bool] = {}
        self.joined: dict[int, tuple[int, int] | None] = {}
        self.made: dict[int, bool] = {}
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.ends[node] = rank
        self.edges = np.array(sorted(self.child), np.int64)
        self.heads = np.array([self.child[x] for x in self.edges.tolist()], np.int64)
        self.end_of, self.goes_on = np.array(self.ends, np.int64), np.array(self.inner)
        #: A state: paths (1 + the last token, or 0, above 32 bits of the trie node), the one between tokens last; its output.
        self.number: dict[tuple[int, ...], int] = {}
        self.paths: list[tuple[int, ...]] = []
        self.last: list[int] = []
        self.step: dict[int, int] = {}
        self.restart()

    def restart(self, *keep: tuple[int, ...]) -> None:
        """Forget all states but the first, and ``keep``, which follows it."""
        for known in (self.number, self.paths, self.last, self.step):
            known.clear()
        self.paths += [(0,), *keep]
        self.last += [(paths[-1] >> 32) - 1 for paths in self.paths]
        self.number.update((paths, k) for k, paths in enumerate(self.paths))

    def merge(self, data: bytes) -> list[int]:
        """The ids by merging the pair of lowest rank, leftmost first, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this one joins; none for a byte or a token that merging its bytes doesn't give."""
        if token not in self.joined:
            parts, last = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))], None
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                last = self.ranks[parts[at]], self.ranks[parts[at + 1]]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.joined[token] = last if len(parts) == 1 else None
            self.made[token] = len(parts) == 1
        return self.joined[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two.

        Each was built by merges of falling rank as seen from outside in; the two would have been joined otherwise if
        at some time the parts that then met at the border made a token of lower rank than the merges that came next.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.MOST_PAIRS:
                self.pairs.clear()
            self.halves(right)
            known = self.made[right] and (left < 0 or self.kept_apart(left, right))
            self.pairs[key] = known
        return known

    def kept_apart(self, left: int, right: int) -> bool:
        spelled, ranks, bound = self.tokens, self.ranks, 1 << 60
        while True:
            if ranks.get(spelled[left] + spelled[right], 1 << 60) < bound:
                return False
            inner, outer = self.halves(left), self.halves(right)
            if inner and (left > right or not outer):
                bound, left = left, inner[1]
            elif outer:
                bound, right = right + 1, outer[0]
            else:
                return True

    def advance(self, state: int, byte: int) -> int:
        after, done, child, ends, inner, pairs = [], -1, self.child, self.ends, self.inner, self.pairs
        for path in self.paths[state]:
            node = path & 0xFFFFFFFF
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            if inner[nxt]:
                after.append(path - node + nxt)
            token = ends[nxt]
            if token >= 0 > done:
                last = (path >> 32) - 1
                fits = pairs.get(last << 20 | token)
                if fits or fits is None and self.may_follow(last, token):
                    done = token
        return self.reached(state << 8 | byte, (*after, done + 1 << 32), done)

    def advance_all(self, steps: list[int]) -> None:
        """``advance`` for pairs of a state (above 8 bits) and a byte, none of them known, all at once."""
        states = [self.paths[step >> 8] for step in steps]
        sizes = np.fromiter(map(len, states), np.int64, len(states))
        path, owner = np.fromiter(chain.from_iterable(states), np.int64, int(sizes.sum())), np.repeat(np.arange(len(states)), sizes)
        node = path & 0xFFFFFFFF
        edge = node << 8 | (np.array(steps, np.int64) & 255)[owner]
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        goes = self.edges[at] == edge
        path, owner, node = (path - node)[goes], owner[goes], self.heads[at[goes]]
        token, pairs, done = self.end_of[node], self.pairs, [-1] * len(steps)
        may_end = token >= 0
        for k, last, right in zip(owner[may_end].tolist(), ((path[may_end] >> 32) - 1).tolist(), token[may_end].tolist()):
            if done[k] < 0:
                fits = pairs.get(last << 20 | right)
                if fits or fits is None and self.may_follow(last, right):
                    done[k] = right
        on = self.goes_on[node]
        after, start = (path + node)[on].tolist(), 0
        for step, last, end in zip(steps, done, np.cumsum(np.bincount(owner[on], minlength=len(steps))).tolist()):
            self.reached(step, (*after[start:end], last + 1 << 32), last)
            start = end

    def reached(self, step: int, key: tuple[int, ...], done: int) -> int:
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.paths)
            self.paths.append(key)
            self.last.append(done)
        self.step[step] = number
        return number

    def encode(self, data: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        state, told, step, last = 0, [], self.step, self.last
        for byte in data:
            known = step.get(state << 8 | byte)
            if known is None:
                if len(self.paths) >= self.MOST_STATES and state:
                    self.restart(self.paths[state])
                    state = 1
                known = self.advance(state, byte)
            state = known
            told.append(last[state])
        out, at, spelled = [], len(told), self.tokens
        while at:
            token = told[at - 1]
            out.append(token)
            at -= len(spelled[token])
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids that ``encode`` gives for pieces of a byte or more, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        block = min(self.BLOCK, self.MOST_STATES // 4)
        short = np.flatnonzero(lengths <= self.IN_STEP) if block else np.zeros(0, np.int64)
        alone = np.setdiff1d(np.arange(len(pieces)), short)
        out, counts = [np.zeros(0, "<u4")], np.zeros(len(pieces), np.int64)
        for first in range(0, len(short), block or 1):
            part = short[first : first + block]
            found, counts[part] = self.encode_block([pieces[k] for k in part.tolist()], lengths[part])
            out.append(found)
        for k in alone.tolist():
            out.append(np.frombuffer(self.encode(pieces[k]), "<u4"))
            counts[k] = len(out[-1])
        ids = np.concatenate(out)
        if not len(alone):
            return ids, counts
        done = np.append(short, alone)
        starts = np.empty(len(pieces), np.int64)
        starts[done] = np.cumsum(counts[done]) - counts[done]
        return runs(ids, starts, counts), counts

    def encode_block(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in step: at each place, the transitions of all pieces are looked up once each."""
        order = np.argsort(-lengths, kind="stable")
        data, starts, lengths = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(lengths) - lengths)[order], lengths[order]
        state = np.zeros(len(pieces), np.int64)
        told = np.empty((int(lengths[0]), len(pieces)), np.int32)
        for k in range(len(told)):
            live = int(np.searchsorted(-lengths, -k))  # the longer ones come first
            if len(self.paths) + live > self.MOST_STATES:
                kept, at = np.unique(state[:live], return_inverse=True)
                self.restart(*[self.paths[x] for x in kept.tolist() if x])
                state[:live] = at + 1 if k else 0
            keys, at = np.unique(state[:live] << 8 | data[starts[:live] + k], return_inverse=True)
            steps = keys.tolist()
            new = [x for x in steps if x not in self.step]
            if new:
                self.advance_all(new)
            after = list(map(self.step.__getitem__, steps))
            state[:live] = np.array(after, np.int64)[at]
            told[k, :live] = np.array([self.last[x] for x in after], np.int32)[at]
        back, rows, left, counts = [], np.arange(len(pieces)), lengths.copy(), np.zeros(len(pieces), np.int64)
        while len(rows):
            tokens = told[left[rows] - 1, rows]
            back.append((order[rows], tokens))
            counts[order[rows]] += 1
            left[rows] -= self.lengths[tokens]
            rows = rows[left[rows] > 0]
        ends = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), "<u4")
        for k, (rows, tokens) in enumerate(back, 1):
            ids[ends[rows] - k] = tokens
        return ids, counts


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from each start on, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class ByteBpe:
    """A vocabulary of ranks, with the pattern that splits a text first."""

    #: Pieces and chunks that are kept, and the characters of the longest.
    KEEP, KEEP_CHARS = 300_000, 48
    #: Characters of the texts that are encoded together, and of the parts that a longer one is cut into.
    TOGETHER = 1 << 22

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.machine = Transducer(self.ranks)
        self.size = 1 + max(self.ranks.values())
        self.spelled = [self.machine.tokens.get(i, b"") for i in range(self.size)]
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        #: White space within a run where cutting before a space would change the pieces.
        self.uneven = re.compile(r"\s (?:\s|\Z)").search
        self.border = re.compile(r"(?<=\S) (?=\S)").search
        codec = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                data = piece.encode()
                rank = codec.ranks.get(data)
                return codec.keep(self, piece, codec.machine.encode(data) if rank is None else rank.to_bytes(4, "little"))

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                return codec.keep(self, chunk, b"".join(map(pieces.__getitem__, codec.split(f" {chunk}"))))

        self.pieces = pieces = Pieces()
        self.chunks = Chunks()

    def keep(self, known: dict[str, bytes], text: str, ids: bytes) -> bytes:
        if len(text) <= self.KEEP_CHARS:
            if len(known) >= self.KEEP:
                known.clear()
            known[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. A text is cut before its spaces, where the pattern cuts too, so that each chunk is split and encoded once."""
        if self.uneven(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, self.split(first)), *map(self.chunks.__getitem__, rest)])

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """What ``encode`` gives for each; many texts are taken together, so that what occurs in them is split and encoded once, and nothing of it is kept."""
        group, chars = [], 0
        for text in texts:
            if len(text) > self.TOGETHER:
                yield from self.encode_group(group)
                group, chars = [], 0
                yield b"".join(self.encode_group([part])[0] for part in self.parts(text))
                continue
            group.append(text)
            chars += len(text)
            if chars >= self.TOGETHER:
                yield from self.encode_group(group)
                group, chars = [], 0
        yield from self.encode_group(group)

    def parts(self, text: str) -> Iterator[str]:
        """A long text, cut before spaces that stand alone between other characters than white space: no piece crosses one."""
        start = 0
        while len(text) - start > self.TOGETHER and (border := self.border(text, start + self.TOGETHER)):
            yield text[start : border.start()]
            start = border.start()
        yield text[start:]

    def encode_group(self, texts: list[str]) -> list[bytes]:
        firsts, rests = [], []
        for text in texts:
            first, space, rest = (text, "", "") if self.uneven(text) else text.partition(" ")
            firsts.append(first)
            rests.append(rest if space else None)
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        n_chunks = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        # A chunk without white space at its ends is split with others: a space before it begins its first piece, and no other piece has one.
        inside = np.fromiter((c == c.strip() != "" for c in chunks), bool, len(chunks))
        found = self.split("".join(f" {c}" for c in compress(chunks, inside)))
        begins = pc.starts_with(pa.array(found, pa.large_string()), " ").to_numpy(zero_copy_only=False)
        n_pieces = np.diff(np.append(np.flatnonzero(begins), len(found)))
        unit = np.empty(len(chunks), np.int64)
        unit[inside] = np.arange(inside.sum())
        unit[~inside] = np.arange(inside.sum(), len(chunks))
        apart = [self.split(x) for x in (*(f" {c}" for c in compress(chunks, ~inside)), *firsts)]
        found += chain.from_iterable(apart)
        n_pieces = np.append(n_pieces, np.fromiter(map(len, apart), np.int64, len(apart)))

        ids, counts = self.encode_pieces(pa.array(found, pa.large_string()))
        per_unit = np.diff(np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(n_pieces))])
        # Each text: the unit of its first chunk, then those of the others.
        order = np.empty(len(texts) + len(coded), np.int64)
        at = np.cumsum(n_chunks) - n_chunks + np.arange(len(texts))
        other = np.ones(len(order), bool)
        other[at] = False
        order[at] = len(chunks) + np.arange(len(texts))
        order[other] = unit[coded.indices.to_numpy()]
        sizes = per_unit[order]
        raw = memoryview(runs(ids, (np.cumsum(per_unit) - per_unit)[order], sizes)).cast("B")
        ends = 4 * np.append(0, np.cumsum(sizes))[np.append(at, len(order))]
        return [bytes(raw[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        coded = pieces.dictionary_encode()
        data = list(map(str.encode, coded.dictionary.to_pylist()))
        ranks = np.fromiter((self.ranks.get(x, -1) for x in data), np.int64, len(data))
        ids, counts = self.machine.encode_all([x for x, r in zip(data, ranks.tolist()) if r < 0])
        sizes = np.ones(len(data), np.int64)
        sizes[ranks < 0] = counts
        starts = np.cumsum(sizes) - sizes
        distinct = np.empty(int(sizes.sum()), "<u4")
        whole = np.zeros(len(distinct), bool)
        whole[starts[ranks >= 0]] = True
        distinct[whole] = ranks[ranks >= 0]
        distinct[~whole] = ids
        codes = coded.indices.to_numpy()
        return runs(distinct, starts[codes], sizes[codes]), sizes[codes]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Text of parts of a sequence of ids, each as soon as its characters are whole."""
        machine = Utf8Stream()
        for part in parts:
            yield machine.feed(self.decode_bytes(part))
        yield machine.close()


def _utf8_table() -> np.ndarray:
    """Next state by state and byte. 0: between characters; 1 to 3: so many continuation bytes to come; 4 to 7: the second
    byte after E0, ED, F0, F4; 8: invalid."""
    t = np.full((8, 256), 8, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0] = 1
    t[0, 0xE0:0xF0] = 2
    t[0, 0xF0:0xF5] = 3
    t[0, [0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    for state in (1, 2, 3):
        t[state, 0x80:0xC0] = state - 1
    t[4, 0xA0:0xC0] = t[5, 0x80:0xA0] = 1
    t[6, 0x90:0xC0] = t[7, 0x80:0x90] = 2
    return t


class Utf8Stream:
    """Incremental UTF-8: bytes in any cut, text out, with at most three bytes held back.

    ASCII stands between characters in any state, so the machine runs over the bytes beyond it, each distinct run of them once.
    """

    TABLE = [row.tolist() for row in _utf8_table()]
    RUNS = re.compile(rb"[\x80-\xff]+")

    @staticmethod
    @functools.lru_cache(4096)
    def after(run: bytes) -> int:
        """The machine's state after a run."""
        state = 0
        for byte in run:
            state = Utf8Stream.TABLE[state][byte]
            if state == 8:
                break
        return state

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        """The characters that are whole by now; each longest part that can't be one is U+FFFD."""
        data = self.held + data
        self.held = b""
        if data.isascii():
            return data.decode("ascii")
        runs = self.RUNS.findall(data)
        last = runs.pop() if data[-1] >= 0x80 else b""
        if self.after(last) < 8 and not any(map(self.after, set(runs))):
            if self.after(last):
                start = max(last.rfind(lead) for lead in self.LEADS if lead in last[-3:])
                self.held = last[start:]
            return data[: len(data) - len(self.held)].decode("utf-8")
        return self.repaired(data)

    #: Bytes that begin a character of several.
    LEADS = [bytes([x]) for x in range(0xC2, 0xF5)]

    def repaired(self, data: bytes) -> str:
        out, at = [], 0
        for run in self.RUNS.finditer(data):
            start, end = run.span()
            out.append(data[at:start].decode("ascii"))
            at = end
            state, whole = 0, start  # all before ``whole`` is put out; the character that is open begins at ``start``
            k = start
            while k < end:
                state, before = self.TABLE[state][data[k]], state
                if not state:
                    start = k = k + 1
                elif state < 8:
                    k += 1
                else:  # what is open by now is no character, nor is this byte, if nothing is
                    out += (data[whole:start].decode("utf-8"), "\ufffd")
                    k += not before
                    whole = start = k
                    state = 0
            out.append(data[whole:start].decode("utf-8"))
            if state:
                if end == len(data):
                    self.held = data[start:]
                else:
                    out.append("\ufffd")
        out.append(data[at:].decode("ascii"))
        return "".join(out)

    def close(self) -> str:
        """The end of the bytes: what is held back can't become a character any more."""
        held, self.held = self.held, b""
        return "\ufffd" if held else ""


@functools.cache
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with their ids (binary, little-endian unsigned 32 bits) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                ids = list(bpe.encode_all(t.as_py() or "" for t in rows.column(1)))
                texts = ["".join(bpe.decode_stream(x[i : i + 16384] for i in range(0, len(x), 16384))) for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def _load(path: str | None, pattern: str | None) -> ByteBpe:
    import public_tokenizers

    return codec(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Count of ids, and hashes of the ids and of the bytes that they decode to, made beside the text so that ids need not be carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_all(text.as_py() or "" for text in batch.column(1)):
                decoded = hashlib.sha256()
                machine = Utf8Stream()
                for i in range(0, len(ids), 1 << 16):
                    decoded.update(machine.feed(bpe.decode_bytes(ids[i : i + (1 << 16)])).encode())
                decoded.update(machine.close().encode())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
