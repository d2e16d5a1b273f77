"""Hierarchical multi-length packing.

A document's token ids are routed by length to context tiers (256, 512, 1024, 2048).
Whole windows of the longest tier leave a long document at once; what is left of it
waits in the pool of the smallest tier that holds it. A tier is packed longest piece
first, and the gap behind each piece is filled from shorter pieces: best fit while
one fits, then the head of a short piece, whose rest goes back to its pool. So a
sequence is as long as its tier, a power of two, and needs no padding; only the last
pieces of a partition are cut into shorter powers of two. Sequences wait until they fill
whole step groups of their tier: groups of ``STEP_TOKENS`` tokens each, dealt in snake order
of attention cost. What is left at a partition's end fills groups of mixed tiers; only the
last of them can have fewer tokens.

Each partition packs what it reads, a bounded pool at a time: no shuffle, and a lost
task yields the same pieces again.

Cases: null and empty texts have the closing id alone; very long texts give many whole
windows; equal rows are packed each for itself; a table without rows gives none; other
columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

TIERS = (256, 512, 1024, 2048)
#: The id that closes a document.
CLOSING_ID = 1
#: Tokens that a partition holds back before it packs them.
POOL_TOKENS = 1 << 19
#: Tokens of a step group.
STEP_TOKENS = 1 << 13

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class WordEncoder:
    """Ids of a text by a ``tokenizers`` file whose model merges words one by one.

    The words between ASCII white space are encoded once each and kept, up to a bound;
    a word's letter runs, digits and symbol runs go to the model's own ``tokenize``.
    Texts that hold a special token's string, or a letter whose lower case hangs on its
    neighbours, go to the tokenizer whole.
    """

    #: Words that are kept in a generation, and the bytes of the longest of them. A word that isn't met in one goes with it.
    KEEP, KEEP_BYTES = 240_000, 64

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.merge = self.whole.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in printable)}
        self.odd = re.compile("<\\|(?:start|end)oftext\\|>|Σ").search
        encoder = self

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = encoder.older.get(word) or encoder.word(word.decode())
                if len(word) <= encoder.KEEP_BYTES:
                    if len(self) >= encoder.KEEP:
                        encoder.older = dict(self)
                        self.clear()
                    self[word] = ids
                return ids

        self.known, self.older = Words(), {}

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.piece(word)
        if word[:-1].isalpha() and word[-1] in ".,!?":
            return self.known[word[:-1].encode()] + self.known[word[-1].encode()]
        return b"".join(self.piece(x if x.isascii() and x.isprintable() else "".join(map(self.visible.__getitem__, x.encode()))) for x in self.pieces(word))

    def piece(self, visible: str) -> bytes:
        return np.array([t.id for t in self.merge(visible)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.known.__getitem__, text.lower().encode().split()))


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Packs documents of one partition; ``add`` and ``close`` yield rows of ``SCHEMA``."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.pool_tokens, self.step_tokens = tiers, pool_tokens, step_tokens
        self.base = self.sequences = self.groups = partition << 40
        #: Per tier, (length, -arrival, doc_id, start, ids of the document) in rising order.
        self.pools: list[list[tuple]] = [[] for _ in tiers]
        #: Per length, whole sequences (lists of pieces) that wait for a step group.
        self.ready: dict[int, list[list[tuple]]] = {}
        self.held = self.arrivals = 0

    def add(self, doc_id: int, ids: bytes) -> list[tuple]:
        n, start, top, rows = len(ids) // 4, 0, self.tiers[-1], []
        while n - start >= top:
            self.ready.setdefault(top, []).append([(top, 0, doc_id, start, ids)])
            self.held += top
            start += top
            if self.held >= self.pool_tokens:
                rows += self.pack(last=False)
        if n > start:
            self.hold((n - start, self.next(), doc_id, start, ids))
        if self.held >= self.pool_tokens:
            rows += self.pack(last=False)
        return rows

    def close(self) -> list[tuple]:
        return self.pack(last=True)

    def next(self) -> int:
        self.arrivals -= 1
        return self.arrivals

    def hold(self, item: tuple) -> None:
        self.pools[bisect_right(self.tiers, item[0] - 1)].append(item)
        self.held += item[0]

    def pack(self, last: bool) -> list[tuple]:
        for pool in self.pools:
            pool.sort()
        rest = []
        for level in range(len(self.tiers) - 1, -1, -1):
            while self.pools[level]:
                room = self.tiers[level]
                pieces = []
                while room and (item := self.take(room, level)):
                    pieces.append(item)
                    room -= item[0]
                if room:
                    rest += pieces
                else:
                    self.ready.setdefault(self.tiers[level], []).append(pieces)
        self.held = 0
        if last:
            for size, pieces in self.split(rest):
                self.ready.setdefault(size, []).append(pieces)
        else:
            for item in rest:
                self.hold(item)
        rows = self.deal(last)
        self.held += sum(size * len(waiting) for size, waiting in self.ready.items())
        return rows

    def take(self, room: int, level: int) -> tuple | None:
        """The longest waiting piece that fits, from this tier or a shorter one; else the head of the shortest there is."""
        for k in range(level, -1, -1):
            pool = self.pools[k]
            if pool and (at := bisect_right(pool, (room + 1,)) - 1) >= 0:
                return pool.pop(at)
        for pool in self.pools[: level + 1]:
            if pool:
                n, age, doc_id, start, ids = pool.pop(0)
                tail = (n - room, age, doc_id, start + room, ids)
                home = self.pools[bisect_right(self.tiers, n - room - 1)]
                home.insert(bisect_right(home, tail), tail)
                return room, age, doc_id, start, ids
        return None

    def split(self, rest: list[tuple]) -> list[tuple[int, list[tuple]]]:
        """The last pieces, cut into sequences whose lengths are falling powers of two."""
        done, left = [], sum(x[0] for x in rest)
        items = rest[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            size, pieces, room = min(size, self.tiers[-1]), [], min(size, self.tiers[-1])
            left -= size
            while room:
                n, age, doc_id, start, ids = items.pop()
                if n > room:
                    items.append((n - room, age, doc_id, start + room, ids))
                    n = room
                pieces.append((n, age, doc_id, start, ids))
                room -= n
            done.append((size, pieces))
        return done

    def deal(self, last: bool) -> list[tuple]:
        """Rows of the sequences that fill step groups, those of least attention cost waiting on; at the end, of all."""
        rows, left = [], []
        for size, sequences in sorted(self.ready.items()):
            sequences.sort(key=lambda pieces: -sum(x[0] ** 2 for x in pieces))
            each = max(1, self.step_tokens // size)
            n = len(sequences) // each
            for k, pieces in enumerate(sequences[: n * each]):
                turn, place = divmod(k, n)
                rows += self.emit(size, pieces, self.groups + (n - 1 - place if turn % 2 else place))
            self.groups += n
            left += [(size, pieces) for pieces in sequences[n * each :]]
        self.ready = {}
        if not last:
            for size, pieces in left:
                self.ready.setdefault(size, []).append(pieces)
            return rows
        room = 0
        for size, pieces in reversed(left):  # longest first: powers of two fill a group without a gap
            if room < size:
                self.groups += 1
                room = self.step_tokens
            rows += self.emit(size, pieces, self.groups - 1)
            room -= size
        return rows

    def emit(self, size: int, pieces: list[tuple], group: int) -> list[tuple]:
        rows, offset = [], 0
        for length, _, doc_id, start, ids in pieces:
            rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, self.sequences, offset, size, group))
            offset += length
        self.sequences += 1
        return rows


def pack_documents(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], tiers: tuple[int, ...] = TIERS, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of the sequences into which the texts of ``docs`` (doc_id, text) are packed.

    ``encode()`` is called on the executor and gives the function from text to the ids'
    bytes. A piece names its document, where it begins there, its length and the CRC of
    its ids; its sequence, where it lies there, the sequence's tier and its step group.
    """
    closing = int(closing_id).to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encode()
        packer = Packer(TaskContext.get().partitionId(), tiers)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += packer.add(doc_id, to_ids(text.as_py() or "") + closing)
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
        if rows := packer.close():
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def word_bpe(path: str | None = None) -> Callable[[], Callable[[str], bytes]]:
    def load() -> Callable[[str], bytes]:
        import public_tokenizers

        return encoder(path or public_tokenizers.path("word_bpe_49k.json")).encode

    return load


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the corpus pipeline."""
    return pack_documents(docs, word_bpe())
