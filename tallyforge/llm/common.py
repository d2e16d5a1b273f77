"""Helpers that several training-data operators share: reading, cutting lineage,
vectorised word hashing over Arrow buffers, connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy code looks at together; bounds its scratch memory.
SLICE_BYTES = 1 << 19


#: Bytes of an Arrow batch between Spark and Python; Spark's own bound lets every task hold 64 MB a step.
BATCH_BYTES = 4 << 20
#: Keys that more than this part of all rows share are split in joins, so there are at most so many of them.
HOT_KEYS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, if it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tallyforge-")


def shared_dir(spark: SparkSession) -> str:
    """A folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one of this machine, if the session runs on no other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/tf-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # this step's shuffles are not read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete the files behind a ``materialise`` result that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tf-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a string column, a few MB each.

    Offsets start at 0 and have one entry more than there are rows; a null is an
    empty text. A row longer than a slice makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, and the index of each text's first word (one entry more than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[off[off <= n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on unsigned arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of words and of runs of words; ``seed`` picks an independent function.

    A word is a polynomial over a random value for each byte, a run of words a
    polynomial over its words' hashes; each is mixed at the end.
    """

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        if fold_case:
            self.byte[65:91] = self.byte[97:123]
        self.base, self.run_base = (int(x) * 8 + 3 for x in rng.integers(2**40, 2**60, 2))
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (self.base, self.inverse))
        total = np.zeros(n, np.uint64)
        np.cumsum(self.byte[data] * self.up[: n - 1], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def runs(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on; the last ``length - 1`` entries are missing."""
        n = len(words) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(n, length, np.uint64)
        base = np.uint64(self.run_base)
        for k in range(length):
            total = total * base + words[k : k + n]
        return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def dealt(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` with a column ``_part``: their key's rows are cut by the hash of ``spread`` into parts of at most a ``HOT_KEYS``-th of all ``total`` rows.

    ``keyed`` has one row a key and in column ``n`` how many rows have it. Keys that need more than one part are at most
    ``HOT_KEYS``, so the list of them that every task gets is bounded whatever the table's size.
    """
    share = max(1, total // HOT_KEYS)
    hot = keyed.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("_parts"))
    out = rows.join(F.broadcast(hot), keys, "left")
    return out.withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key. A key with very many rows is cut as by ``dealt``, its one row copied to each part; there are at most twice ``HOT_KEYS`` copies."""
    share = max(1, total // HOT_KEYS)
    parts = F.when(F.col(n) > share, F.sequence(F.lit(0), F.ceil(F.col(n) / share).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    copied = keyed.withColumn("_part", F.explode(parts)).drop(n)
    return dealt(rows, keyed, keys, spread, total, n).join(copied, [*keys, "_part"], how).drop("_part")


def split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and in column ``n`` how many rows have it (of about ``total`` in all).

    Keys that more than a ``HOT_KEYS``-th part of all rows share, at most ``HOT_KEYS`` of them, are joined map-side, so their rows aren't
    shuffled; the others are joined by a shuffle, which ``keyed`` as a rule has behind it. To be used where ``rows`` are cheap to read twice.
    """
    share = max(1, total // HOT_KEYS)
    hot = keyed.where(F.col(n) > share).drop(n)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(n) <= share).drop(n), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph of ``edges`` (a, b: long); a component is its smallest node.

    Rounds of large-star and small-star, each a grouped minimum joined back by ``split_join``, so that a node with very
    many neighbours is not one task's work; the rounds end when the edges are stars. Nodes without an edge to another are
    left out.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = _shape(edges)
    while before[0]:
        total = 2 * before[0]
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("m"), "n")
        large = materialise(split_join(both, lowest, ["v"], total).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = split_join(large, low, ["v"], total).select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        after = materialise(small.where("u <> v").distinct())
        released(edges)
        released(large)
        edges, now = after, _shape(after)
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _shape(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free hash, to see whether a round changed anything."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
