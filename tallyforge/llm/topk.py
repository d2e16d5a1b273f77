"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, and the scores are only
counted: each task adds them to histograms of its queries, and the tasks' histograms are
summed. The bin that holds a query's k-th best score becomes its next range, until bins
hold a single score: that is the k-th value. A last scoring keeps what lies above it and,
of the scores that equal it, the smallest ids that can still be needed; ties break by id.

A task sends only the bins from its own k-th best upwards, since the k-th best overall
can't lie lower; so a histogram has a few rows a task, however many candidates there are.
Queries are blocked, blocks and chunks of vectors sized in bytes by their dimension. While
all queries together are below ``BROADCAST_BYTES``, every task gets them and reads each
vector once a round; beyond that a block meets each chunk once, by a shuffled join on the
block's number, cut into parts so that all tasks have work. So neither the queries nor the
vectors are ever held whole anywhere that isn't sized for them.

Cases: vectors that are null or hold a null or a value that isn't finite take no part;
vectors of unequal length are compared on the components they share; equal vectors tie
and the smaller id goes first; a query with fewer than k candidates gets them all; no
rows give no rows; rows with the same id are candidates each for itself, but not for a
query of that id; of query rows with the same id, equal or not, the one of least vector is
the query, once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, released, table

#: Vectors in a chunk and queries in a block at most, and bytes of either; bins of a histogram.
CHUNK, BLOCK, BLOCK_BYTES, BINS = 4096, 512, 4 << 20, 2048
#: Bytes of all queries up to which they are broadcast.
BROADCAST_BYTES = 8 << 20


def _chunks(vectors: DataFrame) -> DataFrame:
    """(dim, ids, data): so many vectors of one length as a matrix of 64-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len), sort=True):
                size = max(1, min(CHUNK, BLOCK_BYTES // (8 * max(1, dim))))
                for at in range(0, len(part), size):
                    rows = part.iloc[at : at + size]
                    data = np.vstack(rows["v"].to_numpy()).astype(np.int64) if dim else np.zeros((len(rows), 0), np.int64)
                    yield pd.DataFrame({"dim": [dim], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    return vectors.mapInPandas(run, "dim int, ids binary, data binary")


def _matrix(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.int64).reshape(len(ids), dim)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where that is exact, else in 64-bit integers."""
    dim = min(q.shape[1], v.shape[1])
    q, v = q[:, :dim], v[:, :dim]
    if dim and q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * dim < 2.0**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k best of ``vectors`` (id, v: array<long>) for each of ``queries`` (id, v): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_queries, dim, reach = queries.agg(F.count("*"), F.max(F.size("v")), F.max(F.expr("aggregate(v, 0d, (a, x) -> a + abs(x))"))).first()
    (highest,) = vectors.agg(F.max(F.expr("aggregate(v, 0d, (a, x) -> greatest(a, abs(x)))"))).first()
    query_bytes = 8 * (dim or 0) + 64
    n_blocks = max(1, -(-n_queries // max(1, min(BLOCK, BLOCK_BYTES // query_bytes))))
    limit = int(min((reach or 0) * (highest or 0), 2.0**62)) + 1

    blocked = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"))
    q = materialise(
        blocked.groupBy("block").applyInPandas(
            lambda key, pdf: pd.DataFrame({"block": [key[0]], "q_ids": [pdf["id"].to_numpy(np.int64).tobytes()], "q_data": [_padded(pdf["v"]).tobytes()], "q_dim": [max(map(len, pdf["v"]), default=0)]}),
            "block long, q_ids binary, q_data binary, q_dim int",
        )
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    small = n_queries * query_bytes <= broadcast_bytes
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
    chunks = _chunks(vectors).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).withColumn("block", every(n_blocks))

    def scored(state: DataFrame, fold, schema: str) -> DataFrame:
        """``fold`` over the pairs of a block of queries, with the state of each, and a chunk."""
        packed = q.join(state.groupBy("block").agg(F.collect_list(F.struct("id", "low", "width", "wanted")).alias("state")), "block")
        if small:
            return chunks.join(F.broadcast(packed), "block").mapInPandas(fold, schema)
        return chunks.join(packed.withColumn("part", every(parts)), ["block", "part"]).mapInPandas(fold, schema)

    #: A query's range of scores, bins of ``width`` from ``low`` on; ``wanted``: how many of its best lie in this range.
    width = 1
    while width * BINS < 2 * limit + 1:
        width *= BINS
    state = blocked.select("block", "id", F.lit(-limit).cast("long").alias("low"), F.lit(width).cast("long").alias("width"), F.lit(k).alias("wanted"))
    held = None
    while True:
        counted = scored(state, _count(k), "block long, id long, low long, width long, wanted int, bin int, n long")
        summed = counted.groupBy("block", "id", "low", "width", "wanted", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("block", "id").orderBy(F.desc("bin"))
        found = summed.withColumn("upto", F.sum("n").over(above)).withColumn("least", F.min("bin").over(Window.partitionBy("block", "id")))
        chosen = found.where("upto >= wanted and upto - n < wanted or bin = least and upto < wanted")
        state = materialise(chosen.select("block", "id", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.lit(max(1, width // BINS)).cast("long").alias("width"), (F.col("wanted") - F.col("upto") + F.col("n")).cast("int").alias("wanted")))
        if held is not None:
            released(held)
        held = state
        if width == 1:
            break
        width //= BINS

    best = scored(state, _keep(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _padded(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pairs(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Of each row: the block, the queries' ids, low, width and wanted, the candidates' ids, and the scores. A query that has no more candidates is left out; one that is a candidate is marked."""
    for row in pdf.itertuples(index=False):
        ids, data = _matrix(row.ids, row.data, row.dim)
        q_ids, q_data = _matrix(row.q_ids, row.q_data, row.q_dim)
        state = {s["id"]: s for s in row.state}
        at = [i for i, x in enumerate(q_ids.tolist()) if x in state]
        known = [state[x] for x in q_ids[at].tolist()]
        low, width, wanted = (np.array([s[name] for s in known], np.int64) for name in ("low", "width", "wanted"))
        yield row.block, q_ids[at], low, width, wanted, ids, _scores(q_data[at], data)


def _count(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, q_ids, low, width, wanted, ids, scores in _pairs(pdf):
                bins = (scores - low[:, None]) // width[:, None]
                inside = (bins >= 0) & (bins < BINS) & (ids[None, :] != q_ids[:, None])
                flat = (bins + np.arange(len(q_ids))[:, None] * BINS)[inside]
                counts = np.bincount(flat, minlength=len(q_ids) * BINS).reshape(len(q_ids), BINS)
                # the bins above the one that holds this chunk's k-th best, and that one
                upto = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
                i, b = np.nonzero((counts > 0) & (upto - counts < k))
                yield pd.DataFrame({"block": block, "id": q_ids[i], "low": low[i], "width": width[i], "wanted": wanted[i].astype(np.int32), "bin": b.astype(np.int32), "n": counts[i, b]})

    return run


def _keep(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, q_ids, low, _, wanted, ids, scores in _pairs(pdf):
                other = ids[None, :] != q_ids[:, None]
                i, j = np.nonzero((scores > low[:, None]) & other)
                parts = [pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": scores[i, j]})]
                for row, col in enumerate(((scores == low[:, None]) & other)):
                    tied = np.sort(ids[col])[: wanted[row]]
                    if len(tied):
                        parts.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": tied, "score": low[row]}))
                yield pd.concat(parts)

    return run


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.expr("transform(embedding, x -> cast(x as double))").alias("x"))
    finite = F.expr("x is not null and not exists(x, e -> e is null or isnan(e) or abs(e) = double('infinity'))")
    vectors = rows.where(F.col("id").isNotNull() & finite).select("id", F.expr("transform(x, e -> cast(floor(256 * e) as long))").alias("v"))
    return top_k(vectors, vectors.where("id % 50 = 0"), k=5)


#: The same by scoring all pairs; vectors of equal length with finite components, as the table has.
ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
