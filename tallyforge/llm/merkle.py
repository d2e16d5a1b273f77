"""Merkle dataset manifest as a postorder append log.

The rows of a group (a language), in order, are the leaves of a binary tree: while several
nodes remain, each two neighbours become the digest of both, a last one alone the digest of
itself. The log holds the nodes in the order in which they are complete when leaves arrive
one by one: leaf r, then every node that ends with it, from the lowest up; after the last
leaf the nodes of the right edge that stay incomplete. So a node's place in the log follows
from the sizes of the subtrees before it (``log_position``) and needs no index.

Builders are aligned: one takes ``1 << BITS`` leaves from a multiple of that on, whose nodes
stand together in the log, and writes them as one segment. Roots of segments are the leaves
of the next stage, so there are three stages for 64 billion rows. Subroots of the groups go
through the same code for the root. Proofs are read top-down: a segment gets the path above
its root from the stage above, and takes the siblings of each of its leaves out of its own
nodes by their positions. No step holds more than one segment; ranks come from counts of
the partitions of one range sort, not from a window over a group.

Cases: nulls in any column are part of the leaf; rows order by doc_id, nulls first, then by leaf, so
repeated rows stand side by side and have proofs of their own; a group of one row has its leaf as
subroot and the digest of nothing as its part of the proof; very long texts are digested in the JVM;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, table

#: Leaves of a builder's segment, as a power of two.
BITS = 12
#: Bytes of a digest as hex text.
HEX = 64
_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length() if n > 1 else 0


def log_position(n: int, level: int, index: int) -> int:
    """Place in the log of ``n`` leaves of the node that covers leaves from ``index << level`` on.

    The trees complete before leaf r have 2r - popcount(r) nodes; a node follows its last leaf by as many places as its
    level. Nodes of the right edge that lack leaves follow all complete ones, from the lowest up.
    """
    end = (index + 1) << level
    if end <= n:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    lowest = (n & -n).bit_length()  # the lowest level that such a node has
    return 2 * n - n.bit_count() + level - lowest


def segment_nodes(leaves: list[bytes], top: int) -> list[bytes]:
    """The nodes over ``leaves`` up to level ``top``, in the order of the log."""
    out: list[bytes] = []
    waiting: list[tuple[int, bytes]] = []  # complete nodes without a parent, the highest first
    for leaf in leaves:
        level, node = 0, leaf
        out.append(node)
        while level < top and waiting and waiting[-1][0] == level:
            node, level = digest(waiting.pop()[1] + node), level + 1
            out.append(node)
        waiting.append((level, node))
    level, node = waiting.pop()
    while level < top:
        node = digest((waiting.pop()[1] if waiting and waiting[-1][0] == level else b"") + node)
        level += 1
        out.append(node)
    return out


def siblings(nodes: bytes, n: int, top: int, leaf: int) -> list[tuple[bool, bytes]]:
    """(is it on the left, digest) of each level's sibling of ``leaf`` or the node over it, from the nodes of a segment; an empty digest where there is none."""
    path = []
    for level in range(top):
        index = (leaf >> level) ^ 1
        at = log_position(n, level, index) * HEX
        path.append((bool(leaf >> level & 1), nodes[at : at + HEX] if index << level < n else b""))
    return path


def fold(leaf: bytes, path: list[tuple[bool, bytes]]) -> bytes:
    for left, other in path:
        leaf = digest(other + leaf if left else leaf + other)
    return leaf


def _packed(path: list[tuple[bool, bytes]]) -> bytes:
    return b"".join((b"L" if left else b"R") + other.ljust(HEX) for left, other in path)


def _unpacked(data: bytes) -> list[tuple[bool, bytes]]:
    return [(data[k : k + 1] == b"L", data[k + 1 : k + 1 + HEX].strip()) for k in range(0, len(data), HEX + 1)]


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row of documents, with some columns ``changed``."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in _FIELDS)), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) and ``n`` within ``group`` (not null).

    One range sort over group and order; each task numbers its rows of a group, and the counts of the tasks before it are
    added. A group of any size is spread over tasks.
    """
    schema = rows.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    at = schema.fieldNames().index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            seq = []
            for g in batch.column(at).to_pylist():
                seen = seen + 1 if g == last else 0
                last = g
                seq.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(seq), pa.int32()), pa.array(seq, pa.int64())], names=[*schema.fieldNames(), "_task", "_seq"])

    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    numbered = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, f"{fields}, _task int, _seq long"))
    counts = numbered.groupBy(group, "_task").agg((F.max("_seq") + 1).alias("_count"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_task", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"), F.sum("_count").over(Window.partitionBy(group)).alias("n"))
    return numbered.join(starts, [group, "_task"]).withColumn("rank", F.col("_start") + F.col("_seq")).drop("_task", "_seq", "_start")


_SEGMENT = "grp string, block long, n long, size int, top int, nodes binary, root string, ids array<long>, tampered array<string>"
_SEGMENT_ARROW = pa.schema([
    ("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("top", pa.int32()), ("nodes", pa.binary()), ("root", pa.string()),
    ("ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.string())),
])


def _builder(bits: int):
    """One aligned block of leaves (grp, block, n, rank, digest, doc_id, tampered) to its segment of the log."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("rank")
        n = rows.column("n")[0].as_py()
        leaves = [x.encode() for x in rows.column("digest").to_pylist()]
        top = min(bits, height(n))
        nodes = segment_nodes(leaves, top)
        return pa.Table.from_pylist(
            [{"grp": rows.column("grp")[0].as_py(), "block": rows.column("block")[0].as_py(), "n": n, "size": len(leaves), "top": top, "nodes": b"".join(nodes), "root": nodes[-1].decode(),
              "ids": rows.column("doc_id").to_pylist(), "tampered": rows.column("tampered").to_pylist()}], schema=_SEGMENT_ARROW,
        )

    return run


def build(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Segments of the log, a table a stage, of ``leaves`` (grp, rank, n, digest, doc_id, tampered); a segment has ``1 << bits`` leaves at most."""
    stages = []
    leaves = leaves.withColumn("block", F.shiftright("rank", bits))
    while True:
        stage = materialise(leaves.select("grp", "block", "n", "rank", "digest", "doc_id", "tampered").groupBy("grp", "block").applyInArrow(_builder(bits), _SEGMENT))
        stages.append(stage)
        above = stage.where(F.col("n") > 1 << bits)
        if not above.limit(1).count():
            return stages
        none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")]
        leaves = above.select("grp", F.shiftright("block", bits).alias("block"), F.ceil(F.col("n") / (1 << bits)).alias("n"), F.col("block").alias("rank"), F.col("root").alias("digest"), *none)


def subroots(stages: list[DataFrame], bits: int = BITS) -> DataFrame:
    """grp, root: of the one segment in which a group ends."""
    ends = [s.where(F.col("n") <= 1 << bits).select("grp", "root") for s in stages]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def paths(stages: list[DataFrame], above: DataFrame, bits: int = BITS) -> DataFrame:
    """The first stage's segments with ``path``, the siblings above a segment's root; ``above`` (grp, path) is what follows a group's root."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = row["block"] << bits
                upper = [_packed(siblings(row["nodes"], row["size"], row["top"], k)) + row["path"] for k in range(row["size"])]
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(upper), pa.string()), pa.array(range(base, base + len(upper)), pa.int64()), pa.array(upper, pa.binary())], names=["grp", "block", "path"])

    ends = above.select("grp", F.lit(0).cast("long").alias("block"), "path")
    known = None
    for stage in reversed(stages):
        # a group has its path here if it ends here, and from the stage above otherwise
        last = stage.where(F.col("n") <= 1 << bits).join(ends, ["grp", "block"])
        with_path = last if known is None else last.unionByName(stage.where(F.col("n") > 1 << bits).join(known, ["grp", "block"]))
        if stage is stages[0]:
            return with_path
        known = with_path.select("grp", "block", "size", "top", "nodes", "path").mapInArrow(down, "grp string, block long, path binary")
    raise AssertionError


def append_log(stages: list[DataFrame], bits: int = BITS) -> DataFrame:
    """The log itself: grp, position (from 0 in a group), level, index, digest."""
    pieces = []
    for k, stage in enumerate(stages):

        def nodes(batches: Iterator[pa.RecordBatch], base: int = k * bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = []
                    for level in range(1 if base else 0, row["top"] + 1):
                        for index in range(-(-row["size"] >> level)):
                            at = log_position(row["size"], level, index) * HEX
                            whole = (row["block"] << bits - level) + index
                            found.append((log_position(row["leaves"], base + level, whole), base + level, whole, row["nodes"][at : at + HEX].decode()))
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(found), pa.string()), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True))],
                                                     names=["grp", "position", "level", "index", "digest"])

        leaves = stages[0].groupBy("grp").agg(F.first("n").alias("leaves"))
        pieces.append(stage.join(leaves, "grp").select("grp", "block", "size", "top", "nodes", "leaves").mapInArrow(nodes, "grp string, position long, level int, index long, digest string"))
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out


def _proofs(bits: int):
    """Segments (with subroot, root, path) to a row a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                upper, nodes, n, root = _unpacked(row["path"]), row["nodes"], row["size"], row["all"].encode()
                out: list[list] = [[] for _ in range(5)]
                for k, tampered in enumerate(row["tampered"]):
                    at = log_position(n, 0, k)
                    leaf = nodes[at * HEX : (at + 1) * HEX]
                    path = siblings(nodes, n, row["top"], k) + upper
                    folded = fold(tampered.encode() if tampered else leaf, path)
                    for column, value in zip(out, (leaf.decode(), digest(b"".join(x for _, x in path)).decode(), folded.decode(), folded == root, log_position(row["n"], 0, (row["block"] << bits) + k)), strict=True):
                        column.append(value)
                leaf, proof, folded, verified, position = out
                same = lambda x: pa.array([x] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(leaf), same(row["sub"]), same(row["all"]), pa.array(proof), pa.array(folded), pa.array(verified), pa.array(position, pa.int64())],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "log_position"],
                )

    return run


def manifest(docs: DataFrame, tampered: Column, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` its leaf, subroot, root and proof; ``folded_root`` is recomputed from the leaf with n_chars one larger where ``tampered`` holds."""
    bad = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(n_chars=F.col("n_chars") + 1))
    group = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("n"))  # null first
    leaves = docs.select(group.alias("grp"), F.col("doc_id").cast("long"), leaf_digest().alias("digest"), bad.alias("tampered"))
    rows = ranked(leaves, "grp", ["doc_id", "digest"])
    stages = build(rows, bits)
    subs = materialise(subroots(stages, bits))
    top = build(ranked(subs.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.col("grp").alias("tampered")), "grp", ["name"]), bits)
    end = subroots(top, bits).withColumn("path", F.lit(b"")).select("grp", "path", F.col("root").alias("all"))
    # a leaf of the upper tree is a group, whose name stands in the column of the tampered digest
    spread = paths(top, end.select("grp", "path"), bits).join(F.broadcast(end.select("grp", "all")), "grp").mapInArrow(_group_paths, "grp string, path binary, all string")
    of_group = spread.join(subs.withColumnRenamed("root", "sub"), "grp")
    found = paths(stages, of_group.select("grp", "path"), bits).join(of_group.select("grp", "sub", "all"), "grp")
    return found.select("block", "n", "size", "top", "nodes", "ids", "tampered", "path", "sub", "all").mapInArrow(
        _proofs(bits), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, log_position long"
    )


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the tree over groups to grp, path to the root, root."""
    for batch in batches:
        for row in batch.to_pylist():
            path = [_packed(siblings(row["nodes"], row["size"], row["top"], k)) + row["path"] for k in range(row["size"])]
            yield pa.RecordBatch.from_arrays([pa.array(row["tampered"], pa.string()), pa.array(path, pa.binary()), pa.array([row["all"]] * len(path), pa.string())], names=["grp", "path", "all"])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


#: Nodes level by level, proofs by joins of a leaf's place at each level, folding by recursion.
ORACLE = r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
field AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f_id, coalesce(strlen(source) || ':' || source, '-') AS f_source, coalesce(strlen(lang) || ':' || lang, '-') AS f_lang, coalesce(strlen(text) || ':' || text, '-') AS f_text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, crc_table),
leaf AS (SELECT *, sha256(f_id || f_source || f_lang || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || f_text) AS leaf,
  sha256(f_id || f_source || f_lang || coalesce(strlen((n_chars + CASE WHEN hit THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN hit THEN 1 ELSE 0 END), '-') || f_text) AS given FROM field),
placed AS (SELECT *, coalesce('v' || lang, 'n') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaf),
nodes AS (SELECT grp, 0 AS level, r AS i, leaf AS h FROM placed
  UNION ALL SELECT grp, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM nodes) WHERE c > 1 GROUP BY grp, level, i // 2),
subs AS (SELECT *, row_number() OVER (ORDER BY encode(grp)) - 1 AS g FROM (SELECT grp, arg_max(h, level) AS subroot, max(level) AS top FROM nodes GROUP BY grp)),
upper AS (SELECT 0 AS level, g AS i, subroot AS h FROM subs
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY level, i // 2),
head AS (SELECT h AS root, level AS above FROM upper ORDER BY level DESC LIMIT 1),
numbered AS (SELECT *, row_number() OVER () AS k FROM placed JOIN subs USING (grp), head),
step AS (SELECT k, 0 AS part, l AS level, r >> l AS i, grp FROM numbered, range(64) s(l) WHERE l < top UNION ALL SELECT k, 1, l, g >> l, grp FROM numbered, range(64) s(l) WHERE l < above),
other AS (SELECT step.k, step.part, step.level, step.i, coalesce(n.h, u.h) AS h FROM step LEFT JOIN nodes n ON part = 0 AND n.grp = step.grp AND n.level = step.level AND n.i = xor(step.i, 1) LEFT JOIN upper u ON part = 1 AND u.level = step.level AND u.i = xor(step.i, 1)),
proof AS (SELECT k, list({'left': i & 1 = 1, 'h': coalesce(h, '')} ORDER BY part, level) AS p FROM other GROUP BY k),
fold AS (SELECT k, 1 AS lvl, given AS h FROM numbered UNION ALL SELECT k, lvl + 1, sha256(CASE WHEN p[lvl].left THEN p[lvl].h || fold.h ELSE fold.h || p[lvl].h END) FROM fold JOIN proof USING (k) WHERE lvl <= len(p))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_prepend('', list_transform(p, lambda x: x.h)), lambda a, b: a || b), '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified, 2 * r - bit_count(r) AS log_position
FROM numbered LEFT JOIN proof USING (k) JOIN (SELECT k, arg_max(h, lvl) AS h FROM fold GROUP BY k) f USING (k)
"""
