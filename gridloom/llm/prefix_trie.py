"""A trie of conversations by their turns, built as a Patricia trie and expanded.

A turn is the digest of its role and text; a node is a sequence of first turns, named by
chaining the digests. Conversations are cut into blocks of at most ``BLOCK`` turns, each
with the name of the node where it starts, so a sort key is bounded however long a
conversation is.

1. *Sort.* The distinct blocks are range-sorted by start and turns. The common start of
   two neighbours is a node where ways part, and every such node is found so; a range's
   first block is compared with the last one before it.
2. *Compressed trie.* The points are these nodes, the conversations' ends (leaves
   included) and the root. Of the conversations that end at one node the least stands for
   all; the points on its way, and the edges between them, come from a join by name.
3. *Aggregates.* Members and children of a point are summed over the ways that pass it.
   A point belongs to its least member, whose way it is from there on down, so what lies
   below a point is the sum over all ways of what belongs to them further down: running
   sums along each way and one aggregate by point, no loop over depths.
4. *Expansion.* An edge's inner nodes have its lower point's members and leaves, one child
   and the point's sum with the edge's words from the node on.

Rows are sorted and streamed, so no task holds a conversation, a node's ways or its
members: the members' list is hashed from pieces that are sorted by range. A
conversation's names are a chain, so one conversation is one task's stream.

Defined results: a null role or text is empty; a row without a ``conv_id`` belongs to no
conversation and is left out; turns of one number are taken by the digest of role and
text; repeated rows are turns of their own; an empty table has no node; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CLASS, materialize, partitions, release

BLOCK = 2048
#: Bytes of a turn's digest and of a node's name.
SIZE = 16
ROOT = bytes(SIZE)
#: A conversation takes its first turns from the first of its family.
FAMILY, SHARED = 20, 4
#: Rows of a batch, characters of a piece of a members' list.
BATCH, PIECE = 4096, 1 << 16


def following(node: bytes, turn: bytes) -> bytes:
    """The name of a node's child."""
    return hashlib.blake2b(node + turn, digest_size=SIZE).digest()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def streamed(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``function`` over the rows of each partition, in their order."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in schema.split(", "))])
    return df.mapInArrow(lambda batches: in_batches(function(rows_of(batches)), fields), schema)


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, digest, words``: the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SIZE))
    words = F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), words.alias("words"))
    place = F.row_number().over(W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv", place.alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, part, pos, digest, words``: first turns (part 0) from the family's first, then a conversation's own (part 1).

    Each conversation also has a row of part -1, as it may be left without turns.
    """
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    convs = turns.select("conv").distinct().withColumn("shared", shared)
    own = turns.where(F.col("pos") > shared).select("conv", F.lit(1).alias("part"), "pos", "digest", "words")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < SHARED)).select(F.col("conv").alias("base"), "pos", "digest", "words")
    taken = convs.where("shared > 0").withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base").where("pos <= shared")
    starts = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(taken.select("conv", F.lit(0).alias("part"), "pos", "digest", "words")).unionByName(starts)


_BLOCKS = "conv long, depth long, before long, start binary, seq binary, words binary, node binary, next binary"


def blocks(rows: Iterator[tuple], block: int) -> Iterator[tuple]:
    """Sorted ``conv, digest, words`` rows cut into blocks; a null digest begins a conversation.

    A block's ``depth`` and ``before`` are the turns and words before it, ``node`` is its
    end and ``next`` the node after that, null at the conversation's end.
    """
    conv = None
    for own, digest, words in rows:
        if digest is None:
            if conv is not None:
                yield (conv, depth, before, start, bytes(seq), np.array(counts, "<i8").tobytes(), node, None)
            conv, depth, before, start, seq, counts, node = own, 0, 0, ROOT, bytearray(), [], ROOT
            continue
        after = following(node, digest)
        if len(counts) == block:
            yield (conv, depth, before, start, bytes(seq), np.array(counts, "<i8").tobytes(), node, after)
            depth, before, start, seq, counts = depth + block, before + sum(counts), node, bytearray(), []
        seq += digest
        counts.append(words)
        node = after
    if conv is not None:
        yield (conv, depth, before, start, bytes(seq), np.array(counts, "<i8").tobytes(), node, None)


def parting(start: bytes, a: bytes, b: bytes) -> bytes:
    """The node to which two different blocks go together."""
    n = min(len(a), len(b)) // SIZE
    low, high = 0, n  # the longest common start, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * SIZE] == b[: mid * SIZE] else (low, mid - 1)
    node = start
    for k in range(low):
        node = following(node, a[k * SIZE : (k + 1) * SIZE])
    return node


def partings(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of sorted ``part, start, seq`` rows the nodes of neighbours (edge 0), and the first and last row (edges 1 and 2)."""
    last = None
    for part, start, seq in rows:
        if last is None:
            yield (None, part, 1, start, seq)
        elif last[1] == start:
            yield (parting(start, last[2], seq), part, 0, None, None)
        last = (part, start, seq)
    if last is not None:
        yield (None, last[0], 2, last[1], last[2])


def parting_nodes(distinct: DataFrame) -> DataFrame:
    """``node``: where neighbours in the order of ``start, seq`` part."""
    ordered = distinct.repartitionByRange(partitions(distinct.sparkSession), "start", "seq").sortWithinPartitions("start", "seq")
    found = materialize(streamed(ordered.select(F.spark_partition_id().alias("part"), "start", "seq"), partings, "node binary, part int, edge int, start binary, seq binary"), "trie-partings")
    ends = W.orderBy("part", "edge")  # two rows for each range
    pairs = found.where("edge > 0").select("edge", "start", "seq", F.lag("start").over(ends).alias("last_start"), F.lag("seq").over(ends).alias("last_seq")).where("edge = 1 AND start = last_start")
    across = streamed(pairs.select("start", "last_seq", "seq"), lambda rows: ((parting(*r),) for r in rows), "node binary")
    return found.where("edge = 0").select("node").unionByName(across)


def pieces(rows: Iterator[tuple], piece: int) -> Iterator[tuple]:
    """Sorted ``node, conv`` rows as comma-joined pieces: ``node, first, n, text``."""
    node, out, n = None, [], 0
    for own, conv in rows:
        text = str(conv)
        if own != node or n > piece:
            if out:
                yield (node, first, len(out), ",".join(out))
            node, first, out, n = own, conv, [], 0
        out.append(text)
        n += len(text) + 1
    if out:
        yield (node, first, len(out), ",".join(out))


def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted pieces as ``node, rep, n_ends, ends_sha256``."""
    node = None
    for own, first, n, text in rows:
        if own != node:
            if node is not None:
                yield (node, rep, count, sha.hexdigest())
            node, rep, count, sha = own, first, 0, hashlib.sha256()
        sha.update(("," if count else "").encode() + text.encode())
        count += n
    if node is not None:
        yield (node, rep, count, sha.hexdigest())


def members(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``node, rep, n_ends, ends_sha256`` of the conversations that end at each node."""
    ordered = ends.repartitionByRange(partitions(ends.sparkSession), "node", "conv").sortWithinPartitions("node", "conv")
    parts = streamed(ordered.select("node", "conv"), lambda rows: pieces(rows, piece), "node binary, first long, n long, text string")
    return streamed(parts.repartition("node").sortWithinPartitions("node", "first"), digests, "node binary, rep long, n_ends long, ends_sha256 string")


_STEPS = "rep long, n_ends long, depth long, node binary, next binary, words long, total long"


def steps(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes along blocks ``rep, n_ends, depth, before, start, seq, words, next``; ``total``: words down to the node."""
    for rep, n_ends, depth, total, start, seq, words, after in rows:
        counts = np.frombuffer(words, "<i8").tolist()
        names = [start]
        for k in range(len(counts)):
            names.append(following(names[-1], seq[k * SIZE : (k + 1) * SIZE]))
        if depth == 0:
            yield (rep, n_ends, 0, start, names[1] if counts else after, 0, 0)
        for k, n in enumerate(counts, 1):
            total += n
            yield (rep, n_ends, depth + k, names[k], names[k + 1] if k < len(counts) else after, n, total)


def trie(sequences: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """All nodes of ``conv, part, pos, digest, words`` sequences (see :func:`rebuilt`).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    ordered = sequences.repartition("conv").sortWithinPartitions("conv", "part", "pos")
    cut = materialize(streamed(ordered.select("conv", "digest", "words"), lambda rows: blocks(rows, block), _BLOCKS), "trie-blocks")
    ends = materialize(members(cut.where("next IS NULL").select("node", "conv"), piece), "trie-ends")

    ways = cut.join(ends.select(F.col("rep").alias("conv"), "n_ends"), "conv").withColumnRenamed("conv", "rep")
    forks = parting_nodes(ways.select("start", "seq").distinct())
    root = cut.select(F.lit(ROOT).alias("node")).limit(1)
    points = materialize(forks.unionByName(ends.select("node")).unionByName(root).distinct(), "trie-points")
    all_steps = materialize(streamed(ways.select("rep", "n_ends", "depth", "before", "start", "seq", "words", "next"), steps, _STEPS), "trie-steps")

    # The compressed trie: points on each way, the edge above each.
    down = W.partitionBy("rep").orderBy("depth")
    on_way = all_steps.join(points, "node", "left_semi")
    on_way = materialize(on_way.withColumn("above", F.lag("total", 1, 0).over(down)).withColumn("up_depth", F.lag("depth", 1, -1).over(down)), "trie-ways")
    children = on_way.groupBy("node", "next").agg(F.min("rep").alias("rep"), F.sum("n_ends").alias("n"))
    nodes = materialize(children.groupBy("node").agg(F.min("rep").alias("owner"), F.sum("n").alias("n_convs"), F.count("next").alias("n_children")), "trie-nodes")
    met = on_way.join(nodes, "node")
    owned = F.col("rep") == F.col("owner")
    met = met.withColumn("gain", F.when(owned, (F.col("n_convs") - 1) * (F.col("total") - F.col("above"))).otherwise(0))
    met = met.withColumn("leaf", (F.col("next").isNull() & (F.col("n_children") == 0)).cast("long"))
    up = W.partitionBy("rep").orderBy(F.col("depth").desc())
    below = F.coalesce(F.sum("gain").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    leaf = F.max("leaf").over(up.rowsBetween(W.unboundedPreceding, 0))
    met = met.select("rep", "node", "depth", "total", "up_depth", "owner", "n_convs", "n_children", below.alias("below"), leaf.alias("leaf"), F.lag("owner").over(down).alias("up_owner"), F.col("next").isNull().alias("is_end"))
    met = materialize(met, "trie-met")
    sums = met.groupBy("node").agg(F.sum("below").alias("below"), F.sum("leaf").alias("n_leaves"))
    lower = met.where("rep = owner").drop("below", "leaf").join(sums, "node").join(ends.select("node", "ends_sha256"), "node", "left")

    # Expansion: each step of a way belongs to the next point down, if that point's edge reaches up to it.
    point = F.struct(F.col("depth").alias("at"), "total", "up_depth", "up_owner", "n_convs", "n_children", "n_leaves", "below", "ends_sha256")
    empty = F.sha2(F.lit(b""), 256)
    both = lower.select("rep", "depth", F.lit(0).alias("kind"), point.alias("point"), F.lit(None).cast("long").alias("words"), F.lit(None).cast("long").alias("to_here"))
    inner = all_steps.select("rep", "depth", F.lit(1).alias("kind"), F.lit(None).cast(both.schema["point"].dataType).alias("point"), "words", F.col("total").alias("to_here"))
    next_down = F.last("point", ignorenulls=True).over(W.partitionBy("rep").orderBy(F.col("depth").desc(), "kind").rowsBetween(W.unboundedPreceding, 0))
    made = both.unionByName(inner).withColumn("p", next_down).where("kind = 1 AND depth > p.up_depth")
    here = F.col("depth") == F.col("p.at")
    out = made.select(
        F.col("rep").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") - 1 > F.col("p.up_depth"), F.col("rep")).otherwise(F.col("p.up_owner")).alias("parent_conv_id"),
        F.col("p.n_convs").alias("n_convs"), F.when(here, F.col("p.n_children")).otherwise(1).cast("long").alias("n_children"), F.col("p.n_leaves").alias("n_leaves"),
        (F.col("p.below") + (F.col("p.n_convs") - 1) * (F.col("p.total") - F.col("to_here") + F.col("words"))).alias("saved_tokens"),
        F.when(here, F.coalesce("p.ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )
    release(cut)
    return out


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return trie(rebuilt(turns))


def _crc32_sql(text: str) -> str:
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295)"


ORACLE = f"""
WITH t AS (
  SELECT conv_id, sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
r AS (
  SELECT conv_id, 1 AS part, pos, k, words FROM t JOIN c USING (conv_id) WHERE pos > h
  UNION ALL SELECT c.conv_id, 0, pos, k, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h),
w AS (SELECT conv_id, list(struct_pack(k := k, w := words) ORDER BY part, pos) AS way FROM r GROUP BY conv_id),
p AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN '' ELSE sha256(array_to_string(list_transform(way[1:d], lambda x: x.k), ',')) END AS node, CASE WHEN d = 1 THEN '' WHEN d > 1 THEN sha256(array_to_string(list_transform(way[1:d - 1], lambda x: x.k), ',')) END AS up,
    CASE WHEN d = 0 THEN 0 ELSE way[d].w END AS words, d = coalesce(len(way), 0) AS is_end
  FROM (SELECT c.conv_id, way, unnest(range(0, coalesce(len(way), 0) + 1)) AS d FROM c LEFT JOIN w USING (conv_id))),
n AS (
  SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM p GROUP BY node, d),
k AS (SELECT up AS node, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (
  SELECT a.node, sum((x.n_convs - 1) * x.words) AS saved, count_if(k.n IS NULL) AS leaves
  FROM n x JOIN p ON p.conv_id = x.conv_id AND p.node = x.node JOIN p a ON a.conv_id = p.conv_id AND a.d <= p.d LEFT JOIN k ON k.node = x.node GROUP BY a.node)
SELECT n.conv_id, d AS depth, up_n.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM (SELECT * FROM n) n LEFT JOIN (SELECT node, conv_id FROM n) up_n ON up_n.node = n.up LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node
"""
