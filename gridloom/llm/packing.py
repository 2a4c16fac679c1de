"""Packing documents into sequences by bulk-synchronous best fit.

Documents are tokenized, closed by an end id and, if longer than a sequence, cut.
The pieces are range-sorted by length: a piece's place is its length and its rank
among the pieces of that length. Gaps (what is left of the opened sequences) are kept
range-sorted too. A superstep takes all pieces of one length, longest first, and
sweeps the gaps upwards from that length: the successor gap, the tightest in which
the pieces fit, takes one piece each; where more pieces than gaps want a class, the
lower ranks win and the others go on to the next class; the gaps are updated and the
sweep repeats until the pieces are placed, at last in new sequences.

All pieces of one length are alike for this, and so are all gaps of one size. There
are no more lengths than a sequence has tokens, hence the sweeps need just the count
of each length: ``best_fit`` works on stretches of ranks, on at most 2048 counts
whatever the corpus. Per-piece work (tokens, ranks, places) is distributed: ranks
come from salted windows with offsets, so that a length that a third of all pieces
share is spread over many tasks, and a piece finds its place by binary search in the
stretches, whose number the lengths bound.

Defined results: a null or empty text is one piece that holds just the end id;
repeated rows are packed one by one; an empty table gives an empty result; of the
input only id and text are looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import documents, map_rows, materialize, partitions, text_or_empty

CAPACITY, END_ID = 2048, 0
LIBRARY = "byte_bpe_50k.json"
RANKS, SPECIAL, SPECIAL_ID = "byte_bpe_50k.tiktoken", "<|endoftext|>", 50256
#: Pieces of one length that are ranked together, on average, when there are many.
RANK_ROWS = 200_000


@cache
def encoding(name: str = RANKS):
    """The tokenizer's ranks in the faster of the libraries that read them; the ids are the same (see the tests)."""
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@cache
def library(name: str = LIBRARY):
    """The tokenizer as its own library reads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def encode(text: str) -> bytes:
    """A text's ids, four bytes each; the special token's string gives its id, as is the library's default.

    The faster library gives up on some texts, such as a million spaces in a row; these
    go to the tokenizer's own library.
    """
    try:
        return _encode(text)
    except ValueError:
        return np.array(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _encode(text: str) -> bytes:
    return encoding().encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def token_pieces(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and the ids' bytes) of each document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                raw = memoryview(encode(text) + end)
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(bytes(raw[4 * a : 4 * b]))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_rows(df, [id_col, text_or_empty(text_col).alias("__text")], cut, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length.

    One row for each stretch of ranks: length, first rank, pieces, first sequence,
    offset. The pieces of a stretch go to sequences of consecutive numbers, all at
    the same offset.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by size: (first sequence, how many)
    some = np.zeros(capacity + 1, bool)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = np.flatnonzero(some[length:])
            if fitting.size:
                size = length + int(fitting[0])
                first, many = gaps[size].pop()
                some[size] = bool(gaps[size])
            else:
                size, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            taken = min(left, many)
            out.append((length, rank, taken, first, capacity - size))
            if taken < many:
                gaps[size].append((first + taken, many - taken))
                some[size] = True
            if size > length:
                gaps[size - length].append((first, taken))
                some[size - length] = True
            rank, left = rank + taken, left - taken
    return np.array(out, np.int64).reshape(-1, 5)


def ranks(pieces: DataFrame, counts: dict[int, int], ties: list[str], rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` with ``__rank``, 0, 1, ... within each length.

    A length's pieces are dealt over salts by hash, numbered within a salt, and
    shifted by the counts of the salts before it.
    """
    spark = pieces.sparkSession
    together = max(64, min(rank_rows, sum(counts.values()) // (8 * partitions(spark))))
    # One row for each length: at most the capacity's number of rows.
    salts = spark.createDataFrame([(k, -(-n // together)) for k, n in counts.items()] or [(0, 1)], "length long, __salts long")
    dealt = pieces.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64(*ties), "__salts"))
    sizes = dealt.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    number = F.row_number().over(W.partitionBy("length", "__salt").orderBy(*ties)) - 1
    return dealt.withColumn("__number", number).join(sizes, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__number"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, ties: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys, ranked = (plan[:, 0] << 44) + plan[:, 1], ranks(pieces, counts, list(ties))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own_rank = names.index("length"), len(names)
        for batch in batches:
            length, rank = batch.column(at).to_numpy(zero_copy_only=False), batch.column(own_rank).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(plan) else plan
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_documents(df: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces with their places and, if asked for, their ids: ``ids``, four bytes each, little endian.

    Ids are joined to the placed pieces by a row number, so they are not sorted for the ranks.
    """
    if not with_ids:
        return pack(materialize(token_pieces(df, capacity), "pieces"), capacity)
    pieces = materialize(token_pieces(df, capacity, with_ids=True).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    return placed.join(pieces.select("__row", "ids"), "__row").drop("__row")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
