"""A grid in packed form: one text and its offsets for each stretch of rows, checked on reading.

``pack`` gives a row for each ``chunk`` consecutive row numbers: all cells' text in one
piece of UTF-8, where each cell ends in it (bytes), where each row's cells start, the
number of columns and each column's display width. Rows that are short of fields stay
short. ``unpack`` checks a stretch before it cuts it up; what does not fit together ends
the job with the reason. The form is a table, so it is written, read and shuffled as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import MIN_WIDTH, MAX_WIDTH, ROW, WIDE_RANGES, cell_text

CHUNK = 4096
PACKED = "chunk long, numbers array<long>, text binary, cell_ends array<int>, row_starts array<int>, cols int, widths array<int>"


class CorruptPacked(ValueError):
    """``reason`` tells which of a stretch's parts do not fit."""

    def __init__(self, reason: str):
        super().__init__(f"corrupt_packed: {reason}")
        self.reason = reason


def width(text: str) -> int:
    """Places that a text takes; wide characters take two."""
    return len(text) if text.isascii() else len(text) + sum(any(a <= ord(c) <= b for a, b in WIDE_RANGES) for c in text)


def pack(df: DataFrame, chunk: int = CHUNK, fields: str | None = None) -> DataFrame:
    """:data:`PACKED` of a grid's columns, or of its column ``fields``, an array of texts for each row."""
    names = [c for c in df.columns if c != ROW]
    cells = F.col(fields) if fields else F.array(*[cell_text(df, c) for c in names])
    least = 0 if fields else len(names)
    rows = df.select(F.floor(F.col(ROW) / chunk).cast("long").alias("chunk"), F.col(ROW).cast("long").alias(ROW), cells.alias("cells"))
    ordered = rows.repartition("chunk").sortWithinPartitions("chunk", ROW)

    def one(key: int, numbers: list[int], rows: list[list[str]]) -> dict:
        raw = [[(c or "").encode() for c in r] for r in rows]
        cols = max([least, *map(len, raw)])
        ends = np.cumsum([len(c) for r in raw for c in r], dtype=np.int64)
        widths = [MIN_WIDTH] * cols
        for r in rows:
            for k, c in enumerate(r):
                widths[k] = max(widths[k], width(c or ""))
        return {"chunk": key, "numbers": numbers, "text": b"".join(c for r in raw for c in r), "cell_ends": ends.tolist(), "row_starts": [0, *np.cumsum([len(r) for r in raw]).tolist()], "cols": cols, "widths": [min(w, MAX_WIDTH) for w in widths]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, rows = None, [], []
        for batch in batches:
            for k, n, cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key and numbers:
                    yield pa.RecordBatch.from_pylist([one(key, numbers, rows)], schema=SCHEMA)
                    numbers, rows = [], []
                key = k
                numbers.append(n)
                rows.append(cells or [])
        if numbers:
            yield pa.RecordBatch.from_pylist([one(key, numbers, rows)], schema=SCHEMA)

    return ordered.select("chunk", ROW, "cells").mapInArrow(run, PACKED)


_INTS = pa.list_(pa.int32())
SCHEMA = pa.schema([("chunk", pa.int64()), ("numbers", pa.list_(pa.int64())), ("text", pa.binary()), ("cell_ends", _INTS), ("row_starts", _INTS), ("cols", pa.int32()), ("widths", _INTS)])


def checked(text: bytes, cell_ends: list[int], row_starts: list[int], cols: int, widths: list[int], numbers: list[int]) -> list[list[str]]:
    """A stretch's rows, or :class:`CorruptPacked`."""
    ends, starts = np.array(cell_ends, np.int64), np.array(row_starts, np.int64)
    try:
        text.decode()
    except UnicodeDecodeError:
        raise CorruptPacked("text is not UTF-8") from None
    if not len(starts):
        raise CorruptPacked("no row starts")
    if len(widths) != cols:
        raise CorruptPacked("widths and columns differ")
    if starts[-1] != len(ends):
        raise CorruptPacked("last row start and number of cells differ")
    if (np.diff(starts) < 0).any():
        raise CorruptPacked("row starts fall")
    if (np.diff(ends) < 0).any():
        raise CorruptPacked("cell ends fall")
    if (ends[-1] if len(ends) else 0) != len(text):
        raise CorruptPacked("last cell end and length of text differ")
    if len(numbers) != len(starts) - 1 or np.diff(starts).max(initial=0) > cols:
        raise CorruptPacked("rows do not fit")
    cuts = [0, *cell_ends]
    try:
        cells = [text[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
    except UnicodeDecodeError:
        raise CorruptPacked("a cell ends inside a character") from None
    return [cells[a:b] for a, b in zip(row_starts, row_starts[1:], strict=False)]


def unpack(packed: DataFrame) -> DataFrame:
    """``_row, fields`` of packed stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = checked(r["text"], r["cell_ends"], r["row_starts"], r["cols"], r["widths"], r["numbers"])
                yield pa.RecordBatch.from_arrays([pa.array(r["numbers"], pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=[ROW, "fields"])

    return packed.select("numbers", "text", "cell_ends", "row_starts", "cols", "widths").mapInArrow(run, f"{ROW} long, fields array<string>")


def widths_of(packed: DataFrame) -> DataFrame:
    """``col, width`` over all stretches."""
    return packed.select(F.posexplode("widths").alias("col", "width")).groupBy("col").agg(F.max("width").alias("width"))
