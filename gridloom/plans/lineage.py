"""Who reads whom in tables of cells: direct reads, and all that follows from them.

Cells come as ``book, row, col, input`` (rows and columns from 0), many books at once. A
formula's references are taken from its text by built-in functions; each is a rectangle,
of one cell or more, and cells are joined with rectangles by tiles. What depends on a
cell, or what it depends on, is found round by round from the last round's new cells,
by sweeps that ask whether a rectangle holds any, not which; each round is written to
the shared folder.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tiles import blocks, contained, covered, holding
from gridloom.sources.scratch import stored

_REF = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}"
#: A formula's parts: texts, references to other sheets, areas and cells of this one (the only group), names, anything else.
PARTS = rf"""(?:"(?:[^"]|"")*"|(?:'(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_.]*)!{_REF}(?::{_REF})?|({_REF}\s*:\s*{_REF}(?![A-Za-z0-9_.(])|{_REF}(?![A-Za-z0-9_.(]))|[A-Za-z_][A-Za-z0-9_.]*|[^"'$A-Za-z_]+|.)"""
CELL = ["book", "row", "col"]


def _column(ref: Column) -> Column:
    letters = F.lpad(F.upper(F.translate(ref, "$0123456789", "")), 3, "@")  # the sign before A, which counts 0
    return sum(((F.ascii(F.substring(letters, k, 1)) - 64) * 26 ** (3 - k) for k in (1, 2, 3)), F.lit(-1))


def _row(ref: Column) -> Column:
    return F.translate(F.upper(ref), f"${string.ascii_uppercase}", "").cast("int") - 1


def reads(cells: DataFrame) -> DataFrame:
    """``book, reader_row, reader_col, r0, c0, r1, c1``: the rectangles that each formula reads on its own sheet."""
    formulas = cells.where(F.startswith("input", F.lit("=")))
    parts = F.array_remove(F.regexp_extract_all("input", F.lit(PARTS), 1), "")
    found = formulas.select("book", F.col("row").alias("reader_row"), F.col("col").alias("reader_col"), F.explode(F.array_distinct(parts)).alias("part"))
    ends = F.split("part", r"\s*:\s*")
    a, b = ends[0], F.coalesce(F.get(ends, F.lit(1)), ends[0])
    low, high = (lambda f: F.least(f(a), f(b))), (lambda f: F.greatest(f(a), f(b)))
    return found.select("book", "reader_row", "reader_col", low(_row).alias("r0"), low(_column).alias("c0"), high(_row).alias("r1"), high(_column).alias("c1"))


def edges(cells: DataFrame) -> DataFrame:
    """``book, row, col, reader_row, reader_col``: filled cells and the formulas that read them directly."""
    return contained(cells.select(*CELL), reads(cells), ["book"]).select(*CELL, "reader_row", "reader_col").distinct()


def unsent(df: DataFrame) -> DataFrame:
    """For a join that must not send ``df`` to the driver and all executors: what is stored takes up many times the size of its files."""
    return df.hint("merge")


def closure(cells: DataFrame, start: DataFrame, upwards: bool = False) -> DataFrame:
    """``book, row, col, step``: what depends on the cells of ``start``, or with ``upwards`` what they depend on.

    ``step`` is the least number of reads between; the cells of ``start`` themselves are
    in only if they depend on themselves through others.
    """
    areas = stored(blocks(reads(cells)))
    levels, last = areas.agg(F.collect_set("level"), F.coalesce(F.max("r1"), F.lit(0))).first()
    filled = stored(cells.select(*CELL)) if upwards else None
    reader = [F.col("reader_row").alias("row"), F.col("reader_col").alias("col")]

    def next_of(frontier: DataFrame) -> DataFrame:
        if upwards:
            own = frontier.select("book", F.col("row").alias("reader_row"), F.col("col").alias("reader_col"))
            return covered(filled, areas.join(unsent(own), ["book", "reader_row", "reader_col"]), ["book"], levels, last).select(*CELL)
        return holding(areas, frontier, ["book"], levels, last).select("book", *reader)

    frontier, step, known = start.select(*CELL).distinct(), 0, None
    while True:
        step += 1
        new = next_of(frontier).distinct()
        new = stored((new if known is None else new.join(unsent(known), CELL, "left_anti")).withColumn("step", F.lit(step)))
        if new.isEmpty():
            return known if known is not None else new
        known, frontier = (new if known is None else known.unionByName(new)), new.select(*CELL)


def dirty(cells: DataFrame, edited: DataFrame) -> DataFrame:
    """Formulas to compute anew after edits: edited formulas and all that depends on edits."""
    own = cells.where(F.startswith("input", F.lit("="))).join(edited.select(*CELL).distinct(), CELL, "left_semi").select(*CELL)
    return closure(cells, edited).select(*CELL).unionByName(own).distinct()
