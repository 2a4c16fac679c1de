"""Conditional formats of a whole sheet: rules over rectangles, the later rule first where they overlap.

Cells are joined with the rules' areas by tiles, so areas are never laid out cell by cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import ROW
from gridloom.operators.tiles import contained

#: Areas of more cells are left out.
MOST = 200_000


def cells_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A sheet's numbers as ``row, col, value``; blanks are no cells."""
    values = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("col", "value")
    return df.select(F.col(ROW).alias("row"), values).where("value IS NOT NULL")


def hit(op: Column, value: Column, a: Column, b: Column) -> Column:
    """A rule's comparison, where the operator is a column too."""
    low, high = F.least(a, b), F.greatest(a, b)
    tests = {"greaterThan": value > a, "lessThan": value < a, "greaterThanOrEqual": value >= a, "lessThanOrEqual": value <= a, "equal": value == a, "notEqual": value != a, "between": value.between(low, high), "notBetween": ~value.between(low, high)}
    out = None
    for name, test in tests.items():
        out = F.when(op == name, test) if out is None else out.when(op == name, test)
    return F.coalesce(out, F.lit(False))


def mixed(t: Column, low: Column, high: Column) -> Column:
    """RRGGBB between two colours."""
    channel = lambda c, i: F.conv(F.substring(c, 1 + 2 * i, 2), 16, 10).cast("double")
    return F.concat(*[F.lpad(F.hex(F.floor(channel(low, i) + (channel(high, i) - channel(low, i)) * t + 0.5).cast("long")), 2, "0") for i in range(3)])


def formatted(cells: DataFrame, rules: DataFrame, most: int = MOST) -> DataFrame:
    """``row, col, rule, color`` of the cells that a rule colours.

    ``rules``: ``rule`` (its place, the last wins), ``r0, c0, r1, c1``, ``op`` (a comparison
    or ``scale``), ``a, b`` (bounds), ``color`` and, for a scale, ``color2``. A scale goes
    from the area's least to its greatest number; a flat one has its middle.
    """
    size = (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1)
    met = contained(cells, rules.where(size <= most))
    scale = F.col("op") == "scale"
    ends = met.where(scale).groupBy("rule").agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    scaled = met.where(scale).join(ends, "rule")
    t = F.when(F.col("__high") > F.col("__low"), (F.col("value") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.5)
    scaled = scaled.select("row", "col", "rule", mixed(t, F.col("color"), F.col("color2")).alias("color"))
    compared = met.where(~scale & hit(F.col("op"), F.col("value"), F.col("a"), F.col("b"))).select("row", "col", "rule", "color")
    last = compared.unionByName(scaled).groupBy("row", "col").agg(F.max(F.struct("rule", "color")).alias("last"))
    return last.select("row", "col", "last.rule", "last.color")
