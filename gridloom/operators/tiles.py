"""Which cells lie in which rectangles: an equality join on tiles of a size with the rectangle.

A rectangle belongs to the level of its longer side, a power of two, and covers four
tiles of that level at most, however large it is. A cell is in one tile of each level
that occurs, of which there are 21 at most.

Which areas hold any cell at all, and which cells lie in any area, is found without the
pairs: areas are cut into blocks of columns, and each block's rows are swept once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AREA = ("r0", "c0", "r1", "c1")


def _tile(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c.cast("long"), level)


def tiled(areas: DataFrame) -> DataFrame:
    """Areas ``r0, c0, r1, c1`` with each tile that they touch."""
    side = F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")).cast("long")
    # The least power of two that is over the longer side's last distance.
    level = F.when(side == 0, 0).otherwise(F.length(F.bin(side))).cast("int")
    made = areas.withColumn("__level", level)
    across = [F.sequence(_tile(F.col(f"{x}0"), F.col("__level")), _tile(F.col(f"{x}1"), F.col("__level"))) for x in "rc"]
    return made.withColumn("__tr", F.explode(across[0])).withColumn("__tc", F.explode(across[1]))


def contained(cells: DataFrame, areas: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Cells (``row``, ``col`` and more) joined with the areas that hold them, of equal ``on``; the areas' own columns besides."""
    placed = tiled(areas)
    levels = sorted(r[0] for r in placed.select("__level").distinct().collect())  # at most 21
    if not levels:
        levels = [0]
    keyed = cells.withColumn("__level", F.explode(F.lit(levels)))
    keyed = keyed.withColumn("__tr", _tile(F.col("row"), F.col("__level"))).withColumn("__tc", _tile(F.col("col"), F.col("__level")))
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return keyed.join(placed, [*on, "__level", "__tr", "__tc"]).where(inside).drop("__level", "__tr", "__tc")


#: A block's rows are swept in ranges of so many cells, two to this power.
RANGE = 14


def blocks(areas: DataFrame) -> DataFrame:
    """Areas with ``level, block`` for each block of columns that they are made of: the ``block``-th of width two to the ``level``, two of a level at most."""
    c0, c1 = F.col("c0").cast("int"), F.col("c1").cast("int")
    shift = lambda c, n: F.call_function("shiftright", c, n)

    def of(level: Column) -> Column:
        low, high = shift(c0 + F.call_function("shiftleft", F.lit(1), level) - 1, level), shift(c1 + 1, level)
        own = lambda test, block: F.when((low < high) & test, F.struct(level.alias("level"), block.alias("block")))
        return F.array_compact(F.array(own(low % 2 == 1, low), own(high % 2 == 1, high - 1)))

    one = F.array(F.struct(F.lit(0).alias("level"), c0.alias("block")))
    made = F.when(c0 == c1, one).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(c1 + 1))), of)))
    return areas.withColumn("__b", F.explode(made)).select(*areas.columns, "__b.level", "__b.block")


def placed(cells: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Cells with the block of columns that they are in, for each of the levels."""
    return cells.withColumn("level", F.explode(F.lit(sorted(levels) or [0]))).withColumn("block", F.call_function("shiftright", F.col("col").cast("int"), F.col("level")))


def up_to(values: DataFrame, probes: DataFrame, keys: Sequence[str], levels: Sequence[int], last: int) -> DataFrame:
    """Probes with ``__most``: the greatest ``__v`` of the values of equal keys that stand at the probe's ``__at`` or before.

    Swept within ranges of rows, each of which gets the greatest value of those before
    it; none does where the ``last`` row of any area is in the first range of all levels.
    """
    values = values.groupBy(*keys, "__at").agg(F.max("__v").alias("__v"))
    both = values.withColumn("__side", F.lit(0)).unionByName(probes.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("__range", _tile(F.col("__at"), F.greatest(F.lit(0), F.lit(RANGE) - F.col("level"))))
    own = F.max("__v").over(W.partitionBy(*keys, "__range").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0))
    swept = both.withColumn("__most", own).where("__side = 1").drop("__v", "__side")
    if last >> max(0, RANGE - max(levels, default=0)):
        before = F.max("__v").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
        tops = both.groupBy(*keys, "__range").agg(F.max("__v").alias("__v")).select(*keys, "__range", before.alias("__in"))
        swept = swept.join(tops.where("__in IS NOT NULL").hint("merge"), [*keys, "__range"], "left").withColumn("__most", F.greatest("__most", "__in")).drop("__in")
    return swept.drop("__range")


def holding(areas: DataFrame, cells: DataFrame, on: Sequence[str], levels: Sequence[int], last: int) -> DataFrame:
    """Blocks of areas (see ``blocks``) that hold any of the cells: the last cell up to the area's end is not before its start."""
    keys = [*on, "level", "block"]
    values = placed(cells, levels).select(*keys, F.col("row").alias("__at"), F.col("row").alias("__v"))
    first = areas.groupBy(*keys, F.col("r1").alias("__at")).agg(F.min("r0").alias("__first"))
    ends = up_to(values, first, keys, levels, last).where("__most >= __first").drop("__first")
    return areas.withColumn("__at", F.col("r1")).join(ends.hint("merge"), [*keys, "__at"]).where("__most >= r0").drop("__at", "__most")


def covered(cells: DataFrame, areas: DataFrame, on: Sequence[str], levels: Sequence[int], last: int) -> DataFrame:
    """Cells that lie in any of the areas' blocks, once for each block: of the areas that start up to the cell, one ends at it or later."""
    keys = [*on, "level", "block"]
    values = areas.select(*keys, F.col("r0").alias("__at"), F.col("r1").alias("__v"))
    probes = placed(cells, levels).withColumn("__at", F.col("row"))
    return up_to(values, probes, keys, levels, last).where("__most >= row").select(*cells.columns)
