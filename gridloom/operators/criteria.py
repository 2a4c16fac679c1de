"""Aggregates under criteria that vary by row: ``SUMIF(o.key, k, o.value)`` for each ``k``.

Cells and criteria are first reduced to distinct ones. A criterion of equality is a
grouped aggregate and a join. One of order (``"<"&x``) is an as-of lookup in running
aggregates: cells and criteria are swept once within ranges of the cells, and what
comes before a range is carried in. Further criteria of order are taken down to equality:
a cell's rank among its column's values lies in one node of each level of a binary tree
over the ranks, and the ranks up to a bound are the disjoint union of one node for each
bit of the bound, so what remains is the same problem of one criterion less, for the
cells and criteria of a node. A pattern is joined with the values that hold its longest
literal part's first characters, and verified. No step compares all cells with all
criteria.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.lookup import range_of, ranges_of

NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Rows, numbers among the values, and their sum, maximum and minimum.
MEASURES = {"__rows": F.sum, "__n": F.sum, "__sum": F.sum, "__max": F.max, "__min": F.min}
#: Characters of a pattern that cells are looked up by.
GRAM = 3


@dataclass(frozen=True)
class Range:
    """A column under a criterion: its cells as numbers (null: none), as lower-case text, and as truth values if they are."""

    number: Column
    text: Column
    flag: Column | None = None


def combined(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(m).alias(m) for m, f in MEASURES.items()])


def swept(points: DataFrame, probes: DataFrame, equal: list[str], name: str, up: bool) -> DataFrame:
    """``__id`` and measures: for each probe the points of equal ``equal`` below (or above) the probe's ``name``.

    ``<name>_with`` of a probe tells whether equal points count.
    """
    cuts = ranges_of(points, name)
    at = range_of(F.col(name), cuts)
    side = F.when(F.col(f"{name}_with"), 3).otherwise(1)  # of equal ones, probes after or before points
    both = points.select(*equal, name, *MEASURES, F.lit(2).alias("__side")).unionByName(probes.select(*equal, name, "__id", side.alias("__side")), allowMissingColumns=True)
    both = both.withColumn("__range", at if up else F.lit(len(cuts)) - at)
    order = F.col(name).asc() if up else F.col(name).desc()
    here = W.partitionBy(*equal, "__range").orderBy(order, "__side").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*equal).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = combined(both, [*equal, "__range"]).select(*equal, "__range", *[f(m).over(before).alias(f"{m}_in") for m, f in MEASURES.items()])
    own = both.select(*equal, "__range", "__id", "__side", *[f(m).over(here).alias(m) for m, f in MEASURES.items()]).where("__side <> 2")
    joined = own.join(carried, [*equal, "__range"])
    plus = lambda m: F.when(F.col(m).isNull() | F.col(f"{m}_in").isNull(), F.coalesce(m, f"{m}_in")).otherwise(F.col(m) + F.col(f"{m}_in"))
    most = {"__max": F.greatest, "__min": F.least}
    return joined.select("__id", *[most[m](m, f"{m}_in").alias(m) if m in most else plus(m).alias(m) for m in MEASURES]).where("__rows IS NOT NULL")


def matched(points: DataFrame, probes: DataFrame, equal: list[str], ordered: list[tuple[str, bool]]) -> DataFrame:
    """``__id`` and measures of the points that meet a probe on all columns, which both sides name alike; parts are not yet combined."""
    if not ordered:
        if not equal:
            return probes.select("__id").join(F.broadcast(combined(points, [])))  # one row
        return probes.join(combined(points, equal), equal).select("__id", *MEASURES)
    if len(ordered) == 1:
        return swept(points, probes, equal, *ordered[0])
    *rest, (name, up) = ordered
    one = [(F.lit(1).cast("long") if m == "__rows" else F.lit(None).cast("double")).alias(m) for m in MEASURES]
    values = points.select(name).distinct()
    among = [name, f"{name}_with"]
    ranked = lambda of: swept(values.select(name, *one), of.select(*among, F.struct(*among).alias("__id")), [], name, up).select(*[F.col(f"__id.{c}").alias(c) for c in among], F.col("__rows").alias("__rank"))
    levels = (values.count() + 1).bit_length()
    level, node = f"__level{len(ordered)}", f"__node{len(ordered)}"
    bits = F.sequence(F.lit(0), F.lit(levels - 1))
    shifted = lambda n, b: F.call_function("shiftright", n, b)
    placed = points.join(ranked(values.withColumn(f"{name}_with", F.lit(True))).drop(f"{name}_with"), name)
    placed = placed.withColumn(level, F.explode(F.filter(bits, lambda b: shifted(F.col("__rank"), b) % 2 == 0))).withColumn(node, shifted(F.col("__rank"), F.col(level)))
    bound = probes.join(ranked(probes.select(*among).distinct()), among).withColumn("__bound", F.col("__rank") + 1)
    bound = bound.withColumn(level, F.explode(F.filter(bits, lambda b: shifted(F.col("__bound"), b) % 2 == 1))).withColumn(node, shifted(F.col("__bound"), F.col(level)) - 1)
    return matched(placed.drop("__rank"), bound.drop("__rank", "__bound"), [*equal, level, node], rest)


def regex(pattern: Column) -> Column:
    quoted = F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?s)^\\Q"), F.replace(F.replace(quoted, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("?"), F.lit("\\E.\\Q")), F.lit("\\E$"))


def like(patterns: DataFrame, values: DataFrame) -> DataFrame:
    """``__pattern, __value``: which values meet which patterns, which all have a literal part."""
    literal = F.array_max(F.transform(F.split(F.col("__pattern"), r"[*?]+"), lambda s: F.struct(F.char_length(s).alias("n"), s.alias("s"))))["s"]
    asked = patterns.select("__pattern", F.left(literal, F.lit(GRAM)).alias("__gram"))
    starts = F.sequence(F.lit(1), F.char_length("__value"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.char_length("__value") - i + 1)), lambda n: F.substring("__value", i, n)))))
    held = values.where("__value <> ''").select("__value", F.explode(grams).alias("__gram"))
    return asked.join(held, "__gram").where(F.rlike("__value", regex(F.col("__pattern")))).select("__pattern", "__value")


#: Ways in which criteria of some classes are met, disjoint for a class: what of a cell is compared, how, and the classes.
#: A class is n (number), t (text), p (pattern), l (pattern without a literal) or b (truth value) with an operator.
WAYS = {
    ("number", "="): ("n=",), ("number", "<"): ("n<", "n<=", "n<>"), ("number", ">"): ("n>", "n>=", "n<>"), ("none", "="): ("n<>",), ("flag", "="): ("b=",),
    ("text", "="): ("t=",), ("text", "<"): ("t<", "t<=", "t<>"), ("text", ">"): ("t>", "t>=", "t<>"), ("pattern", "="): ("p=",), ("length", "="): ("l=",), ("length", ">"): ("l>=",),
}


def classified(probes: DataFrame, c: str) -> DataFrame:
    """With the class of a criterion as text, and its operand as a number, as text and as a pattern's length."""
    op, rest, n = f"{c}_op", f"{c}_rest", f"{c}_number"
    made = probes.withColumn(op, F.regexp_extract(F.trim(c), "^(>=|<=|<>|>|<|=)?", 1))
    made = made.withColumn(rest, F.lower(F.substring(F.trim(c), F.char_length(op) + 1, F.char_length(c)))).withColumn(op, F.when(F.col(op) == "", "=").otherwise(F.col(op)))
    made = made.withColumn(n, F.when(F.trim(rest).rlike(NUMBER_RE), F.trim(rest).try_cast("double")))
    wild = F.col(op).isin("=", "<>") & F.col(rest).rlike("[*?]")
    bare = F.col(rest).rlike(r"^[*?]*$")
    kind = F.when(F.col(n).isNotNull(), F.concat(F.lit("n"), op)).when(wild & bare & (F.col(op) == "=") & F.col(rest).contains("*"), "l>=").when(wild & bare, F.concat(F.lit("l"), op)).when(wild, F.concat(F.lit("p"), op)).otherwise(F.concat(F.lit("t"), op))
    return made.withColumns({f"{c}_class": kind, f"{c}_text": F.col(rest), f"{c}_pattern": F.col(rest), f"{c}_length": F.char_length(F.replace(rest, F.lit("*"), F.lit("")))})


OPERATORS = ("=", "<", "<=", ">", ">=", "<>")


def conditional(df: DataFrame, criteria: Sequence[Column], kinds: Sequence[str], table: DataFrame, ranges: Sequence[Range], value: Column, prefix: str) -> DataFrame:
    """``df`` with ``<prefix>rows, n, sum, max, min`` of the table's rows that meet all criteria; null where none does.

    ``criteria`` are columns of ``df``, of kinds bool, text (an operator and an operand,
    or a pattern) or an operator (then a number, NaN for a blank after the operator); a
    null criterion meets nothing. ``value`` is the table's number. A pattern after ``<>``
    ends in an error, as it has no join form.
    """
    own = [f"{prefix}c{i}" for i in range(len(criteria))]
    asked = df.withColumns(dict(zip(own, criteria, strict=True)))
    probes = asked.select(*own).distinct().where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own])).withColumn("__id", F.struct(*own))
    for c, kind in zip(own, kinds, strict=True):
        if kind == "text":
            probes = classified(probes, c)
        elif kind == "bool":
            probes = probes.withColumns({f"{c}_class": F.lit("b="), f"{c}_flag": F.col(c)})
        else:
            probes = probes.withColumns({f"{c}_class": F.when(F.isnan(c), f"t{kind}").otherwise(f"n{kind}"), f"{c}_number": F.col(c), f"{c}_text": F.lit("")})
    present = [tuple(r) for r in probes.select(*[f"{c}_class" for c in own]).distinct().collect()]  # of at most 24 classes for each criterion
    for cls in {c for row in present for c in row if c in ("p<>", "l<>")}:
        raise ValueError(f"a varying <> with a pattern has no join form ({cls})")
    choices = sorted({way for row in present for way in product(*[[w for w, cs in WAYS.items() if c in cs] for c in row])})

    cells = {}
    for i, r in enumerate(ranges):
        cells |= {f"number{i}": r.number, f"text{i}": r.text, f"flag{i}": r.flag if r.flag is not None else F.lit(None).cast("boolean")}
    measures = [F.lit(1).cast("long").alias("__rows"), value.isNotNull().cast("long").alias("__n"), value.alias("__sum"), value.alias("__max"), value.alias("__min")]
    cell_rows = table.select(*[c.alias(n) for n, c in cells.items()], *measures)
    parts = []
    for choice in choices:
        points, asking, equal, ordered = cell_rows, probes, [], []
        for i, (of, op) in enumerate(choice):
            c, key = own[i], f"k{i}"
            asking = asking.where(F.col(f"{c}_class").isin(*WAYS[of, op]))
            if of == "none":
                points = points.where(F.col(f"number{i}").isNull())
                continue
            cell = F.char_length(f"text{i}") if of == "length" else F.col(f"{'text' if of == 'pattern' else of}{i}")
            points = points.withColumn(key, cell).where(F.col(key).isNotNull())
            asking = asking.withColumn(key, F.col(f"{c}_{of}"))
            if op == "=":
                equal.append(key)
            else:
                asking = asking.withColumn(f"{key}_with", F.col(f"{c}_class").endswith("="))
                ordered.append((key, op == "<"))
            if of == "pattern":
                pairs = like(asking.select(F.col(key).alias("__pattern")).distinct(), points.select(F.col(key).alias("__value")).distinct())
                points = points.join(pairs, F.col(key) == F.col("__value")).withColumn(key, F.col("__pattern")).drop("__pattern", "__value")
        keys = [*equal, *[k for k, _ in ordered]]
        parts.append(matched(combined(points, keys), asking.select("__id", *keys, *[f"{k}_with" for k, _ in ordered]), equal, ordered))
    names = {m: f"{prefix}{m.strip('_')}" for m in MEASURES}
    if not parts:
        return df.withColumns({n: F.lit(None).cast("double") for n in names.values()})
    result = combined(reduce(DataFrame.unionByName, parts), ["__id"]) if len(parts) > 1 or any(sum(op != "=" for _, op in c) > 1 for c in choices) else parts[0]
    result = result.select(*[F.col(f"__id.{c}").alias(c) for c in own], *[F.col(m).alias(n) for m, n in names.items()])
    return asked.join(result, own, "left").drop(*own)
