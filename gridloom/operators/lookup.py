"""Lookups as joins and positional functions as windows or top-k.

``probe`` and ``table`` are DataFrames; ``ordinal`` is the column that orders the
table's rows, as a relation has no order of its own. A lookup gives each probe row one
match at most. The table side is reduced to one row per key before the join; whether
it is broadcast is left to the optimizer, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _key(df: DataFrame, name: str, exact_text: bool = False) -> Column:
    """Text keys match whatever their case."""
    col = F.col(f"`{name}`")
    return F.lower(col) if df.schema[name].dataType.typeName() == "string" and not exact_text else col


def vlookup(probe: DataFrame, key: str, table: DataFrame, table_key: str, result: str, ordinal: str, alias: str | None = None) -> DataFrame:
    """The result of the first row whose key is equal; null where there is none (``#N/A``)."""
    first = table.groupBy(_key(table, table_key).alias("__key")).agg(F.min_by(result, ordinal).alias(alias or result))
    return probe.withColumn("__key", _key(probe, key)).join(first, "__key", "left").drop("__key")


def xlookup(probe: DataFrame, key: str, table: DataFrame, table_key: str, result: str, ordinal: str, default, alias: str | None = None) -> DataFrame:
    """Exact on the displayed text, case included; ``default`` where there is no match."""
    first = table.groupBy(F.col(table_key).cast("string").alias("__key")).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(result).alias("v"))).alias("__hit"))
    joined = probe.withColumn("__key", F.col(key).cast("string")).join(first, "__key", "left")
    return joined.withColumn(alias or result, F.when(F.col("__hit").isNull(), F.lit(default)).otherwise(F.col("__hit.v"))).drop("__key", "__hit")


def hlookup(probe: DataFrame, key: str, wide: DataFrame, row: int, ordinal: str, alias: str = "value") -> DataFrame:
    """Over a table that lies on its side: its first row holds the keys, row ``row`` (from 1) the results."""
    names = [c for c in wide.columns if c != ordinal]
    ranked = wide.orderBy(ordinal).limit(row).withColumn("__r", F.row_number().over(W.orderBy(ordinal)))  # `row` rows
    long = ranked.select("__r", F.posexplode(F.array(*[F.col(c).cast("string") for c in names])).alias("pos", "v"))
    pairs = long.groupBy("pos").agg(F.max(F.when(F.col("__r") == 1, F.col("v"))).alias("__k"), F.max(F.when(F.col("__r") == row, F.col("v"))).alias(alias))
    return vlookup(probe.withColumn("__probe", F.col(key).cast("string")), "__probe", pairs, "__k", alias, "pos").drop("__probe")


def ranges_of(df: DataFrame, column: str) -> list:
    """Cuts of a column into as many ranges as there are shuffle partitions: one number, or text, for each.

    Numbers are cut by approximate quantiles, other kinds by the least values of a sample
    of ranges that Spark makes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    if df.schema[column].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte"):
        return sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.01)))
    cut = df.select(F.col(f"`{column}`").alias("c")).where("c IS NOT NULL").repartitionByRange(n, "c").groupBy(F.spark_partition_id()).agg(F.min("c").alias("c")).collect()
    return sorted({r["c"] for r in cut})[1:]


#: Up to so many cuts are compared in generated code; more would make the plan grow with the cluster.
TREE = 32


def range_of(col: Column, cuts: list) -> Column:
    """How many cuts are at most the value, found by halving; 0 for nulls.

    Many cuts are one array, which a fold of a step for each halving looks up.
    """

    def halved(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col >= F.lit(cuts[mid]), halved(mid + 1, hi)).otherwise(halved(lo, mid))

    if len(cuts) <= TREE:
        return halved(0, len(cuts))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    held = F.lit(cuts)
    at_most = lambda n: F.coalesce(F.get(held, n - 1) <= col, F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(at_most(low + step), low + step).otherwise(low))


def before_range(counts: DataFrame, keys: list[str], n: str, alias: str) -> DataFrame:
    """Counts by range with the sum of the ranges before; as many rows as there are ranges, for each of the keys."""
    w = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*keys, "__range", F.coalesce(F.sum(n).over(w), F.lit(0)).alias(alias))


def numbered(df: DataFrame, ordinal: str, alias: str) -> DataFrame:
    """``df`` with the rows' places by an ordinal, from 1, as numbers; counted within ranges and carried on."""
    cuts = ranges_of(df, ordinal)
    dealt = df.withColumn("__range", range_of(F.col(f"`{ordinal}`"), cuts))
    starts = before_range(dealt.groupBy("__range").agg(F.count("*").alias("__n")), [], "__n", "__before")
    place = F.row_number().over(W.partitionBy("__range").orderBy(F.col(f"`{ordinal}`").asc_nulls_first()))
    return dealt.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(alias, (F.col("__before") + F.col("__place")).cast("double")).drop("__range", "__before", "__place")  # one row per range


def lookup_sorted(probe: DataFrame, key: str, table: DataFrame, table_key: str, result: str, alias: str | None = None, ordinal: str | None = None) -> DataFrame:
    """The result at the last key that is at most the probe's: an as-of join on an ascending key.

    Of rows with one key the last by ``ordinal`` counts (the greatest result without one).
    Both sides are cut into ranges of the key and swept once within a range; the last
    key before a range is carried in from a table with one row per range. So the work
    is spread over tasks, although there is but one order. Probes of one key go
    through the sweep once, so a frequent key is no hot spot.
    """
    name = alias or result
    text = table.schema[table_key].dataType.typeName() == "string"
    as_key = (lambda c: F.lower(c)) if text else (lambda c: F.col(c).cast("double"))
    last_of = F.max_by(result, ordinal) if ordinal else F.max(result)
    right = table.where(F.col(table_key).isNotNull()).groupBy(as_key(table_key).alias("__k")).agg(last_of.alias("__v"))
    cuts = ranges_of(right, "__k")
    left = probe.select(as_key(key).alias("__k")).where("__k IS NOT NULL").distinct()
    both = left.select("__k", F.lit(None).cast(right.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(right.withColumn("__side", F.lit(0)))
    both = both.withColumn("__range", range_of(F.col("__k"), cuts))
    last = right.withColumn("__range", range_of(F.col("__k"), cuts)).groupBy("__range").agg(F.max(F.struct("__k", F.struct("__v").alias("v"))).alias("__l"))
    # One row per range; a range gets the last of all before it.
    ends = last.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__to"))
    carried = last.join(F.broadcast(ends), F.col("__range") < F.col("__to")).groupBy("__to").agg(F.max("__l").alias("__in")).withColumnRenamed("__to", "__range")
    w = W.partitionBy("__range").orderBy("__k", "__side").rowsBetween(W.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("__side") == 0, F.struct("__v")), ignorenulls=True).over(w)
    swept = both.withColumn("__hit", hit).where(F.col("__side") == 1).join(F.broadcast(carried), "__range", "left")
    found = swept.select("__k", F.coalesce(F.col("__hit.__v"), F.col("__in.v.__v")).alias(name))
    return probe.withColumn("__k", as_key(key)).join(found, "__k", "left").drop("__k")


def match_before_greater(table: DataFrame, column: str, ordinal: str, key) -> DataFrame:
    """``MATCH(key, column, 1)`` on any order: the place before the first greater key; null for none."""
    n = F.count("*")
    first = F.min(F.when(F.col(column) > F.lit(key), F.col(ordinal)))
    place = F.coalesce(first, n + F.min(ordinal)) - F.min(ordinal)
    return table.agg(F.when(place > 0, place.cast("double")).alias("match"))


def match_exact(table: DataFrame, column: str, ordinal: str, key) -> DataFrame:
    own = F.lower(F.col(column)) == F.lower(F.lit(key)) if isinstance(key, str) else F.col(column) == F.lit(key)
    return table.agg((F.min(F.when(own, F.col(ordinal))) - F.min(ordinal) + 1).cast("double").alias("match"))


def match_descending(table: DataFrame, column: str, ordinal: str, key) -> DataFrame:
    """``MATCH(key, column, -1)``: the place before the first smaller key."""
    first = F.min(F.when(F.col(column) < F.lit(key), F.col(ordinal)))
    place = F.coalesce(first, F.count("*") + F.min(ordinal)) - F.min(ordinal)
    return table.agg(F.when(place > 0, place.cast("double")).alias("match"))


def index(table: DataFrame, column: str, ordinal: str, row: int) -> DataFrame:
    """``INDEX``: the cell of the given row, from 1."""
    start = table.agg(F.min(ordinal).alias("__start"))
    return table.join(F.broadcast(start)).where(F.col(ordinal) == F.col("__start") + row - 1).select(F.col(column).alias("value"))  # one row


def having(probe: DataFrame, key: str, table: DataFrame, table_key: str, found: bool = True) -> DataFrame:
    """Rows whose key the table has (``COUNTIF > 0``), or has not."""
    return probe.join(table.select(_key(table, table_key).alias("__key")), _key(probe, key) == F.col("__key"), "left_semi" if found else "left_anti")


def ranks_of(df: DataFrame, column: str, ascending: bool, keys: list[str], alias: str) -> DataFrame:
    """``keys, column, alias``: the rank of each distinct value, 1 and how many rows are better.

    Counts per distinct value are summed up within ranges of the values, and each
    range's sum is carried into the next, so no task sweeps all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    cuts = ranges_of(df, column)
    at = range_of(F.col(column), cuts)
    counts = counts.withColumn("__range", at if ascending else F.lit(len(cuts)) - at)
    starts = before_range(counts.groupBy(*keys, "__range").agg(F.sum("__n").alias("__all")), keys, "__all", "__before")
    order = F.col(column).asc() if ascending else F.col(column).desc()
    better = F.coalesce(F.sum("__n").over(W.partitionBy(*keys, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__own", better).join(starts, [*keys, "__range"]).select(*keys, column, (F.col("__before") + F.col("__own") + 1).cast("double").alias(alias))


def rank(df: DataFrame, column: str, ascending: bool = False, by: list[str] | None = None, alias: str = "rank") -> DataFrame:
    """Competition rank of every row: 1 and how many are better."""
    keys = by or []
    return df.join(ranks_of(df, column, ascending, keys, alias), [*keys, column], "left")


def large(df: DataFrame, column: str, k: int, smallest: bool = False) -> DataFrame:
    """The k-th largest (or smallest) value: a top-k, of which the last is kept. No row: ``#NUM!``."""
    order = F.col(column).asc() if smallest else F.col(column).desc()
    top = df.where(F.col(column).isNotNull()).select(column).orderBy(order).limit(k)
    end = F.max(column) if smallest else F.min(column)
    return top.agg(F.count("*").alias("__n"), end.alias("value")).where(F.col("__n") == k).select("value")


def median(df: DataFrame, value: str, by: list[str], alias: str = "median", accuracy: int = 10_000) -> DataFrame:
    """``by, alias``: the exact median of each group, null where a group has no value; one row without ``by``.

    Approximate quantiles bracket each group's middle; what lies below and above the
    bracket is counted, and only the distinct values inside, a few in ``accuracy`` of the
    group's rows, are ranked with their counts.
    """
    v, step = F.col(value), 2 / accuracy
    groups = df.groupBy(*by).agg(F.percentile_approx(v, F.lit([0.5 - step, 0.5 + step]), F.lit(accuracy)).alias("__ends"))
    ends = groups.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(by)], F.col("__ends")[0].alias("__low"), F.col("__ends")[1].alias("__high"))
    rows = df.where(v.isNotNull())
    if by:
        same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(by)]
        rows = rows.join(ends, same, "inner")
    else:
        rows = rows.join(F.broadcast(ends))  # one row
    side = F.when(v < F.col("__low"), -1).when(v > F.col("__high"), 1).otherwise(0)
    counts = rows.groupBy(*by, side.alias("__side"), F.when(side == 0, v).alias("__x")).agg(F.count("*").alias("__n"))
    group = W.partitionBy(*by)
    run = counts.withColumn("__to", F.sum("__n").over(group.orderBy("__side", "__x"))).withColumn("__all", F.sum("__n").over(group)).where("__side = 0")
    at = lambda r: F.min(F.when(F.col("__to") >= r, F.col("__x")))
    found = run.groupBy(*by).agg(((at(F.floor((F.col("__all") + 1) / 2)) + at(F.floor(F.col("__all") / 2) + 1)) / 2).alias(alias))
    if not by:
        return found
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    left = groups.select(*by)
    return left.join(found.select(*own, alias), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)], "left").select(*by, alias)


def mode(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """The most frequent value that occurs twice at least; of several the one that comes first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(ordinal).alias("o")).where("n > 1")
    return counts.orderBy(F.desc("n"), "o").limit(1).select(F.col(column).alias("value"))


def unique(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Distinct values in order of appearance."""
    return df.groupBy(column).agg(F.min(ordinal).alias("first")).orderBy("first").select(F.col(column).alias("value"), "first")


def sort_values(df: DataFrame, column: str, ordinal: str, descending: bool = False) -> DataFrame:
    col = F.lower(column) if df.schema[column].dataType.typeName() == "string" else F.col(column)
    return df.select(F.col(column).alias("value"), ordinal).orderBy(col.desc() if descending else col.asc(), ordinal)


def sorted_places(df: DataFrame, column: str, ordinal: str, descending: bool = False) -> DataFrame:
    """``df`` with ``__place``, the rows' places by the column's values, ties by the ordinal."""
    kind = df.schema[column].dataType.typeName()
    keyed = df.withColumn("__value", F.lower(column) if kind == "string" else F.col(column))
    cuts = ranges_of(keyed, "__value")
    at = range_of(F.col("__value"), cuts)
    dealt = keyed.withColumn("__range", F.lit(len(cuts)) - at if descending else at)
    starts = before_range(dealt.groupBy("__range").agg(F.count("*").alias("__n")), [], "__n", "__before")
    order = F.col("__value").desc_nulls_last() if descending else F.col("__value").asc_nulls_last()
    placed = dealt.withColumn("__p", F.row_number().over(W.partitionBy("__range").orderBy(order, ordinal))).join(F.broadcast(starts), "__range")  # one row per range
    # Nulls are in the range of no cut, which comes first upwards; they belong last.
    return placed.withColumn("__place", F.when(F.col("__value").isNull(), F.lit(1 << 62)).otherwise(F.col("__before") + F.col("__p")).cast("long")).drop("__value", "__range", "__before", "__p")


def npv(df: DataFrame, rate: float, value: str, ordinal: str, by: list[str] | None = None, place: str | None = None) -> DataFrame:
    """Present value of payments in order; a payment's place is its rank within its group, or given."""
    keys = by or []
    placed = df.where(F.col(value).isNotNull()).withColumn("__i", F.col(place) if place else F.row_number().over(W.partitionBy(*keys).orderBy(ordinal)))
    return placed.groupBy(*keys).agg(F.sum(F.col(value) / F.pow(F.lit(1 + rate), F.col("__i"))).alias("npv"))


def running_total(df: DataFrame, value: str, ordinal: str, by: list[str]) -> DataFrame:
    """A filled-down ``SUM(A$1:A5)``: a frame from the start to the row, within ranges of the ordinal and carried on."""
    cuts = ranges_of(df, ordinal)
    dealt = df.withColumn("__range", range_of(F.col(ordinal), cuts))
    starts = before_range(dealt.groupBy(*by, "__range").agg(F.sum(value).alias("__all")), by, "__all", "__before")
    own = F.sum(value).over(W.partitionBy(*by, "__range").orderBy(ordinal).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(starts, [*by, "__range"]).withColumn("running", F.col("__before") + F.coalesce("__own", F.lit(0.0))).drop("__range", "__own", "__before")


def text_join(df: DataFrame, delimiter: str, value: str, ordinal: str, by: list[str], ignore_empty: bool = True) -> DataFrame:
    """``TEXTJOIN`` down a column in order, per group; a group's text is one cell."""
    rows = df.where(F.coalesce(F.col(value), F.lit("")) != "") if ignore_empty else df
    parts = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.coalesce(F.col(value), F.lit("")).alias("v"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["v"]), delimiter).alias("joined"))


def sequence(spark, rows: int, cols: int = 1, start: float = 1.0, step: float = 1.0) -> DataFrame:
    """``SEQUENCE`` row by row: (row, col, value).

    Any number of cells: the limit of arrays in a single cell is one of a process's memory.
    """
    i = F.col("id")
    return spark.range(rows * cols).select(F.floor(i / cols).alias("row"), (i % cols).alias("col"), (start + step * i).alias("value"))


def gcd(df: DataFrame, column: str, by: list[str], salts: int = 64) -> DataFrame:
    """Greatest common divisor of each group's whole parts: folded for each of the salts, then over these."""
    own = F.abs(F.col(column)).cast("long")
    rows = df.where(F.col(column).isNotNull()).select(*by, own.alias("__v")).distinct().withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(salts)))
    fold = lambda c: F.aggregate(F.collect_list(c), F.lit(0).cast("long"), euclid)
    parts = rows.groupBy(*by, "__salt").agg(fold("__v").alias("__v"))
    return parts.groupBy(*by).agg(fold("__v").cast("double").alias("gcd"))


def euclid(a: Column, b: Column) -> Column:
    """The greatest common divisor of two whole numbers."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b")))
    return pair["a"]
