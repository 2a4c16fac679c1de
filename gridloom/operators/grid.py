"""Operators of a sheet as a DataFrame: filter, sort, distinct, find, windows.

A grid is a DataFrame with a row number column (``_row``, from 0) beside its cells.
Every operator is one declarative plan: predicates reach the scan, a limit after a
sort becomes a top-k, and only the columns that are asked for are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.cells import display
from gridloom.operators.lookup import numbered, range_of, ranges_of
from gridloom.plans.compiler import NUMBER_RE, general

ROW = "_row"
MIN_WIDTH, MAX_WIDTH = 3, 60
#: The code points of the characters that take two places, first and last.
WIDE_RANGES = (
    (0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1F9FF), (0x20000, 0x3FFFD),
)
WIDE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WIDE_RANGES) + "]"


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text; nothing for a null."""
    kind = df.schema[name].dataType.simpleString()
    col = F.col(f"`{name}`")
    return F.coalesce(general(col.cast("double")) if kind in ("double", "float") else F.upper(col.cast("string")) if kind == "boolean" else col.cast("string"), F.lit(""))


def parsed_number(text: Column, percent: bool = True) -> Column:
    """A cell's number, or null: the whole trimmed text, with a percent sign if allowed."""
    t = F.trim(text)
    body = F.regexp_replace(t, r"\s*%$", "") if percent else t
    n = F.when(body.rlike(NUMBER_RE), body.try_cast("double"))
    return F.when(t.endswith("%"), n / 100).otherwise(n) if percent else n


def cell_number(df: DataFrame, name: str, percent: bool = True) -> Column:
    kind = df.schema[name].dataType
    return F.col(f"`{name}`").cast("double") if kind.typeName() in ("double", "float", "long", "integer", "short", "byte") or kind.typeName() == "decimal" else parsed_number(cell_text(df, name), percent)


_TEXT = {
    "contains": lambda c, v: c.contains(v), "not_contains": lambda c, v: ~c.contains(v), "equals": lambda c, v: c == v, "begins": lambda c, v: c.startswith(v), "ends": lambda c, v: c.endswith(v),
}
_NUMBER = {"eq": lambda n, v: n == v, "ne": lambda n, v: n != v, "gt": lambda n, v: n > v, "ge": lambda n, v: n >= v, "lt": lambda n, v: n < v, "le": lambda n, v: n <= v}


def predicate(df: DataFrame, spec: Mapping) -> Column:
    """A filter's column from its description.

    ``{"column", "kind": "blank", "blank": bool}``, ``{"kind": "values", "values": [...]}``,
    ``{"kind": "text", "op", "value"}``, ``{"kind": "number", "op", "value"[, "value2"]}``.
    """
    name, kind = spec["column"], spec["kind"]
    text = F.lower(cell_text(df, name))
    if kind == "blank":
        return (F.trim(text) == "") == F.lit(bool(spec.get("blank", True)))
    if kind == "values":
        return text.isin([str(v).lower() for v in spec["values"]])
    if kind == "text" and spec.get("op") in _TEXT:
        return _TEXT[spec["op"]](text, str(spec["value"]).lower())
    if kind == "number" and spec.get("op") in {*_NUMBER, "between"}:
        n = cell_number(df, name)
        if spec["op"] == "between":
            lo, hi = sorted((float(spec["value"]), float(spec["value2"])))
            return F.coalesce(n.between(lo, hi), F.lit(False))
        return F.coalesce(_NUMBER[spec["op"]](n, float(spec["value"])), F.lit(spec["op"] == "ne"))
    raise ValueError(f"unknown filter {kind!r} {spec.get('op')!r}")


@dataclass(frozen=True)
class Grid:
    """A sheet: cells, a row number, rows of a header that filters and sorts leave in place."""

    df: DataFrame
    header_rows: int = 0
    sort_key: tuple[str, str] | None = None
    filters: tuple = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    @property
    def in_header(self) -> Column:
        return F.col(ROW) < self.header_rows

    # View

    def filter(self, *specs: Mapping) -> Grid:
        return replace(self, filters=tuple(specs))

    def clear_filter(self) -> Grid:
        return replace(self, filters=())

    def sort(self, column: str, direction: str) -> Grid:
        """Any direction but asc and desc takes the sort back."""
        return replace(self, sort_key=(column, direction) if direction in ("asc", "desc") else None)

    def rows(self) -> DataFrame:
        """The visible rows; ``_row`` keeps the original number."""
        if not self.filters:
            return self.df
        keep = reduce(lambda a, b: a & b, [predicate(self.df, s) for s in self.filters])
        return self.df.where(self.in_header | keep)

    def order(self) -> list[Column]:
        """Header first; blanks last either way; numbers before text; the rest as it was."""
        if self.sort_key is None:
            return [F.col(ROW).asc()]
        name, direction = self.sort_key
        text, n = cell_text(self.df, name), cell_number(self.df, name, percent=False)
        way = (lambda c: c.asc()) if direction == "asc" else (lambda c: c.desc())
        out = [F.when(self.in_header, F.col(ROW)).otherwise(self.header_rows).asc()] if self.header_rows else []
        return [*out, (F.trim(text) == "").asc(), way(n.isNull()), way(n), way(F.lower(text)), F.col(ROW).asc()]

    def view(self) -> DataFrame:
        return self.rows().orderBy(*self.order())

    def placed(self) -> DataFrame:
        """The visible rows with ``_place``, from 0, in the order of :meth:`view`.

        Rows are numbered within ranges of what they are sorted by, and each range's count
        is carried into the next, so no task numbers them all.
        """
        rows = self.rows()
        if self.sort_key is None:
            return numbered(rows, ROW, "_place").withColumn("_place", (F.col("_place") - 1).cast("long"))
        name, direction = self.sort_key
        up = direction == "asc"
        text = cell_text(self.df, name)
        rows = rows.withColumns({"__n": cell_number(self.df, name, percent=False), "__t": F.lower(text), "__blank": F.trim(text) == ""})
        kind = F.when(self.in_header, 0).when(F.col("__blank"), 3).when(F.col("__n").isNull(), 2 if up else 1).otherwise(1 if up else 2)
        rows = rows.withColumn("__kind", kind)
        number, by_row = F.col("__kind") == (1 if up else 2), F.col("__kind").isin(0, 3)
        cuts = {"__n": ranges_of(rows.where(number), "__n"), "__t": ranges_of(rows.where(~number & ~by_row), "__t"), ROW: ranges_of(rows.where(by_row), ROW)}
        at = {c: range_of(F.col(c), v) if up or c == ROW else F.lit(len(v)) - range_of(F.col(c), v) for c, v in cuts.items()}
        rows = rows.withColumn("__range", F.when(by_row, at[ROW]).when(number, at["__n"]).otherwise(at["__t"]))
        way = (lambda c: c.asc()) if up else (lambda c: c.desc())
        order = [way(F.when(~by_row, F.col("__n"))), way(F.when(~by_row, F.col("__t"))), F.col(ROW).asc()]
        counts = rows.groupBy("__kind", "__range").agg(F.count("*").alias("__all"))
        before = W.orderBy("__kind", "__range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
        starts = counts.select("__kind", "__range", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__before"))
        own = F.row_number().over(W.partitionBy("__kind", "__range").orderBy(*order)) - 1
        return rows.withColumn("__own", own).join(F.broadcast(starts), ["__kind", "__range"]).withColumn("_place", F.col("__before") + F.col("__own")).select(*self.df.columns, "_place")

    def window(self, row0: int, row1: int, col0: int = 0, col1: int | None = None) -> DataFrame:
        """Visible rows row0 to row1 (exclusive) and columns col0 to col1: limit and offset over the view."""
        cols = self.columns[max(0, col0) : col1]
        if self.sort_key is None and not self.filters:
            return self.df.where((F.col(ROW) >= row0) & (F.col(ROW) < row1)).select(ROW, *cols)
        return self.view().offset(max(0, row0)).limit(max(0, row1 - row0)).select(ROW, *cols)

    # Cells

    def cell(self, row: int, column: str) -> DataFrame:
        return self.df.where(F.col(ROW) == row).select(cell_text(self.df, column).alias("cell"))

    def gather(self, rows: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows in the order given, repeats included; ``rows`` is a driver's list, so it may be broadcast."""
        at = self.df.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(rows)], "pos int, _at long")
        found = F.broadcast(at).join(self.df, F.col("_at") == F.col(ROW))
        return found.select("pos", ROW, *(columns or self.columns)).orderBy("pos")

    def find(self, needle: str, limit: int, match_case: bool = False, whole: bool = False) -> DataFrame:
        """Cells that hold the needle, row by row: ``_row, col, cell``; none for an empty needle."""
        cells = F.array(*[cell_text(self.df, c) for c in self.columns])
        fold = (lambda c: c) if match_case else F.lower
        want = needle if match_case else needle.lower()
        hit = F.col("cell")
        found = self.rows().select(ROW, F.posexplode(cells).alias("col", "cell")).where((fold(hit) == want if whole else fold(hit).contains(want)) & F.lit(needle != ""))
        return found.orderBy(ROW, "col").limit(limit)

    def distinct(self, column: str, limit: int) -> tuple[DataFrame, Column]:
        """First spellings of a column's values in order of appearance, and whether there are more than ``limit``."""
        text = cell_text(self.df, column)
        seen = self.df.where(~self.in_header & (F.trim(text) != "")).groupBy(F.lower(text).alias("key")).agg(F.min_by(text, ROW).alias("value"), F.min(ROW).alias("first"))
        top = seen.orderBy("first").limit(limit + 1)
        more = F.count("*").over(W.partitionBy()) > limit
        return top.withColumn("truncated", more).orderBy("first").limit(limit).select("value", "first", "truncated"), more

    # Measures

    def widths(self) -> DataFrame:
        """Display width of each column: wide characters take two places; 3 at least, 60 at most."""
        wide = lambda c: F.char_length(c) + F.char_length(F.regexp_replace(c, f"[^{WIDE[1:-1]}]", ""))
        most = [F.least(F.greatest(F.coalesce(F.max(wide(cell_text(self.df, c))), F.lit(0)), F.lit(MIN_WIDTH)), F.lit(MAX_WIDTH)).alias(c) for c in self.columns]
        return self.df.agg(*most)

    def extent(self) -> DataFrame:
        return self.df.agg((F.coalesce(F.max(ROW), F.lit(-1)) + 1).alias("rows"), F.lit(len(self.columns)).alias("cols"))

    def tsv(self, row0: int, row1: int, col0: int = 0, col1: int | None = None) -> DataFrame:
        """The rectangle as tab-separated lines, without quoting."""
        part = self.window(row0, row1, col0, col1)
        cols = [c for c in part.columns if c != ROW]
        return part.select(ROW, F.concat_ws("\t", *[cell_text(part, c) for c in cols]).alias("line"))


def cell_is(value: Column, op: str, a: float, b: float | None = None) -> Column:
    """A conditional format's comparison."""
    lo, hi = sorted((a, b)) if b is not None else (a, a)
    tests = {"greaterThan": value > a, "lessThan": value < a, "greaterThanOrEqual": value >= a, "lessThanOrEqual": value <= a, "equal": value == a, "notEqual": value != a, "between": value.between(lo, hi), "notBetween": ~value.between(lo, hi)}
    return F.coalesce(tests[op], F.lit(False))


def color_scale(df: DataFrame, value: str, colors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``color``: RRGGBB between two or three colours over the region's range; the middle if it is flat.

    The range is an aggregate joined back, so no region is gathered in one task.
    """
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.join(ends, list(by)) if by else df.join(F.broadcast(ends))  # one row
    t = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5)
    rgb = [[int(c[i : i + 2], 16) for i in (0, 2, 4)] for c in colors]

    def channel(i: int) -> Column:
        if len(rgb) == 2:
            mixed = rgb[0][i] + (rgb[1][i] - rgb[0][i]) * t
        else:
            mixed = F.when(t < 0.5, rgb[0][i] + (rgb[1][i] - rgb[0][i]) * t * 2).otherwise(rgb[1][i] + (rgb[2][i] - rgb[1][i]) * (t - 0.5) * 2)
        return F.lpad(F.hex(F.floor(mixed + 0.5).cast("long")), 2, "0")

    return joined.withColumn("color", F.when(F.col(value).isNotNull(), F.concat(*[channel(i) for i in range(3)]))).drop("__lo", "__hi")


def expand_area(spark, areas: Sequence[tuple[int, int, int, int]], most: int = 200_000) -> DataFrame:
    """Cells (row, col) of rectangles; those over ``most`` cells are left out, as conditional formats leave them."""
    keep = [a for a in areas if (a[2] - a[0] + 1) * (a[3] - a[1] + 1) <= most]
    df = spark.createDataFrame(keep, "r0 int, c0 int, r1 int, c1 int")
    return df.select("c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row")).select("row", F.explode(F.sequence("c0", "c1")).alias("col"))


def sparkline(df: DataFrame, order: Sequence[str], value: str, most: int = 4096) -> DataFrame:
    """The first values of a range in order, 0 for what is no number."""
    n = F.coalesce(cell_number(df, value), F.lit(0.0))
    top = df.select(*order, n.alias("__n")).orderBy(*order).limit(most)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__n"))), lambda x: x["__n"]).alias("values"))


def find_in_texts(df: DataFrame, key: str, text: str, needle: str, case: bool = False) -> DataFrame:
    """``key, n, hit, start``: each place of a text where the needle stands, left to right without overlap.

    ``n`` counts the row's hits, ``hit`` numbers them from 1, ``start`` counts characters
    from 0. An empty needle is nowhere.
    """
    own = F.col(text) if case else F.lower(text)
    parts = F.split(own, "\\Q" + (needle if case else needle.lower()).replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    rows = df.where(F.contains(own, F.lit(needle if case else needle.lower())) if needle else F.lit(False)).select(key, parts.alias("__parts"))
    # A part's start is what the parts and needles before it take.
    places = F.transform("__parts", lambda x: F.char_length(x) + len(needle))
    ends = F.aggregate(places, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))
    hits = rows.select(key, (F.size("__parts") - 1).cast("long").alias("n"), F.posexplode(F.slice(ends, F.lit(1), F.size("__parts") - 1)).alias("__i", "__end"))
    return hits.select(key, "n", (F.col("__i") + 1).cast("long").alias("hit"), (F.col("__end") - len(needle)).cast("long").alias("start"))


__all__ = ["Grid", "cell_is", "color_scale", "display", "expand_area", "find_in_texts", "sparkline"]
