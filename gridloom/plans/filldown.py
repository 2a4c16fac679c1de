"""Formulas filled down a sheet: one frame or offset plan for a class of formulas.

A sheet is a DataFrame with the row's number ``_row`` (from 0) and its columns, A, B, C,
... in order. A formula written in one row and filled down is the same formula in
relative form in every row. References to the same row are columns; to other rows,
offsets; areas whose ends both move, sliding frames; areas with one fixed end, running
aggregates; fixed cells and areas, one shared row. Other sheets' cells come by a join on
the row's number, for each sheet once.

Rows are dealt into stretches of consecutive numbers; a stretch carries as many rows of
its neighbours as the longest offset reaches, and running aggregates carry each
stretch's total into the next, so no task sweeps the sheet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.cells import REF
from gridloom.plans.compiler import Compiler, Typed, Unsupported, code, columns_of, first_error, numeric
from gridloom.plans.language import Area, Binary, Call, Cell, Const, Name, Unary, column_name, parse

ROW = "_row"


@dataclass(frozen=True)
class Ref:
    """A cell in relative form: ``row`` is a distance unless it is fixed; columns are absolute, as filling goes down."""

    sheet: str | None
    col: int
    row: int
    fixed: bool


@dataclass(frozen=True)
class Block:
    sheet: str | None
    col0: int
    col1: int
    ends: tuple[tuple[int, bool], tuple[int, bool]]


def relative(node, at: int):
    """The tree of a formula written in row ``at`` (from 0), in relative form."""
    own = lambda c: (c.row, True) if c.fixed[0] else (c.row - at, False)
    if isinstance(node, Cell):
        return Ref(node.sheet, node.col, *own(node))
    if isinstance(node, Area):
        a, b = node.ends
        return Block(node.sheet, node.col0, node.col1, tuple(sorted((own(a), own(b)))))
    if isinstance(node, Unary):
        return Unary(node.op, relative(node.of, at))
    if isinstance(node, Binary):
        return Binary(node.op, relative(node.left, at), relative(node.right, at))
    return Call(node.name, tuple(relative(a, at) for a in node.args)) if isinstance(node, Call) else node


def shown(node) -> str:
    """A relative tree as text, the same for all formulas of a class."""
    if isinstance(node, (Ref, Block)):
        sheet = f"{node.sheet}!" if node.sheet is not None else ""
        place = lambda row, fixed: f"R{row + 1}" if fixed else f"R[{row}]"
        if isinstance(node, Ref):
            return f"{sheet}{place(node.row, node.fixed)}{column_name(node.col)}"
        return f"{sheet}{place(*node.ends[0])}{column_name(node.col0)}:{place(*node.ends[1])}{column_name(node.col1)}"
    return repr(node) if not isinstance(node, Call) else f"{node.name}({','.join(map(shown, node.args))})"


_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_JOIN = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + b, "max": F.greatest, "min": F.least}
#: What an aggregate of areas is made of, and its result from these; an empty area has none.
MADE_OF = {
    "SUM": (("sum",), lambda s: Typed("number", F.coalesce(s, F.lit(0.0)), solid=True)), "COUNT": (("count",), lambda n: Typed("number", n.cast("double"), solid=True)),
    "AVERAGE": (("sum", "count"), lambda s, n: Typed("number", F.try_divide(s, n), code(n == 0, "#DIV/0!"))),
    "MAX": (("max",), lambda m: Typed("number", F.coalesce(m, F.lit(0.0)), solid=True)), "MIN": (("min",), lambda m: Typed("number", F.coalesce(m, F.lit(0.0)), solid=True)),
}


@dataclass(frozen=True)
class Ask:
    """A column to make: an aggregate of ``value`` over rows ``low`` to ``high`` from each row, None for all of that side."""

    name: str
    value: Column
    how: str
    low: int | None
    high: int | None


def extent(df: DataFrame) -> int:
    """How many rows a sheet has, by its last row's number."""
    last = df.agg(F.max(ROW)).first()[0]
    return 0 if last is None else last + 1


def framed(df: DataFrame, asks: Sequence[Ask], rows: int) -> DataFrame:
    """``df``, whose numbers are below ``rows``, with the asked columns.

    An ask without one end goes from that end of the sheet to the row itself.
    """
    reach = max([0, *(abs(x) for a in asks for x in (a.low, a.high) if x is not None)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(2 * reach, -(-rows // parts), 1)
    own = F.floor(F.col(ROW) / size).cast("long")
    sweeps = [a for a in asks if a.low is None or a.high is None]
    dealt = df.withColumn("__own", own)
    totals = dealt
    if reach:
        near = [F.col("__own"), F.when(F.pmod(ROW, F.lit(size)) < reach, F.col("__own") - 1), F.when(F.pmod(ROW, F.lit(size)) >= size - reach, F.col("__own") + 1)]
        dealt = dealt.withColumn("__range", F.explode(F.array_compact(F.array(*near))))
    else:
        dealt = dealt.withColumn("__range", F.col("__own"))
    here = F.col("__own") == F.col("__range")
    by_row, back = W.partitionBy("__range").orderBy(ROW), W.partitionBy("__range").orderBy(F.desc(ROW))
    made = {}
    for a in asks:
        f = _AGGREGATE[a.how]
        if a.low is None or a.high is None:
            # From the last row up where the end is open: a frame that starts at the row is summed anew for each row.
            made[a.name] = f(F.when(here, a.value)).over((by_row if a.low is None else back).rangeBetween(W.unboundedPreceding, 0))
        else:
            made[a.name] = f(a.value).over(by_row.rangeBetween(a.low, a.high))
    out = dealt.withColumns(made).where(here)
    if sweeps:
        sums = totals.groupBy(F.col("__own").alias("__range")).agg(*[_AGGREGATE[a.how](a.value).alias(a.name) for a in sweeps])
        before, after = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1), W.orderBy("__range").rowsBetween(1, W.unboundedFollowing)  # one row for each stretch
        total = lambda a: F.sum if a.how == "count" else _AGGREGATE[a.how]
        carried = sums.select("__range", *[total(a)(a.name).over(before if a.low is None else after).alias(f"{a.name}_in") for a in sweeps])
        out = out.join(F.broadcast(carried), "__range", "left")
        joined = {a.name: _JOIN[a.how](F.col(a.name), F.coalesce(f"{a.name}_in", F.lit(0)) if a.how == "count" else F.col(f"{a.name}_in")) for a in sweeps}
        out = out.withColumns(joined).drop(*[f"{a.name}_in" for a in sweeps])
    return out.drop("__range", "__own")


class Filler:
    """Fills formulas down a sheet, one after the other."""

    def __init__(self, df: DataFrame, sheets: Mapping[str, DataFrame], now: float):
        self.df, self.sheets, self.now = df, sheets, now
        self.typed = [self.seen(df, c) for c in self.names(df)]
        self.made: dict[str, Typed] = {}
        self.known: dict[object, Name | Const] = {}
        self.base, self.asks = df, 0
        self.rows: dict[str | None, int] = {}

    @staticmethod
    def names(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c != ROW]

    @staticmethod
    def seen(df: DataFrame, name: str) -> Typed:
        x = columns_of(df.select(F.col(f"`{name}`").alias("x")))["X"]
        return Typed(x.kind, columns_of(df)[name.upper()].col)

    def column(self, sheet: str | None, col: int) -> Typed | None:
        """A sheet's column, null where there is no such column."""
        if sheet is None:
            return self.typed[col] if col < len(self.typed) else None
        names = self.names(self.sheets[sheet])
        return self.seen(self.sheets[sheet], names[col]) if col < len(names) else None

    def fill(self, trees: Mapping[str, object]) -> None:
        """Formulas that do not read each other: one pass over each sheet for what they ask."""
        asked: dict[str | None, list] = {}
        for n in (n for t in trees.values() for n in walk_relative(t)):
            if isinstance(n, Call) and n.name in MADE_OF and any(isinstance(a, Block) for a in n.args):
                for a in n.args:
                    self.ask_block(n.name, a, asked)
            elif isinstance(n, Ref):
                self.ask_cell(n, asked)
        self.answer(asked)
        out = {}
        for name, tree in trees.items():
            replaced = self.replaced(tree)
            x = Compiler(self.made, self.now).compile(replaced)
            out |= {name: F.when(x.err.isNull(), x.col) if x.err is not None else x.col, f"{name}_error": x.err if x.err is not None else F.lit(None).cast("string")}
            self.typed.append(Typed(x.kind, F.col(f"`{name}`"), F.col(f"`{name}_error`")))
        self.df = self.df.withColumns(out)

    def extent(self, sheet: str | None) -> int:
        """Rows of a sheet, of another together with this one's; counted once."""
        if sheet not in self.rows:
            self.rows[sheet] = extent(self.base if sheet is None else self.sheets[sheet])
        return self.rows[sheet] if sheet is None else max(self.rows[sheet], self.extent(None))

    # References

    def missing(self, node) -> bool:
        if node.sheet is not None and node.sheet not in self.sheets:
            self.known[node] = Const(REF)
        return node in self.known

    def keep(self, node, x: Typed) -> None:
        own = f"__R{len(self.made)}"
        self.made[own] = x
        self.known[node] = Name(own)

    def ask(self, asked: dict, sheet: str | None, x: Typed, how: str, low, high, fixed: tuple[int, int] | None = None, anchor: int | None = None) -> str:
        """A column for an aggregate of ``x``: in a frame, between fixed rows, or with the far side cut at ``anchor``."""
        self.asks += 1
        name, value = f"__a{self.asks}", x.col
        if anchor is not None:
            value = F.when(F.col(ROW) >= anchor if low is None else F.col(ROW) <= anchor, value)
        asked.setdefault(sheet, []).append((Ask(name, value, how, low, high), fixed))
        return name

    def ask_cell(self, node: Ref, asked: dict) -> None:
        if self.missing(node):
            return
        x = self.column(node.sheet, node.col)
        if x is None:
            self.keep(node, Typed("number", F.lit(None).cast("double")))
            return
        if node.sheet is None and not node.fixed and node.row == 0:
            self.keep(node, x)
            return
        parts = [x] + ([Typed("text", x.err)] if x.err is not None else [])
        if node.fixed:
            made = [self.ask(asked, node.sheet, p, "max", 0, 0, (node.row, node.row)) for p in parts]
        else:
            made = [self.ask(asked, node.sheet, p, "max", node.row, node.row) for p in parts]
        above = code(F.col(ROW) + node.row < 0, "#REF!") if not node.fixed and node.row < 0 else None
        self.keep(node, Typed(x.kind, F.col(made[0]), first_error(above, *[F.col(m) for m in made[1:]])))

    def ask_block(self, function: str, node, asked: dict) -> None:
        """The measures of one argument of an aggregate, under the key (function, argument)."""
        key = (function, node)
        if key in self.known:
            return
        if isinstance(node, Ref):
            node = Block(node.sheet, node.col, node.col, ((node.row, node.fixed),) * 2)
        if not isinstance(node, Block):
            raise Unsupported(f"{function} of areas and other values at once")
        if node.sheet is not None and node.sheet not in self.sheets:
            self.known[key] = (None, [], [F.lit("#REF!")])
            return
        columns = [x for c in range(node.col0, node.col1 + 1) if (x := self.column(node.sheet, c)) is not None]
        (a, a_fixed), (b, b_fixed) = node.ends
        measures, errs = [], []
        for how in (*MADE_OF[function][0], "err"):
            found = []
            for x in columns:
                if how == "err" and x.err is None:
                    continue
                own = Typed("text", x.err) if how == "err" else Typed("number", numeric(x))
                kind = "min" if how == "err" else how
                if a_fixed and b_fixed:
                    found.append(F.col(self.ask(asked, node.sheet, own, kind, 0, 0, (min(a, b), max(a, b)))))
                elif not a_fixed and not b_fixed:
                    found.append(F.col(self.ask(asked, node.sheet, own, kind, min(a, b), max(a, b))))
                else:
                    anchor, move = (a, b) if a_fixed else (b, a)
                    if move:
                        raise Unsupported("an area from a fixed row to another than the formula's own")
                    down = F.col(self.ask(asked, node.sheet, own, kind, None, 0, anchor=anchor))
                    found.append(down if anchor == 0 else F.when(F.col(ROW) >= anchor, down).otherwise(F.col(self.ask(asked, node.sheet, own, kind, 0, None, anchor=anchor))))
            if how == "err":
                errs += found
            else:
                out = found[0] if found else F.lit(None).cast("double")
                for f in found[1:]:
                    out = _JOIN[how](out, f)
                measures.append(out)
        low = min([0, *(r for r, fixed in node.ends if not fixed)])
        if low < 0:
            errs.append(code(F.col(ROW) + low < 0, "#REF!"))
        self.known[key] = (node, measures, errs)

    def answer(self, asked: dict) -> None:
        for sheet, entries in asked.items():
            frames, fixed = [a for a, f in entries if f is None], [(a, f) for a, f in entries if f is not None]
            source = self.df if sheet is None else self.sheets[sheet]
            if fixed:
                between = lambda a, f: _AGGREGATE[a.how](F.when(F.col(ROW).between(*f), a.value)).alias(a.name)
                self.df = self.df.join(F.broadcast(source.agg(*[between(*e) for e in fixed])))  # one row
            if frames and sheet is None:
                self.df = framed(self.df, frames, self.extent(None))
            elif frames:
                # The other sheet's frames at this sheet's rows, of which it may have more or fewer.
                rows = self.df.select(F.col(ROW).cast("long").alias(ROW))
                made = framed(source.withColumn(ROW, F.col(ROW).cast("long")).join(rows, ROW, "full_outer"), frames, self.extent(sheet))
                self.df = self.df.join(made.select(ROW, *[a.name for a in frames]), ROW, "left")

    def replaced(self, node):
        if isinstance(node, Ref):
            return self.known[node]
        if isinstance(node, Call) and node.name in MADE_OF and any(isinstance(a, Block) for a in node.args):
            made = [self.known[node.name, a] for a in node.args]
            hows, result = MADE_OF[node.name]
            err = first_error(*[e for _, _, errs in made for e in errs])
            if any(block is None for block, _, _ in made):
                return Const(REF)
            joined = []
            for k, how in enumerate(hows):
                out = made[0][1][k]
                for _, measures, _ in made[1:]:
                    out = _JOIN[how](out, measures[k])
                joined.append(out)
            x = result(*joined)
            self.keep(node, Typed(x.kind, x.col, first_error(err, x.err), solid=x.solid))
            return self.known[node]
        if isinstance(node, Block):
            raise Unsupported("an area outside SUM, COUNT, AVERAGE, MAX and MIN")
        if isinstance(node, Unary):
            return Unary(node.op, self.replaced(node.of))
        if isinstance(node, Binary):
            return Binary(node.op, self.replaced(node.left), self.replaced(node.right))
        return Call(node.name, tuple(map(self.replaced, node.args))) if isinstance(node, Call) else node


def walk_relative(tree):
    """The nodes of a relative tree; below an aggregate of areas, none."""
    stack = [tree]
    while stack:
        n = stack.pop()
        yield n
        if isinstance(n, Call) and n.name in MADE_OF and any(isinstance(a, Block) for a in n.args):
            continue
        stack += n.args if isinstance(n, Call) else [n.of] if isinstance(n, Unary) else [n.left, n.right] if isinstance(n, Binary) else []


def columns_read(node) -> list[int]:
    """The last column of this sheet that a node, or an aggregate's argument, reads."""
    if isinstance(node, Call):
        return [c for a in node.args if isinstance(a, Block) for c in columns_read(a)]
    return [node.col] if isinstance(node, Ref) and node.sheet is None else [node.col1] if isinstance(node, Block) and node.sheet is None else []


def fill_down(df: DataFrame, formulas: Mapping[str, str], at: int = 0, sheets: Mapping[str, DataFrame] | None = None, errors: bool = False, now: float = 0.0) -> DataFrame:
    """A sheet with a column for each formula as written in row ``at`` (from 0) and filled over all rows.

    The new columns stand right of the sheet's own, in the order given; a formula may
    refer to those before it. A reference above the first row is ``#REF!``, a cell that a
    sheet does not have is blank, a sheet that is not there ``#REF!``.
    """
    filler, batch = Filler(df, sheets or {}, now), {}
    first = len(filler.typed)
    for k, (name, text) in enumerate(formulas.items()):
        tree = relative(parse(text.removeprefix("=")), at)
        reads = max([-1, *(c for n in walk_relative(tree) for c in columns_read(n))])
        if first + k <= reads < first + len(formulas):
            raise Unsupported("a formula refers to its own column or to one that is filled later")
        if reads >= len(filler.typed):
            filler.fill(batch)
            batch = {}
        batch[name] = tree
    filler.fill(batch)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return filler.df.select(*kept, *[F.col(f"`{n}`") for name in formulas for n in ((name, f"{name}_error") if errors else (name,))])


def classes(formulas: Mapping[tuple[int, int], str]) -> dict[str, list[tuple[int, int]]]:
    """The cells (row, column) of formulas, by their relative form."""
    found: dict[str, list[tuple[int, int]]] = {}
    for (row, col), text in formulas.items():
        found.setdefault(f"{column_name(col)}: {shown(relative(parse(text.removeprefix('=')), row))}", []).append((row, col))
    return found


__all__ = ["Filler", "classes", "fill_down", "framed", "relative"]
