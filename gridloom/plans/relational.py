"""Formulas that look beyond their own row: lookups, order statistics, random numbers, arrays.

Such a call inside a formula becomes a join or an aggregate of its own; its result is a
column that the rest of the formula, which compiles as usual, refers to. An aggregate
beside row values (``x/SUM(x)``) is of the whole column: the aggregates of all formulas
over one table are one aggregate, joined as one row; one inside another takes a round
more. A conditional aggregate whose criterion varies by row is a join. Other tables are
given by name: ``VLOOKUP(o_custkey, customers, 2, FALSE)`` or
``XLOOKUP(o_custkey, customers.c_custkey, customers.c_name, "none")``. A table comes with
the column that orders its rows, as a relation has no order of its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.cells import criterion
from gridloom.operators import criteria as C
from gridloom.operators import lookup as L
from gridloom.plans.compiler import AGGREGATES, Compiler, Typed, Unsupported, code, columns_of, first_error, number, numeric, outputs, predicate, text, toward_zero, whole_column
from gridloom.plans.language import Binary, Call, Const, Name, Unary, parse, walk

SEED = 20240229


@dataclass(frozen=True)
class Table:
    df: DataFrame
    ordinal: str

    @property
    def names(self) -> list[str]:
        """The columns as the formula counts them; a separate ordinal is none of them."""
        return [c for c in self.df.columns if not c.startswith("_")]


class Binder:
    """Takes calls out of formulas over ``df`` and joins their results to it."""

    def __init__(self, df: DataFrame, tables: Mapping[str, Table], ordinal: str | None, now: float):
        self.df, self.ordinal, self.now = df, ordinal, now
        self.base = df
        self.tables = {k.upper(): t for k, t in tables.items()}
        self.made: dict[str, Typed] = {}
        self.known: dict[object, Name] = {}

    def columns(self) -> dict[str, Typed]:
        return columns_of(self.df) | self.made

    def compile(self, node) -> Typed:
        tree = self.bind(node)  # before the columns, as it adds to them
        return Compiler(self.columns(), self.now).compile(tree)

    def bind(self, node):
        """The tree with each call of :data:`CALLS` replaced by the name of its result."""
        if isinstance(node, Unary):
            return Unary(node.op, self.bind(node.of))
        if isinstance(node, Binary):
            return Binary(node.op, self.bind(node.left), self.bind(node.right))
        if node in self.known:
            return self.known[node]
        if isinstance(node, Call):
            if node.name in CONDITIONAL and varying(node):
                out = conditional(self, node)
            elif node.name in AGGREGATES:
                inner = Call(node.name, tuple(map(self.bind, node.args)))
                self.share([inner])
                out = self.known[inner]
            elif node.name in CALLS:
                out = CALLS[node.name](self, *node.args)
            else:
                return Call(node.name, tuple(map(self.bind, node.args)))
            if not any(isinstance(n, Call) and n.name in ("RAND", "RANDBETWEEN") for n in walk(node)):
                self.known[node] = out
            return out
        return node

    # Aggregates beside row values

    def gather(self, trees: list) -> None:
        """Takes the aggregates of all trees, the innermost first, one pass over each table a round."""
        while True:
            trees = [substituted(t, self.known) for t in trees]
            found = {n for t in trees for n in walk(t) if isinstance(n, Call) and whole(n) and not any(isinstance(x, Call) and (x.name in CALLS or x.name in AGGREGATES) for a in n.args for x in walk(a))}
            if not found:
                return
            self.share(sorted(found, key=repr))

    def share(self, calls: list[Call]) -> None:
        by_table: dict[str | None, list[Call]] = {}
        for c in calls:
            by_table.setdefault(self.owner(c), []).append(c)
        for owner, own in by_table.items():
            df, columns = (self.df, self.columns()) if owner is None else (self.tables[owner].df, self.columns_named(owner))
            made, names = [], []
            for c in own:
                if c.name == "MEDIAN" and c.args and not any(isinstance(a, Const) for a in c.args):
                    given, err = whole_column(Compiler(columns, self.now), c.args)
                    name, out = self.keep("number")
                    self.df = self.df.join(F.broadcast(L.median(df.select(F.explode(F.array(*map(numeric, given))).alias("__v")), "__v", [], name)))  # one row
                    made.append((err if err is not None else F.max(F.lit(None).cast("string"))).alias(f"{name}_e"))
                    self.made[name.upper()] = Typed("number", F.col(name), first_error(F.col(f"{name}_e"), code(F.col(name).isNull(), "#NUM!")), solid=True)
                    names.append(out)
                    continue
                x = Compiler(columns, self.now).compile(c)
                name, out = self.keep(x.kind)
                bad = F.col(f"{name}_e")
                made += [x.col.alias(name), (x.err if x.err is not None else F.lit(None).cast("string")).alias(f"{name}_e")]
                self.made[name.upper()] = Typed(x.kind, F.col(name), bad, solid=True)
                names.append(out)
            self.df = self.df.join(F.broadcast(df.agg(*made)))  # one row
            self.known |= dict(zip(own, names, strict=True))

    def owner(self, node) -> str | None:
        """The table whose columns a tree names; None for the formula's own."""
        owners = {n.text.rpartition(".")[0] if n.text.rpartition(".")[0] in self.tables else None for n in walk(node) if isinstance(n, Name)}
        if len(owners) > 1:
            raise Unsupported("an aggregate over columns of several tables")
        return owners.pop() if owners else None

    def columns_named(self, owner: str) -> dict[str, Typed]:
        return {f"{owner}.{k}": x for k, x in columns_of(self.tables[owner].df).items()}

    def keep(self, kind: str, missing: str | Column = "#N/A") -> tuple[str, Name]:
        """A fresh column for a result whose null is the error ``missing``."""
        own = f"__f{len(self.made)}"
        col = F.col(own)
        self.made[own.upper()] = Typed(kind, col, code(col.isNull(), missing) if isinstance(missing, str) else missing)
        return own, Name(own.upper())

    def key(self, node) -> tuple[str, Typed]:
        x = self.compile(node)
        own = f"__k{len(self.made)}_{len(self.df.columns)}"
        self.df = self.df.withColumn(own, F.when(x.err.isNull(), x.col) if x.err is not None else x.col)
        return own, x

    def table(self, node) -> Table:
        if not isinstance(node, Name) or node.text not in self.tables:
            raise Unsupported("a lookup needs the name of a table")
        return self.tables[node.text]

    def column(self, node) -> tuple[Table, str]:
        """``table.column``, or a column of the formula's own table."""
        if not isinstance(node, Name):
            raise Unsupported("a lookup needs the name of a column")
        owner, dot, name = node.text.rpartition(".")
        own = self.tables.get(owner) if dot else Table(self.df, self.ordinal or "")
        found = next((c for c in own.df.columns if c.upper() == name), None) if own else None
        if found is None:
            raise Unsupported(f"no column {node.text}")
        return own, found

    def scalar(self, made: DataFrame, kind: str, missing: str) -> Name:
        """A result of one row, or none, for every row."""
        own, name = self.keep(kind, missing)
        one = made.select(F.col(made.columns[0]).alias(own)).groupBy().agg(F.max(own).alias(own))  # exactly one row
        self.df = self.df.join(F.broadcast(one))
        return name


def _kind(table: Table, column: str) -> str:
    return columns_of(table.df.select(F.col(f"`{column}`").alias("x")))["X"].kind


def _values(table: Table, *columns: str) -> DataFrame:
    """Columns as formulas see them (``v0, v1, ...``) and the ordinal as ``__o``."""
    seen = columns_of(table.df)
    return table.df.select(*[seen[c.upper()].col.alias(f"v{i}") for i, c in enumerate(columns)], F.col(f"`{table.ordinal}`").alias("__o"))


def _flag(node, default: bool) -> bool:
    if node is None:
        return default
    if not isinstance(node, Const):
        raise Unsupported("the kind of match must be constant")
    return bool(node.value)


def _whole(node) -> int:
    if not isinstance(node, Const) or not isinstance(node.value, float):
        raise Unsupported("a position must be a constant number")
    return int(node.value)


def _found(b: Binder, name: str, kind: str, missing: str, bad: Column | None = None) -> None:
    """Takes the value out of the struct that a lookup gives; no struct is the error ``missing``."""
    hit = f"{name}_hit"
    b.df = b.df.withColumn(hit, F.col(name)).withColumn(name, F.col(f"{hit}.v"))
    b.made[name.upper()] = Typed(kind, F.col(name), first_error(bad, code(F.col(hit).isNull(), missing)))


_ZERO = {"number": 0.0, "text": "", "bool": False}


def _compared(b: Binder, key, kind: str) -> tuple[str, Typed]:
    """A key beside cells of a kind: a blank is that kind's nothing, and a key of another kind meets none."""
    own, x = b.key(key)
    zero = F.lit(_ZERO[kind])
    b.df = b.df.withColumn(own, F.coalesce(F.col(own), zero) if x.kind == kind else F.when(F.col(own).isNull(), zero))
    if x.err is not None:
        b.df = b.df.withColumn(own, F.when(x.err.isNull(), F.col(own)))
    return own, x


def _cells(table: Table, *columns: str) -> DataFrame:
    """Keys (``v0``) and what comes with them; a blank key is its kind's nothing."""
    return _values(table, *columns).withColumn("v0", F.coalesce("v0", F.lit(_ZERO[_kind(table, columns[0])])))


def _exact(b: Binder, key, table: Table, keys: str, result: str) -> Name:
    own, x = _compared(b, key, _kind(table, keys))
    name, out = b.keep(_kind(table, result))
    b.df = L.vlookup(b.df, own, _cells(table, keys, result).withColumn("v1", F.struct(F.col("v1").alias("v"))), "v0", "v1", "__o", name)
    _found(b, name, _kind(table, result), "#N/A", x.err)
    return out


def _sorted(b: Binder, key, table: Table, keys: str, result: str) -> Name:
    own, x = _compared(b, key, _kind(table, keys))
    name, out = b.keep(_kind(table, result))
    b.df = L.lookup_sorted(b.df, own, _cells(table, keys, result).withColumn("v1", F.struct(F.col("v1").alias("v"))), "v0", "v1", name, ordinal="__o")
    _found(b, name, _kind(table, result), "#N/A", x.err)
    return out


def vlookup(b: Binder, key, table, column, approximate=None):
    t = b.table(table)
    at = _whole(column)
    if at < 1:
        return error_value("#VALUE!")
    if at > len(t.names):
        return error_value("#REF!")
    return (_sorted if _flag(approximate, True) else _exact)(b, key, t, t.names[0], t.names[at - 1])


def error_value(error: str) -> Const:
    return parse(error)


def lookup(b: Binder, key, keys, results=None):
    t, k = b.column(keys)
    return _sorted(b, key, t, k, b.column(results or keys)[1])


def xlookup(b: Binder, key, keys, results, default=None):
    """Exact on the shown text; a default fills what is missing, in the results' kind or as text."""
    t, k = b.column(keys)
    _, r = b.column(results)
    own, x = b.key(key)
    b.df = b.df.withColumn(own, text(Typed(x.kind, F.col(own))).col)
    name, out = b.keep(_kind(t, r))
    shown = _values(t, k, r).withColumn("v0", text(Typed(_kind(t, k), F.col("v0"))).col)
    first = shown.groupBy(F.col("v0").alias("__key")).agg(F.min_by("v1", "__o").alias(name), F.lit(True).alias(f"{name}_hit"))
    b.df = b.df.join(first, F.col(own) == F.col("__key"), "left").drop("__key")
    missed = F.col(f"{name}_hit").isNull()
    if default is None:
        b.made[name.upper()] = Typed(_kind(t, r), F.col(name), code(missed, "#N/A"))
        return out
    other = b.compile(default)
    mine = Typed(_kind(t, r), F.col(name))
    mine, other = (mine, other) if mine.kind == other.kind else (text(mine), text(other))
    b.made[name.upper()] = Typed(mine.kind, F.when(missed, other.col).otherwise(mine.col), F.when(missed, other.err) if other.err is not None else None)
    return out


def hlookup(b: Binder, key, table, row, approximate=None):
    """Over a table's columns: its first row holds the keys, row ``row`` the results."""
    t, at = b.table(table), _whole(row)
    if at < 1:
        return error_value("#VALUE!")
    seen = columns_of(t.df)
    cells = [seen[c.upper()] for c in t.names]
    kind = "number" if all(c.kind == "number" for c in cells) else "text"
    shown = F.array(*[F.struct((c if kind == c.kind else text(c)).col.alias("v")) for c in cells])
    ranked = t.df.orderBy(t.ordinal).limit(at).withColumn("r", F.row_number().over(W.orderBy(t.ordinal)))  # `row` rows
    top = ranked.select("r", F.posexplode(shown).alias("pos", "cell"))
    result = F.max(F.when(F.col("r") == at, F.col("cell")))
    pairs = top.groupBy("pos").agg(F.max(F.when(F.col("r") == 1, F.col("cell.v"))).alias("k"), result.alias("v"))
    own, x = b.key(key)
    name, out = b.keep(kind)
    pairs = pairs.withColumn("v", F.struct("v"))
    b.df = L.lookup_sorted(b.df, own, pairs, "k", "v", name, ordinal="pos") if _flag(approximate, True) else L.vlookup(b.df, own, pairs, "k", "v", "pos", name)
    hit = f"{name}_hit"
    b.df = b.df.withColumn(hit, F.col(name)).withColumn(name, F.col(f"{hit}.v.v"))
    b.made[name.upper()] = Typed(kind, F.col(name), first_error(x.err, code(F.col(hit).isNull(), "#N/A"), code(F.col(f"{hit}.v").isNull(), "#REF!")))
    return out


def match(b: Binder, key, keys, kind=None):
    """The place of a key in a column, from 1; downwards it is the mirror of upwards, over negated numbers."""
    t, k = b.column(keys)
    how = 1 if kind is None else _whole(kind.of) * (-1) if isinstance(kind, Unary) else _whole(kind)
    if how not in (-1, 0, 1):
        return error_value("#NUM!")
    placed = L.numbered(_cells(t, k), "__o", "v1")
    own, x = _compared(b, key, _kind(t, k))
    name, out = b.keep("number")
    if how < 0:
        if x.kind != "number" or _kind(t, k) != "number":
            raise Unsupported("MATCH downwards takes numbers")
        placed = placed.withColumn("v0", -F.col("v0"))
        b.df = b.df.withColumn(own, -F.col(own))
    b.df = L.vlookup(b.df, own, placed, "v0", "v1", "__o", name) if how == 0 else L.lookup_sorted(b.df, own, placed, "v0", "v1", name, ordinal="__o")
    b.made[name.upper()] = Typed("number", F.col(name), first_error(x.err, code(F.col(name).isNull(), "#N/A")))
    return out


def index(b: Binder, column, row, at=None):
    """The cell at a place of a column, or of a table's column ``at``; a place that varies is joined with the rows' numbers."""
    if isinstance(column, Name) and column.text in b.tables:
        t, n = b.tables[column.text], 1 if at is None else _whole(at)
        if not 1 <= n <= len(t.names):
            return error_value("#VALUE!" if n < 1 else "#REF!")
        c = t.names[n - 1]
    else:
        t, c = b.column(column)
        if at is not None and _whole(at) != 1:
            return error_value("#VALUE!" if _whole(at) < 1 else "#REF!")
    placed = L.numbered(_values(t, c), "__o", "__p")
    if constant(row):
        return b.scalar(placed.where(F.col("__p") == _whole(row)).select("v0"), _kind(t, c), "#REF!") if _whole(row) >= 1 else error_value("#VALUE!")
    own, x = b.key(row)
    n = number(Typed(x.kind, F.col(own)))
    b.df = b.df.withColumn(own, F.when(n.err.isNull(), toward_zero(n.col)) if n.err is not None else toward_zero(n.col))
    name, out = b.keep(_kind(t, c))
    b.df = b.df.join(placed.select(F.col("__p").alias(own), F.struct(F.col("v0").alias("v")).alias(name)), own, "left")
    _found(b, name, _kind(t, c), "#REF!", first_error(x.err, code(F.col(own).isNull(), "#VALUE!"), code(F.col(own) < 1, "#VALUE!")))
    return out


def order_statistic(smallest: bool):
    def call(b: Binder, column, k):
        """A ``k`` that varies is looked up among the ranks of the column's distinct values."""
        t, c = b.column(column)
        if constant(k):
            return b.scalar(L.large(columns_frame(t, c), "v0", _whole(k), smallest), "number", "#NUM!")
        ranks = L.ranks_of(columns_frame(t, c), "v0", smallest, [], "__rank")
        total = b.scalar(columns_frame(t, c).agg(F.count("v0").cast("double").alias("n")), "number", "#NUM!")
        own, x = b.key(k)
        name, out = b.keep("number")
        n = number(Typed(x.kind, F.col(own)))
        b.df = b.df.withColumn(own, toward_zero(n.col))
        b.df = L.lookup_sorted(b.df, own, ranks, "__rank", "v0", name)
        beyond = (F.col(own) < 1) | (F.col(own) > b.made[total.text].col)
        b.made[name.upper()] = Typed("number", F.col(name), first_error(x.err, n.err, code(beyond | F.col(name).isNull(), "#NUM!")))
        return out

    return call


def columns_frame(t: Table, column: str) -> DataFrame:
    return t.df.select(columns_of(t.df)[column.upper()].col.alias("v0"))


def mode(b: Binder, column):
    t, c = b.column(column)
    return b.scalar(L.mode(_values(t, c), "v0", "__o"), "number", "#N/A")


def npv(b: Binder, rate, column):
    t, c = b.column(column)
    if not isinstance(rate, Const) or not isinstance(rate.value, float):
        raise Unsupported("the rate must be constant")
    return b.scalar(L.npv(L.numbered(_values(t, c).where("v0 IS NOT NULL"), "__o", "__p"), rate.value, "v0", "__p", place="__p").select("npv"), "number", "#VALUE!")


def rank(b: Binder, value, column, ascending=None):
    """Of any value among a column's; one that the column does not have has none."""
    t, c = b.column(column)
    counts = L.ranks_of(columns_frame(t, c), "v0", _flag(ascending, False), [], "__rank")
    own, _ = b.key(value)
    name, out = b.keep("number")
    b.df = b.df.join(counts.select(F.col("v0").alias("__key"), F.col("__rank").alias(name)), F.col(own) == F.col("__key"), "left").drop("__key")
    return out


def rand(b: Binder):
    name, out = b.keep("number", F.lit(None).cast("string"))
    b.df = b.df.withColumn(name, F.rand(SEED + len(b.made)))
    return out


def rand_between(b: Binder, low, high):
    lo, hi = number(b.compile(low)), number(b.compile(high))
    name, out = b.keep("number")
    bad = F.ceil(lo.col) > F.floor(hi.col)
    b.df = b.df.withColumn(name, F.ceil(lo.col) + F.floor(F.rand(SEED + len(b.made)) * (F.floor(hi.col) - F.ceil(lo.col) + 1)).cast("double"))
    b.made[name.upper()] = Typed("number", F.col(name), first_error(lo.err, hi.err, code(bad, "#NUM!")))
    return out


def rows(b: Binder, table):
    return b.scalar(b.table(table).df.agg(F.count("*").cast("double")), "number", "#REF!")


def columns(b: Binder, table):
    return Const(float(len(b.table(table).names)))


def column_place(b: Binder, column):
    t, c = b.column(column)
    return Const(float(t.names.index(c) + 1))


def row_place(b: Binder, *_):
    """The row's number in the order of the table, from 1."""
    if b.ordinal is None:
        raise Unsupported("ROW needs an ordinal")
    name, out = b.keep("number")
    b.df = L.numbered(b.df, b.ordinal, name)
    return out


# Conditional aggregates

#: Measures of the rows that meet the criteria, as the result and what makes it an error.
CONDITIONAL = {
    "SUMIF": lambda c: Typed("number", F.coalesce(c("sum"), F.lit(0.0)), solid=True), "COUNTIF": lambda c: Typed("number", F.coalesce(c("rows").cast("double"), F.lit(0.0)), solid=True),
    "AVERAGEIF": lambda c: Typed("number", F.try_divide(c("sum"), c("n")), code(F.coalesce(c("n"), F.lit(0)) == 0, "#DIV/0!")),
    "MAXIFS": lambda c: Typed("number", F.coalesce(c("max"), F.lit(0.0)), solid=True), "MINIFS": lambda c: Typed("number", F.coalesce(c("min"), F.lit(0.0)), solid=True),
}
CONDITIONAL |= {f"{n}S": CONDITIONAL[n] for n in ("SUMIF", "COUNTIF", "AVERAGEIF")}


def constant(node) -> bool:
    return isinstance(node, Const) or isinstance(node, Unary) and node.op == "-" and isinstance(node.of, Const)


def pairs_of(node: Call) -> tuple[object | None, list[tuple]]:
    """The values and the (range, criterion) pairs of a conditional aggregate."""
    args = node.args
    if node.name in ("SUMIF", "AVERAGEIF"):
        if len(args) not in (2, 3):
            raise Unsupported(f"{node.name} takes a range, a criterion and values")
        return args[2] if len(args) == 3 else args[0], [args[:2]]
    values, rest = (None, args) if node.name.startswith("COUNT") else (args[0], args[1:])
    if not rest or len(rest) % 2:
        raise Unsupported("criteria come in pairs")
    return values, [rest[i : i + 2] for i in range(0, len(rest), 2)]


def varying(node: Call) -> bool:
    return not all(constant(c) for _, c in pairs_of(node)[1])


def whole(node: Call) -> bool:
    """Whether a call is an aggregate of whole columns alone."""
    return node.name in AGGREGATES and not (node.name in CONDITIONAL and varying(node))


def substituted(node, known: Mapping):
    if node in known:
        return known[node]
    if isinstance(node, Unary):
        return Unary(node.op, substituted(node.of, known))
    if isinstance(node, Binary):
        return Binary(node.op, substituted(node.left, known), substituted(node.right, known))
    return Call(node.name, tuple(substituted(a, known) for a in node.args)) if isinstance(node, Call) else node


def asked_for(b: Binder, crit) -> tuple[Column, str]:
    """A criterion's column, null where it meets nothing, and its kind as :func:`criteria.conditional` takes it."""
    if isinstance(crit, Binary) and crit.op == "&" and isinstance(crit.left, Const) and crit.left.value in C.OPERATORS:
        k = b.compile(crit.right)
        if k.kind == "number":  # 15 digits, as the text between would have
            shown = F.coalesce(F.format_string("%.14e", k.col).try_cast("double"), F.lit(float("nan")))
            return F.when(k.err.isNull(), shown) if k.err is not None else shown, crit.left.value
    k = b.compile(crit)
    col = F.when(k.err.isNull(), k.col) if k.err is not None else k.col
    return col, {"number": "=", "bool": "bool"}.get(k.kind, "text")


def conditional(b: Binder, node: Call) -> Name:
    """Criteria that vary are joined; constant ones beside them filter the table first."""
    values, pairs = pairs_of(node)
    owners = {b.owner(r) for r, _ in pairs} | ({b.owner(values)} if values is not None else set())
    if len(owners) > 1:
        raise Unsupported("ranges of several tables")
    owner = owners.pop()
    df, columns = (b.base, columns_of(b.base)) if owner is None else (b.tables[owner].df, b.columns_named(owner))
    inner = Compiler(columns, b.now)
    asked, kinds, ranges = [], [], []
    for cells, crit in pairs:
        x = inner.compile(cells)
        if constant(crit):
            df = df.where(predicate(x, criterion(-crit.of.value if isinstance(crit, Unary) else crit.value)))
            continue
        n = number(x)
        ranges.append(C.Range(F.when(n.err.isNull(), n.col) if n.err is not None else n.col, F.lower(text(x).col), x.col if x.kind == "bool" else None))
        made, kind = asked_for(b, crit)
        asked.append(made)
        kinds.append(kind)
    own = numeric(inner.compile(values)) if values is not None else F.lit(None).cast("double")
    name, out = b.keep("number")
    b.df = C.conditional(b.df, asked, kinds, df, ranges, own, f"{name}_")
    b.made[name.upper()] = CONDITIONAL[node.name](lambda m: F.col(f"{name}_{m}"))
    return out


#: Calls that become joins. GCD and the like of single cells stay with the compiler.
CALLS = {
    "VLOOKUP": vlookup, "LOOKUP": lookup, "XLOOKUP": xlookup, "HLOOKUP": hlookup, "MATCH": match, "INDEX": index, "LARGE": order_statistic(False), "SMALL": order_statistic(True), "MODE": mode, "NPV": npv, "RANK": rank, "RAND": rand, "RANDBETWEEN": rand_between, "ROWS": rows, "COLUMNS": columns, "COLUMN": column_place, "ROW": row_place,
}


def with_table_formulas(df: DataFrame, formulas: dict[str, str], tables: Mapping[str, Table] | None = None, ordinal: str | None = None, errors: bool = False, now: float = 0.0) -> DataFrame:
    """``df`` with a column for each formula, null where it is an error; with ``errors`` also ``<name>_error``.

    ``ordinal`` orders ``df``, for calls that need its order.
    """
    b = Binder(df, tables or {}, ordinal, now)
    trees = {k: parse(f.removeprefix("=")) for k, f in formulas.items()}
    b.gather(list(trees.values()))
    made = {k: b.compile(t) for k, t in trees.items()}
    return b.df.select(*[F.col(f"`{c}`") for c in df.columns], *outputs(made, errors))


def spilled(df: DataFrame, formula: str, ordinal: str, tables: Mapping[str, Table] | None = None, now: float = 0.0) -> DataFrame:
    """The rows of an array formula: ``place, value``; ``UNIQUE``, ``SORT``, ``FILTER`` and ``SEQUENCE`` in each other."""
    made = array_rows(Binder(df, tables or {}, ordinal, now), parse(formula.removeprefix("=")))
    return L.numbered(made, "__o", "place").select("place", "value")


def constant_value(node, b: Binder | None = None):
    if b is not None and isinstance(node, Call) and node.name == "ROWS":
        return float(b.table(node.args[0]).df.count())
    return -node.of.value if isinstance(node, Unary) else node.value


def array_rows(b: Binder, node) -> DataFrame:
    """``value, __o``: an array's values and what orders them."""
    if isinstance(node, Call) and node.name in ARRAYS:
        return ARRAYS[node.name](b, *node.args)
    x = b.compile(node)
    value = F.when(x.err.isNull(), x.col) if x.err is not None else x.col
    return b.df.select(value.alias("value"), F.col(f"`{b.ordinal}`").alias("__o"))


def sequence(b: Binder, *args) -> DataFrame:
    n, cols, start, step = (*[constant_value(a, b) for a in args], *(1.0, 1.0, 1.0)[len(args) - 1 :])
    return L.sequence(b.df.sparkSession, int(n), int(cols), start, step).select("value", (F.col("row") * int(cols) + F.col("col")).alias("__o"))


def filtered(b: Binder, values, test) -> DataFrame:
    return array_rows(b_where(b, b.compile(Call("AND", (test,)))), values)


def unique(b: Binder, values) -> DataFrame:
    return L.unique(array_rows(b, values), "value", "__o").select("value", F.col("first").alias("__o"))


def sort(b: Binder, values, _=None, direction=None) -> DataFrame:
    return L.sorted_places(array_rows(b, values), "value", "__o", isinstance(direction, Unary)).select("value", F.col("__place").alias("__o"))


#: Functions that make an array's rows.
ARRAYS = {"SEQUENCE": sequence, "FILTER": filtered, "UNIQUE": unique, "SORT": sort}


def b_where(b: Binder, keep: Typed) -> Binder:
    own = Binder(b.df.where(keep.col & keep.err.isNull() if keep.err is not None else keep.col), b.tables, b.ordinal, b.now)
    own.made = b.made
    return own
