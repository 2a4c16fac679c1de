"""The column tier: a formula over a DataFrame's columns becomes one Column.

A column name in a formula is the cell of the same row; inside an aggregate function it
is the whole column. Kinds are static, as columns have types; NULL plays the blank.
Errors are values: each result carries a second column with the error's code, and an
aggregate over a column with errors is an error. A value counts only where its error is
null; elsewhere it may be anything, so values need no guard and plans grow in proportion
to the formula. Sums, differences and products of infinite or undefined numbers stay so,
hence whole chains of them are checked once, where something else reads them. What no
built-in function can express runs in one Arrow UDF that calls the row-at-a-time library.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.cells import Criterion, Err, criterion, wildcard
from gridloom.functions.library import FUNCTIONS
from gridloom.operators.lookup import euclid
from gridloom.operators.lookup import median as selected_median
from gridloom.plans.formats import compiled
from gridloom.plans.language import Binary, Call, Const, FormulaError, Name, Unary, parse

NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Typed:
    """A value column (null: blank) of a static kind, and the column of its error's code, if it can have one.

    ``open``: the value may still be infinite or undefined without an error. ``solid``: it
    is never blank.
    """

    kind: str
    col: Column
    err: Column | None = None
    open: bool = False
    solid: bool = False


class Unsupported(ValueError):
    """A formula that has no column form."""


def first_error(*errs: Column | None) -> Column | None:
    errs = [e for e in errs if e is not None]
    return None if not errs else errs[0] if len(errs) == 1 else F.coalesce(*errs)


def code(when: Column, error: str) -> Column:
    return F.when(when, F.lit(error))


def number(x: Typed) -> Typed:
    if x.kind == "number":
        return x if x.solid else Typed("number", F.coalesce(x.col, F.lit(0.0)), x.err, x.open, True)
    if x.kind == "bool":
        return Typed("number", F.coalesce(x.col.cast("double"), F.lit(0.0)), x.err)
    if x.kind == "error":
        return Typed("number", F.lit(None).cast("double"), x.err)
    t = F.trim(x.col)
    percent = t.endswith("%")
    body = F.regexp_replace(t, r"\s*%$", "")
    n = F.when(body.rlike(NUMBER_RE), body.try_cast("double"))
    out = F.when(x.col.isNull(), 0.0).otherwise(F.when(percent, n / 100).otherwise(n))
    return Typed("number", out, first_error(x.err, code(x.col.isNotNull() & n.isNull(), "#VALUE!")))


def general(n: Column) -> Column:
    """At most 15 significant digits without an exponent, as text."""
    d = F.format_string("%.14e", n).try_cast("double")
    plain = lambda scale: F.regexp_replace(d.try_cast(f"decimal(38,{scale})").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    shown = F.when((d == F.floor(d)) & (F.abs(d) < 1e18), d.try_cast("long").cast("string")).when(F.abs(d) >= 1e18, F.coalesce(d.try_cast("decimal(38,0)").cast("string"), F.format_string("%.0f", d))).when(F.abs(d) >= 1e-3, plain(18)).otherwise(plain(37))
    return F.regexp_replace(shown, r"\.$", "")


def text(x: Typed) -> Typed:
    if x.kind == "text":
        return Typed("text", F.coalesce(x.col, F.lit("")), x.err)
    if x.kind == "bool":
        return Typed("text", F.when(x.col, "TRUE").when(~x.col, "FALSE").otherwise(""), x.err)
    if x.kind == "error":
        return Typed("text", F.lit(None).cast("string"), x.err)
    return Typed("text", F.coalesce(general(x.col), F.lit("")), x.err)


def truth(x: Typed) -> Typed:
    if x.kind == "bool":
        return Typed("bool", F.coalesce(x.col, F.lit(False)), x.err)
    if x.kind == "text":
        u = F.upper(F.trim(x.col))
        return Typed("bool", F.when(x.col.isNull(), False).otherwise(u == "TRUE"), first_error(x.err, code(x.col.isNotNull() & ~u.isin("TRUE", "FALSE"), "#VALUE!")))
    n = number(x)
    return Typed("bool", n.col != 0, n.err)


def finite(x: Typed) -> Typed:
    """A result that is open and never blank."""
    return Typed(x.kind, x.col, x.err, True, True)


def settled(x: Typed) -> Typed:
    """With the check that an open value waits for; NaN is greater than any number."""
    return Typed(x.kind, x.col, first_error(x.err, code(F.abs(x.col) >= F.lit(math.inf), "#NUM!")), solid=x.solid) if x.open else x


_RANK = {"number": 0, "error": 0, "text": 1, "bool": 2}


def order(a: Typed, b: Typed) -> Column:
    """-1, 0 or 1."""

    def same(kind: str, x: Column, y: Column) -> Column:
        if kind == "text":
            x, y = F.lower(x), F.lower(y)
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    zero = {"number": 0.0, "text": "", "bool": False}
    if a.kind == b.kind:
        return same(a.kind, F.coalesce(a.col, F.lit(zero.get(a.kind, 0.0))), F.coalesce(b.col, F.lit(zero.get(b.kind, 0.0))))
    if "error" in (a.kind, b.kind):
        return F.lit(0)
    rank = 1 if _RANK[a.kind] > _RANK[b.kind] else -1
    return F.when(a.col.isNull() & b.col.isNull(), 0).when(a.col.isNull(), same(b.kind, F.lit(zero[b.kind]), b.col)).when(b.col.isNull(), same(a.kind, a.col, F.lit(zero[a.kind]))).otherwise(rank)


_TEST = {"=": lambda o: o == 0, "<>": lambda o: o != 0, "<": lambda o: o < 0, ">": lambda o: o > 0, "<=": lambda o: o <= 0, ">=": lambda o: o >= 0}


def predicate(x: Typed, c: Criterion | None) -> Column:
    """Whether a cell meets a criterion; errors meet ``<>`` only, blanks count as 0 or nothing."""
    if c is None:
        return F.lit(False)
    bad = x.err.isNotNull() if x.err is not None else F.lit(False)
    if c.flag is not None:
        return ~bad & F.coalesce(x.col == c.flag, F.lit(False)) if x.kind == "bool" else F.lit(False)
    if c.number is not None:
        n = number(x)
        wrong = n.err.isNotNull() if n.err is not None else F.lit(False)
        diff = n.col - c.number
        return F.when(wrong, c.op == "<>").otherwise(_TEST[c.op](diff))
    own = F.lower(text(x).col)
    if c.op in ("=", "<>"):
        plain = not set(c.text) & {"*", "?"}
        hit = ~bad & F.coalesce(own == c.text.lower() if plain else own.rlike(wildcard(c.text.lower())), F.lit(False))
        return hit if c.op == "=" else ~hit
    return ~bad & {"<": own < c.text.lower(), ">": own > c.text.lower(), "<=": own <= c.text.lower(), ">=": own >= c.text.lower()}[c.op]


def half_up(v: Column) -> Column:
    """Halves away from zero; a half is exact in binary, so rounding the decimal form is the same."""
    return F.round(v, 0)


def toward_zero(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v)).cast("double")


def away(v: Column) -> Column:
    return F.signum(v) * F.ceil(F.abs(v)).cast("double")


class Compiler:
    """Compiles trees against named columns. ``now`` is the serial number of the present."""

    def __init__(self, columns: dict[str, Typed], now: float = 0.0):
        self.columns, self.now = columns, now
        self.numbers: dict[int, tuple[Typed, Typed]] = {}

    def compile(self, node) -> Typed:
        return settled(self.raw(node))

    def raw(self, node) -> Typed:
        """A tree's column, which may be open."""
        if isinstance(node, Const):
            v = node.value
            if isinstance(v, Err):
                return Typed("error", F.lit(None).cast("double"), F.lit(v.code))
            return Typed("bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "text", F.lit(v), solid=v is not None)
        if isinstance(node, Name):
            found = self.columns.get(node.text)
            return found if found is not None else Typed("error", F.lit(None).cast("double"), F.lit("#NAME?"))
        if isinstance(node, Unary):
            n = number(self.raw(node.of))
            return Typed("number", -n.col if node.op == "-" else n.col if node.op == "+" else n.col / 100, n.err, n.open, True)
        if isinstance(node, Binary):
            # Infinite numbers stay so on the way up only through these, and as what is divided.
            left, right = (self.raw if node.op in ops else self.compile for ops in ("+-*/", "+-*"))
            return self.binary(node.op, left(node.left), right(node.right))
        if isinstance(node, Call):
            if node.name in ROWWISE:
                return ROWWISE[node.name](self, *node.args)
            if node.name in AGGREGATES:
                return AGGREGATES[node.name](self, *node.args)
            if node.name in FUNCTIONS:
                return self.by_library(node)
            return Typed("error", F.lit(None).cast("double"), F.lit("#NAME?"))
        raise Unsupported("cell references need a workbook")

    def number(self, x: Typed) -> Typed:
        """A column that comes up again and again is read as a number once."""
        if id(x) not in self.numbers:
            self.numbers[id(x)] = (x, number(x))
        return self.numbers[id(x)][1]

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op == "&":
            x, y = text(a), text(b)
            return Typed("text", F.concat(x.col, y.col), first_error(x.err, y.err))
        if op in _TEST:
            return Typed("bool", _TEST[op](order(a, b)), first_error(a.err, b.err))
        x, y = self.number(a), self.number(b)
        err = first_error(a.err, b.err, *[n.err for n, of in ((x, a), (y, b)) if of.kind == "text"])
        if op == "/":
            return finite(Typed("number", F.try_divide(x.col, y.col), first_error(err, code(y.col == 0, "#DIV/0!"))))
        if op == "^":
            return finite(Typed("number", F.pow(x.col, y.col), first_error(err, code((x.col < 0) & (y.col != F.floor(y.col)), "#NUM!"))))
        return finite(Typed("number", x.col + y.col if op == "+" else x.col - y.col if op == "-" else x.col * y.col, err))

    def by_library(self, node: Call) -> Typed:
        """One Arrow UDF over the arguments' values; the only Python in a compiled formula."""
        if node.name in BEYOND:
            raise Unsupported(f"{node.name} looks beyond its row; gridloom.plans.relational joins what it needs")
        args = [self.compile(a) for a in node.args]
        name = node.name

        @F.pandas_udf("num double, txt string, flag boolean, err string")
        def run(cells: pd.DataFrame) -> pd.DataFrame:
            from gridloom.functions.cells import BY_CODE
            from gridloom.plans.workbook import Evaluator, Workbook

            ev, out = Evaluator(Workbook()), []
            for row in cells.itertuples(index=False):
                values = []
                for k in range(0, len(row), 2):
                    v, e = row[k], row[k + 1]
                    missing = v is None or v is pd.NA or isinstance(v, float) and math.isnan(v)
                    values.append(Const(BY_CODE[e] if isinstance(e, str) else None if missing else bool(v) if isinstance(v, (bool,)) or type(v).__name__ == "bool" else v if isinstance(v, str) else float(v)))
                v = FUNCTIONS[name](ev, tuple(values))
                out.append((v if isinstance(v, float) else None, v if isinstance(v, str) else None, v if isinstance(v, bool) else None, v.code if isinstance(v, Err) else None))
            return pd.DataFrame(out, columns=["num", "txt", "flag", "err"])

        cells = F.struct(*[c for i, a in enumerate(args) for c in (a.col.alias(f"v{i}"), (a.err if a.err is not None else F.lit(None).cast("string")).alias(f"e{i}"))])
        made = run(cells)
        kind = RESULT_KINDS.get(name, "number")
        return Typed(kind, made[{"number": "num", "text": "txt", "bool": "flag"}[kind]], made["err"])


#: Functions that a column by itself cannot stand for.
BEYOND = ("RAND", "RANDBETWEEN", "VLOOKUP", "HLOOKUP", "XLOOKUP", "LOOKUP", "MATCH", "INDEX", "LARGE", "SMALL", "RANK", "MODE", "NPV", "UNIQUE", "SORT", "FILTER", "SEQUENCE", "ROW", "ROWS", "COLUMN", "COLUMNS")
RESULT_KINDS = {"TEXT": "text"}
ROWWISE: dict[str, Callable] = {}
AGGREGATES: dict[str, Callable] = {}


def rowwise(names: str, kinds: str, result: str, *defaults):
    """Registers a function of coerced columns; it gives a Column, or a Typed with its own guard."""

    def register(f: Callable) -> Callable:
        def call(c: Compiler, *args):
            if not len(kinds) - len(defaults) <= len(args) <= len(kinds):
                return Typed("error", F.lit(None).cast("double"), F.lit("#VALUE!"))
            given = [{"n": number, "t": text, "b": truth}[k](c.compile(a)) for k, a in zip(kinds, args, strict=False)]
            given += [Typed("", F.lit(d)) for d in defaults[len(given) - len(kinds) + len(defaults) :]]
            out = f(*[g.col for g in given])
            err = first_error(*[g.err for g in given])
            out = Typed(result, out.col, first_error(err, out.err)) if isinstance(out, Typed) else Typed(result, out, err)
            return finite(out) if result == "number" else out

        ROWWISE.update(dict.fromkeys(names.split(), call))
        return f

    return register


def _fail(col: Column, bad: Column, error: str = "#NUM!") -> Typed:
    return Typed("", F.when(~bad, col), code(bad, error))


def scaled(step: Callable[[Column], Column]):
    return lambda n, d: step(n * F.pow(F.lit(10.0), toward_zero(d))) / F.pow(F.lit(10.0), toward_zero(d))


for _n, _f in {"ABS": F.abs, "SIGN": F.signum, "EXP": F.exp, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "DEGREES": F.degrees, "RADIANS": F.radians}.items():
    rowwise(_n, "n", "number")(_f)
rowwise("INT", "n", "number")(lambda n: F.floor(n).cast("double"))
rowwise("ROUND", "nn", "number")(scaled(half_up))
rowwise("ROUNDUP", "nn", "number")(scaled(away))
rowwise("ROUNDDOWN", "nn", "number")(scaled(toward_zero))
rowwise("TRUNC", "nn", "number", 0.0)(scaled(toward_zero))
rowwise("MOD", "nn", "number")(lambda a, b: _fail(a - b * F.floor(F.try_divide(a, b)).cast("double"), b == 0, "#DIV/0!"))
rowwise("QUOTIENT", "nn", "number")(lambda a, b: _fail(toward_zero(F.try_divide(a, b)), b == 0, "#DIV/0!"))


def stepped(step: Callable[[Column], Column]):
    return lambda n, s: _fail(F.when(s == 0, 0.0).otherwise(step(F.try_divide(n, s)) * s), n * s < 0)


rowwise("MROUND", "nn", "number")(stepped(half_up))
rowwise("CEILING", "nn", "number")(stepped(lambda v: F.ceil(v).cast("double")))
rowwise("FLOOR", "nn", "number")(stepped(lambda v: F.floor(v).cast("double")))
rowwise("EVEN", "n", "number")(lambda n: away(n / 2) * 2)
rowwise("ODD", "n", "number")(lambda n: F.when(n < 0, -1.0).otherwise(1.0) * (2 * F.ceil(F.greatest(F.abs(n) - 1, F.lit(0.0)) / 2).cast("double") + 1))
rowwise("POWER", "nn", "number")(lambda b, e: _fail(F.pow(b, e), (b < 0) & (e != F.floor(e))))
rowwise("SQRT", "n", "number")(lambda n: _fail(F.sqrt(F.abs(n)), n < 0))
rowwise("LN", "n", "number")(lambda n: _fail(F.log(n), n <= 0))
rowwise("LOG10", "n", "number")(lambda n: _fail(F.log10(n), n <= 0))
rowwise("LOG", "nn", "number", 10.0)(lambda n, b: _fail(F.when(b == 10, F.log10(n)).when(b == 2, F.log2(n)).otherwise(F.try_divide(F.log(n), F.log(b))), (n <= 0) | (b <= 0) | (b == 1)))
rowwise("ASIN", "n", "number")(lambda n: _fail(F.asin(n), F.abs(n) > 1))
rowwise("ACOS", "n", "number")(lambda n: _fail(F.acos(n), F.abs(n) > 1))
rowwise("ATAN2", "nn", "number")(lambda x, y: F.atan2(y, x))
rowwise("PI", "", "number")(F.pi)
rowwise("FACT", "n", "number")(lambda n: _fail(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(171), n.try_cast("int")))), F.lit(1.0), lambda a, x: a * x), (toward_zero(n) < 0) | (n >= 171)))


@rowwise("COMBIN", "nn", "number")
def combin(n: Column, k: Column) -> Typed:
    n, k = toward_zero(n), toward_zero(k)
    m = F.least(k, n - k)
    steps = F.when(m >= 1, F.sequence(F.lit(1), m.try_cast("int"))).otherwise(F.array().cast("array<int>"))
    return _fail(F.rint(F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - i + 1) / i)), (n < 0) | (k < 0) | (k > n))


rowwise("ISEVEN", "n", "bool")(lambda n: F.floor(F.abs(n)) % 2 == 0)
rowwise("ISODD", "n", "bool")(lambda n: F.floor(F.abs(n)) % 2 == 1)

# Text

rowwise("LOWER", "t", "text")(F.lower)
rowwise("UPPER", "t", "text")(F.upper)
rowwise("LEN", "t", "number")(lambda s: F.char_length(s).cast("double"))
rowwise("TRIM", "t", "text")(lambda s: F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", ""))
rowwise("EXACT", "tt", "bool")(lambda a, b: a == b)
rowwise("LEFT", "tn", "text", 1.0)(lambda s, n: _fail(F.left(s, n.try_cast("int")), toward_zero(n) < 0, "#VALUE!"))
rowwise("RIGHT", "tn", "text", 1.0)(lambda s, n: _fail(F.right(s, n.try_cast("int")), toward_zero(n) < 0, "#VALUE!"))
rowwise("MID", "tnn", "text")(lambda s, i, n: _fail(F.substring(s, i.try_cast("int"), n.try_cast("int")), (toward_zero(i) < 1) | (toward_zero(n) < 0), "#VALUE!"))
rowwise("REPT", "tn", "text")(lambda s, n: _fail(F.repeat(s, n.try_cast("int")), (toward_zero(n) < 0) | (F.octet_length(s) * toward_zero(n) > 32767), "#VALUE!"))
rowwise("REPLACE", "tnnt", "text")(lambda s, i, n, new: _fail(F.concat(F.left(s, (i - 1).try_cast("int")), new, F.substring(s, (i.try_cast("int") + n.try_cast("int")), F.char_length(s))), (toward_zero(i) < 1) | (toward_zero(n) < 0), "#VALUE!"))
rowwise("PROPER", "t", "text")(lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(\p{IsAlphabetic}+|\P{IsAlphabetic}+)"), 1), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.char_length(w))))), ""))
rowwise("CODE UNICODE", "t", "number")(lambda s: _fail(F.ascii(s).cast("double"), s == "", "#VALUE!"))
rowwise("VALUE", "t", "number")(lambda s: _fail(F.trim(s).try_cast("double"), ~F.trim(s).rlike(NUMBER_RE), "#VALUE!"))
rowwise("CHAR UNICHAR", "n", "text")(lambda n: _fail(F.decode(F.unhex(F.lpad(F.hex(n.try_cast("int")), 8, "0")), "UTF-32"), (toward_zero(n) < 1) | (n > 0x10FFFF) | n.try_cast("long").between(0xD800, 0xDFFF), "#VALUE!"))


def located(fold: Callable[[Column], Column]):
    def call(needle: Column, s: Column, start: Column) -> Typed:
        i = start.try_cast("int")
        at = F.when(fold(needle) == "", i).otherwise(F.call_function("locate", fold(needle), fold(s), i))
        return _fail(at.cast("double"), (i < 1) | (i > F.char_length(s) + 1) | (at < 1), "#VALUE!")

    return call


rowwise("FIND", "ttn", "number", 1.0)(located(lambda s: s))
rowwise("SEARCH", "ttn", "number", 1.0)(located(F.lower))


def substitute(c: Compiler, *args):
    if len(args) not in (3, 4):
        return Typed("error", F.lit(None).cast("double"), F.lit("#VALUE!"))
    s, old, new = (text(c.compile(a)) for a in args[:3])
    err = first_error(s.err, old.err, new.err)
    if len(args) == 3:
        return Typed("text", F.when(old.col == "", s.col).otherwise(F.replace(s.col, old.col, new.col)), err)
    n = number(c.compile(args[3]))
    k = F.greatest(F.lit(1), n.col.try_cast("int"))
    parts = F.split(s.col, F.concat(F.lit("\\Q"), F.replace(old.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    joined = lambda x: F.call_function("array_join", x, old.col)
    one = F.concat(joined(F.slice(parts, F.lit(1), k)), new.col, joined(F.slice(parts, k + 1, F.size(parts))))
    return Typed("text", F.when((old.col == "") | (k >= F.size(parts)), s.col).otherwise(one), first_error(err, n.err, code(toward_zero(n.col) < 1, "#VALUE!")))


def concat(c: Compiler, *args):
    parts = [text(c.compile(a)) for a in args]
    return Typed("text", F.concat(*[p.col for p in parts]), first_error(*[p.err for p in parts]))


def text_join(c: Compiler, sep, skip, *args):
    s, b, parts = text(c.compile(sep)), truth(c.compile(skip)), [text(c.compile(a)) for a in args]
    joined = F.array_join(F.filter(F.array(*[p.col for p in parts]), lambda x: ~b.col | (x != "")), "\u0000")
    return Typed("text", F.replace(joined, F.lit("\u0000"), s.col), first_error(s.err, b.err, *[p.err for p in parts]))


def formatted(c: Compiler, value, form):
    """``TEXT``: a constant code becomes an expression for each of its sections."""
    v = c.compile(value)
    if v.kind == "text":
        return text(v)
    if not isinstance(form, Const) or not isinstance(form.value, str) or v.kind != "number":
        return c.by_library(Call("TEXT", (value, form)))
    out = compiled(number(v).col, form.value, general, date_parts)
    return c.by_library(Call("TEXT", (value, form))) if out is None else Typed("text", out, v.err)


def date_parts(n: Column) -> tuple[Column, ...]:
    """Year, month, day, hour, minute and second of a serial number; a negative one has the date of day 1."""
    day = day_of(F.when(n < 0, 1.0).otherwise(n))
    parts = [F.when(F.floor(n) == 60, at60).otherwise(f(day)) for f, at60 in ((F.year, 1900), (F.month, 2), (F.day, 29))]
    s = _seconds(n)
    return (*parts, F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int"))


ROWWISE |= {"SUBSTITUTE": substitute, "CONCAT": concat, "CONCATENATE": concat, "TEXTJOIN": text_join, "TEXT": formatted}
ROWWISE["T"] = lambda c, a: Typed("text", text(x).col if (x := c.compile(a)).kind == "text" else F.lit(""), x.err)

# Logic and information


def pick(c: Compiler, tests: list[tuple[Typed, Typed]], last: Typed) -> Typed:
    """The first value whose test holds; of one kind, text if the kinds differ."""
    kinds = {v.kind for _, v in tests} | {last.kind}
    kinds.discard("error")
    kind = kinds.pop() if len(kinds) == 1 else "text"
    to = {"number": number, "text": text, "bool": truth}[kind] if len(kinds) else (lambda x: x if x.kind != "error" else Typed(kind, F.lit(None).cast({"number": "double", "text": "string", "bool": "boolean"}[kind]), x.err))
    null = F.lit(None).cast("string")
    value = err = None
    for test, v in tests:
        v = to(v)
        bad = test.err if test.err is not None else null
        step = F.coalesce(bad, v.err if v.err is not None else null)
        hit = bad.isNotNull() | test.col
        value = F.when(hit, v.col) if value is None else value.when(hit, v.col)
        err = F.when(hit, step) if err is None else err.when(hit, step)
    last = to(last)
    return Typed(kind, value.otherwise(last.col), err.otherwise(last.err if last.err is not None else null))




def _na() -> Typed:
    return Typed("error", F.lit(None).cast("double"), F.lit("#N/A"))


def if_(c: Compiler, test, yes, no=None):
    return pick(c, [(truth(c.compile(test)), c.compile(yes))], c.compile(no) if no is not None else Typed("bool", F.lit(False)))


def ifs(c: Compiler, *args):
    if len(args) % 2:
        return Typed("error", F.lit(None).cast("double"), F.lit("#VALUE!"))
    return pick(c, [(truth(c.compile(args[i])), c.compile(args[i + 1])) for i in range(0, len(args), 2)], _na())


def switch(c: Compiler, key, *rest):
    k = c.compile(key)
    tests = [(Typed("bool", order(k, c.compile(rest[i])) == 0, k.err), c.compile(rest[i + 1])) for i in range(0, len(rest) - 1, 2)]
    return pick(c, tests, c.compile(rest[-1]) if len(rest) % 2 else _na())


def choose_(c: Compiler, key, *values):
    k = number(c.compile(key))
    at = toward_zero(k.col)
    return pick(c, [(Typed("bool", at == i, k.err), c.compile(v)) for i, v in enumerate(values, 1)], Typed("error", F.lit(None).cast("double"), F.lit("#VALUE!")))


def caught(which: Callable[[Column], Column]):
    def call(c: Compiler, value, other):
        v, o = c.compile(value), c.compile(other)
        if v.err is None:
            return v
        if v.kind == "error":
            v = Typed(o.kind, F.lit(None).cast({"number": "double", "text": "string", "bool": "boolean"}.get(o.kind, "double")), v.err)
        kind = v.kind if v.kind == o.kind else "text"
        to = (lambda x: x) if v.kind == o.kind else text
        a, b, hit = to(v), to(o), F.coalesce(which(v.err), F.lit(False))
        return Typed(kind, F.when(hit, b.col).otherwise(a.col), F.when(hit, b.err if b.err is not None else F.lit(None).cast("string")).otherwise(v.err))

    return call


def all_of(f: Callable[[list[Column]], Column]):
    def call(c: Compiler, *args):
        given = [truth(c.compile(a)) for a in args]
        return Typed("bool", f([g.col for g in given]), first_error(*[g.err for g in given]))

    return call


def _reduce(op: Callable[[Column, Column], Column]):
    def call(cols: list[Column]) -> Column:
        out = cols[0]
        for x in cols[1:]:
            out = op(out, x)
        return out

    return call


def tells(f: Callable[[Typed, Column], Column]):
    """Information functions see errors instead of passing them on."""

    def call(c: Compiler, a):
        x = c.compile(a)
        return Typed("bool", f(x, x.err.isNotNull() if x.err is not None else F.lit(False)))

    return call


ROWWISE |= {
    "IF": if_, "IFS": ifs, "SWITCH": switch, "CHOOSE": choose_, "IFERROR": caught(lambda e: e.isNotNull()), "IFNA": caught(lambda e: e == "#N/A"),
    "AND": all_of(_reduce(lambda a, b: a & b)), "OR": all_of(_reduce(lambda a, b: a | b)), "XOR": all_of(_reduce(lambda a, b: a != b)),
    "NOT": lambda c, a: Typed("bool", ~(x := truth(c.compile(a))).col, x.err), "TRUE": lambda c: Typed("bool", F.lit(True)), "FALSE": lambda c: Typed("bool", F.lit(False)), "NA": lambda c: _na(),
    "ISBLANK": tells(lambda x, bad: x.col.isNull() & ~bad), "ISNUMBER": tells(lambda x, bad: x.col.isNotNull() & ~bad if x.kind == "number" else F.lit(False)),
    "ISTEXT": tells(lambda x, bad: x.col.isNotNull() & ~bad if x.kind == "text" else F.lit(False)), "ISNONTEXT": tells(lambda x, bad: x.col.isNull() | bad if x.kind == "text" else F.lit(True)),
    "ISLOGICAL": tells(lambda x, bad: x.col.isNotNull() & ~bad if x.kind == "bool" else F.lit(False)), "ISERROR": tells(lambda x, bad: bad),
    "ISERR": tells(lambda x, bad: F.coalesce(x.err != "#N/A", F.lit(False)) if x.err is not None else F.lit(False)), "ISNA": tells(lambda x, bad: F.coalesce(x.err == "#N/A", F.lit(False)) if x.err is not None else F.lit(False)),
    "ISREF": lambda c, a: Typed("bool", F.lit(isinstance(a, Name))),
    "N": lambda c, a: number(x) if (x := c.compile(a)).kind != "text" else Typed("number", F.lit(0.0), x.err),
    "TYPE": lambda c, a: Typed("number", F.when(x.err.isNotNull() if (x := c.compile(a)).err is not None else F.lit(False), 16.0).when(x.col.isNull(), 1.0).otherwise({"text": 2.0, "bool": 4.0}.get(x.kind, 1.0))),
    "ERROR.TYPE": lambda c, a: Typed("number", F.array_position(F.array(*map(F.lit, ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"))), x.err).cast("double"), F.when(x.err.isNull(), "#N/A")) if (x := c.compile(a)).err is not None else _na(),
}

# Dates: serial numbers, a day more from 1900-03-01 on, and the day 60 that never was



def serial_of(day: Column) -> Column:
    n = F.unix_date(day) + 25568
    return F.when(n >= 60, n + 1).otherwise(n).cast("double")


def day_of(serial: Column) -> Column:
    n = F.floor(serial).try_cast("int")
    return F.date_from_unix_date(F.when(n > 60, n - 1).otherwise(n) - F.lit(25568))


def date_part(part: Callable[[Column], Column], day60: float):
    return lambda n: _fail(F.when(F.floor(n) == 60, day60).otherwise(part(day_of(n)).cast("double")), n < 0)


rowwise("YEAR", "n", "number")(date_part(F.year, 1900.0))
rowwise("MONTH", "n", "number")(date_part(F.month, 2.0))
rowwise("DAY", "n", "number")(date_part(F.day, 29.0))
_seconds = lambda n: F.floor((n - F.floor(n)) * 86400 + 0.5) % 86400
rowwise("HOUR", "n", "number")(lambda n: _fail(F.floor(_seconds(n) / 3600).cast("double"), n < 0))
rowwise("MINUTE", "n", "number")(lambda n: _fail((F.floor(_seconds(n) / 60) % 60).cast("double"), n < 0))
rowwise("SECOND", "n", "number")(lambda n: _fail((_seconds(n) % 60).cast("double"), n < 0))
rowwise("TIME", "nnn", "number")(lambda h, m, s: (lambda x: x - F.floor(x))((h * 3600 + m * 60 + s) / 86400))
rowwise("DAYS", "nn", "number")(lambda end, start: (F.floor(end) - F.floor(start)).cast("double"))
rowwise("WEEKDAY", "nn", "number", 1.0)(lambda n, k: _fail((lambda s: F.when(k == 1, s + 1).when(k == 2, (s + 6) % 7 + 1).otherwise((s + 6) % 7))(F.pmod(F.floor(n) - 1, F.lit(7))).cast("double"), (n < 0) | ~toward_zero(k).isin(1.0, 2.0, 3.0)))


def months_on(n: Column, m: Column) -> Column:
    """From the day 60, 29 February 1900, as from 29 January and a month more."""
    return F.when(F.floor(n) == 60, F.add_months(F.lit("1900-01-29").cast("date"), m.try_cast("int") + 1)).otherwise(F.add_months(day_of(n), m.try_cast("int")))


rowwise("EDATE", "nn", "number")(lambda n, m: _fail(serial_of(months_on(n, m)), n < 0))
rowwise("EOMONTH", "nn", "number")(lambda n, m: _fail(serial_of(F.last_day(months_on(n, m))), n < 0))


@rowwise("DATE", "nnn", "number")
def date_(y: Column, m: Column, d: Column) -> Typed:
    y, m, d = (x.try_cast("int") for x in (y, m, d))
    y = F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y)
    out = serial_of(F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1))
    return _fail(out, out < 0)


@rowwise("DATEVALUE", "t", "number")
def date_value(s: Column) -> Typed:
    p = F.split(F.trim(s), "[-/]")
    ok = F.trim(s).rlike(r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,2}$")
    y, m, d = (F.when(ok, p[i].try_cast("int")) for i in range(3))
    ok = ok & m.between(1, 12) & d.between(1, 31)
    return _fail(serial_of(F.date_add(F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1)), d - 1)), ~F.coalesce(ok, F.lit(False)), "#VALUE!")


ROWWISE["TODAY"] = lambda c: Typed("number", F.lit(float(math.floor(c.now))))
ROWWISE["NOW"] = lambda c: Typed("number", F.lit(float(c.now)))

# Finance and engineering


def _growth(r: Column, n: Column, kind: Column) -> tuple[Column, Column]:
    g = F.pow(1 + r, n)
    return g, F.when(r == 0, n).otherwise(F.try_divide(g - 1, r) * (1 + r * (kind != 0).cast("double")))


rowwise("FV", "nnnnn", "number", 0.0, 0.0)(lambda r, n, p, v, k: (lambda g, s: -(v * g + p * s))(*_growth(r, n, k)))
rowwise("PV", "nnnnn", "number", 0.0, 0.0)(lambda r, n, p, v, k: (lambda g, s: -F.try_divide(v + p * s, g))(*_growth(r, n, k)))
rowwise("PMT", "nnnnn", "number", 0.0, 0.0)(lambda r, n, p, v, k: _fail((lambda g, s: -F.try_divide(p * g + v, s))(*_growth(r, n, k)), n == 0))


@rowwise("NPER", "nnnnn", "number", 0.0, 0.0)
def nper(r: Column, p: Column, pv: Column, fv: Column, kind: Column) -> Typed:
    q = p * (1 + r * (kind != 0).cast("double"))
    ratio = F.try_divide(q - fv * r, q + pv * r)
    flat = F.try_divide(-(pv + fv), p)
    return _fail(F.when(r == 0, flat).otherwise(F.try_divide(F.log(ratio), F.log(1 + r))), F.when(r == 0, p == 0).otherwise(~F.coalesce((ratio > 0) & (r > -1), F.lit(False))))


def _bits(f: Callable[[Column, Column], Column]):
    wrong = lambda x: (x < 0) | (x >= float(1 << 48))
    return lambda a, b: _fail(f(a.try_cast("long"), b.try_cast("long")).cast("double"), wrong(toward_zero(a)) | wrong(toward_zero(b)))


rowwise("BITAND", "nn", "number")(_bits(lambda a, b: a.bitwiseAND(b)))
rowwise("BITOR", "nn", "number")(_bits(lambda a, b: a.bitwiseOR(b)))
rowwise("BITXOR", "nn", "number")(_bits(lambda a, b: a.bitwiseXOR(b)))
for _n, (_base, _width) in {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}.items():
    _digits = "0-1" if _base == 2 else "0-7" if _base == 8 else "0-9A-Fa-f"

    def _from(s: Column, base=_base, width=_width, digits=_digits) -> Typed:
        t = F.trim(s)
        n = F.conv(t, base, 10).cast("double")
        return _fail(F.when((F.char_length(t) == width) & (n >= float(1 << width - 1)), n - float(1 << width)).otherwise(n), ~t.rlike(f"^[{digits}]{{1,{width}}}$"))

    rowwise(f"{_n}2DEC", "t", "number")(_from)

    def _to(n: Column, places: Column, base=_base, bits=_width) -> Typed:
        n, width = toward_zero(n).try_cast("long"), places.try_cast("int")
        digits = F.conv(F.when(n < 0, n + (1 << bits)).otherwise(n).cast("string"), 10, base)
        short = (n >= 0) & places.isNotNull() & (width < F.char_length(digits))
        padded = F.when(places.isNull() | (n < 0), digits).otherwise(F.lpad(digits, F.greatest(width, F.char_length(digits)), F.lit("0")))
        return _fail(padded, n.isNull() | (n < -(1 << bits - 1)) | (n >= (1 << bits - 1)) | F.coalesce(short, F.lit(False)))

    rowwise(f"DEC2{_n}", "nn", "text", None)(_to)


def _shift(sign: int):
    def call(n: Column, k: Column) -> Typed:
        n, k = toward_zero(n), toward_zero(k) * sign
        out = F.when(k >= 0, n * F.pow(F.lit(2.0), k)).otherwise(F.floor(n / F.pow(F.lit(2.0), -k)).cast("double"))
        return _fail(out, (n < 0) | (n >= float(1 << 48)) | (F.abs(k) > 53) | (out >= float(1 << 48)))

    return call


rowwise("BITLSHIFT", "nn", "number")(_shift(1))
rowwise("BITRSHIFT", "nn", "number")(_shift(-1))


def divisors(name: str):
    """``GCD`` and ``LCM`` of the whole parts of numbers in a row."""

    def call(c: Compiler, *args):
        given = [c.compile(a) for a in args]
        if not given or any(g.kind != "number" for g in given):
            return c.by_library(Call(name, args))
        nothing = F.lit(0.0 if name == "GCD" else 1.0)  # blanks don't count
        whole = [F.abs(F.coalesce(g.col, nothing)).try_cast("long") for g in given]
        out = whole[0]
        for x in whole[1:]:
            d = euclid(out, x)
            out = d if name == "GCD" else F.when(d == 0, 0).otherwise(F.try_multiply(F.try_divide(out, d).cast("long"), x))
        bad = _reduce(lambda a, b: a | b)([w.isNull() for w in whole])
        return Typed("number", out.cast("double"), first_error(*[g.err for g in given], code(bad, "#NUM!")))

    return call


ROWWISE |= {name: divisors(name) for name in ("GCD", "LCM")}

# Aggregates: only numbers of a column count, any error is the result


def whole_column(c: Compiler, args) -> tuple[list[Typed], Column | None]:
    given = [c.compile(a) for a in args]
    errs = [F.min(g.err) if not isinstance(a, Const) else g.err for g, a in zip(given, args, strict=True) if g.err is not None]
    return given, first_error(*errs)


def numeric(x: Typed) -> Column:
    return x.col if x.kind == "number" else F.lit(None).cast("double")


def some(op: Callable[[Column, Column], Column]) -> Callable[[list[Column]], Column]:
    """Folds what is not null."""
    return _reduce(lambda a, b: F.coalesce(op(a, b), a, b))


def aggregate(name: str, f: Callable[[Column], Column], empty: float | str, joined: Callable[[list[Column]], Column] | None = None) -> None:
    """Of columns; ``empty`` is the result without numbers: a value or an error.

    ``joined`` makes one of several columns' results; a constant is a column of one cell.
    """

    def call(c: Compiler, *args):
        given, err = whole_column(c, args)
        if len(given) == 1 and not isinstance(args[0], Const):
            out = f(numeric(given[0]))
        elif joined is None or not given:
            raise Unsupported(f"{name} of several columns")
        else:
            out = joined([(numeric(g), isinstance(a, Const)) for g, a in zip(given, args, strict=True)])
        if isinstance(empty, str):
            return finite(Typed("number", out, first_error(err, code(out.isNull(), empty))))
        return finite(Typed("number", F.coalesce(out, F.lit(empty)), err))

    AGGREGATES[name] = call


def each(f: Callable[[Column], Column], op: Callable[[Column, Column], Column], one: Callable[[Column], Column] = lambda x: x):
    """Results of columns, folded; ``one`` is the result of a single cell."""
    return lambda given: some(op)([one(x) if const else f(x) for x, const in given])


def spread(root: bool, sample: bool):
    """Variance over several columns from each one's count, mean and squares."""

    def call(given: list) -> Column:
        ns = [x.isNotNull().cast("double") if const else F.count(x).cast("double") for x, const in given]
        means = [F.coalesce(x if const else F.avg(x), F.lit(0.0)) for x, const in given]
        inner = [F.lit(0.0) if const else F.coalesce(F.var_pop(x), F.lit(0.0)) for x, const in given]
        add = _reduce(lambda a, b: a + b)
        n = add(ns)
        mean = F.try_divide(add([k * m for k, m in zip(ns, means, strict=True)]), n)
        squares = add([k * (v + (m - mean) * (m - mean)) for k, v, m in zip(ns, inner, means, strict=True)])
        out = F.try_divide(squares, n - 1 if sample else n)
        return F.sqrt(out) if root else out

    return call


def mean_of(given: list) -> Column:
    add = _reduce(lambda a, b: a + b)
    total = add([F.coalesce(x if const else F.sum(x), F.lit(0.0)) for x, const in given])
    return F.try_divide(total, add([x.isNotNull().cast("double") if const else F.count(x).cast("double") for x, const in given]))


_plus, _times = lambda a, b: a + b, lambda a, b: a * b
_squares = lambda x: F.sum(x * x)
for _n, _f, _e, _j in (
    ("SUM", F.sum, 0.0, each(F.sum, _plus)), ("PRODUCT", F.product, 0.0, each(F.product, _times)), ("SUMSQ", _squares, 0.0, each(_squares, _plus, lambda x: x * x)), ("AVERAGE", F.avg, "#DIV/0!", mean_of), ("AVERAGEA", F.avg, "#DIV/0!", mean_of),
    ("MAX", F.max, 0.0, each(F.max, F.greatest)), ("MIN", F.min, 0.0, each(F.min, F.least)), ("MEDIAN", F.median, "#NUM!", None),
    ("STDEV", F.stddev_samp, "#DIV/0!", spread(True, True)), ("STDEVP", F.stddev_pop, "#DIV/0!", spread(True, False)), ("VAR", F.var_samp, "#DIV/0!", spread(False, True)), ("VARP", F.var_pop, "#DIV/0!", spread(False, False)),
):
    aggregate(_n, _f, _e, _j)


def counting(f: Callable[[Typed, Column], Column]):
    def call(c: Compiler, *args):
        given = [c.compile(a) for a in args]
        hits = [F.count_if(f(g, g.err.isNotNull() if g.err is not None else F.lit(False))) for g in given]
        return Typed("number", _reduce(lambda a, b: a + b)(hits).cast("double"))

    return call


AGGREGATES["COUNT"] = counting(lambda x, bad: x.col.isNotNull() & ~bad if x.kind == "number" else F.lit(False))
AGGREGATES["COUNTA"] = counting(lambda x, bad: x.col.isNotNull() | bad)
AGGREGATES["COUNTBLANK"] = counting(lambda x, bad: ~bad & (x.col.isNull() | (x.col == "" if x.kind == "text" else F.lit(False))))


def meets(c: Compiler, pairs) -> Column:
    if not pairs or len(pairs) % 2:
        raise Unsupported("criteria come in pairs")
    out = []
    for i in range(0, len(pairs), 2):
        node = pairs[i + 1]
        sign = isinstance(node, Unary) and node.op == "-" and isinstance(node.of, Const)
        if not (isinstance(node, Const) or sign):
            raise Unsupported("a criterion must be constant")
        out.append(predicate(c.compile(pairs[i]), criterion(-node.of.value if sign else node.value)))
    return _reduce(lambda a, b: a & b)(out)


def conditional(name: str, f: Callable[[Column], Column], empty: float | str) -> None:
    def many(c: Compiler, values, *pairs):
        x = c.compile(values)
        own = F.when(x.err.isNull(), numeric(x)) if x.err is not None else numeric(x)
        out = f(F.when(meets(c, pairs), own))
        if isinstance(empty, str):
            return Typed("number", out, code(out.isNull(), empty))
        return Typed("number", F.coalesce(out, F.lit(empty)))

    AGGREGATES[name + "S"] = many
    if name in ("SUMIF", "AVERAGEIF"):
        AGGREGATES[name] = lambda c, rng, crit, values=None: many(c, rng if values is None else values, rng, crit)


conditional("SUMIF", F.sum, 0.0)
conditional("AVERAGEIF", F.avg, "#DIV/0!")
conditional("MAXIF", F.max, 0.0)
conditional("MINIF", F.min, 0.0)
AGGREGATES["COUNTIF"] = AGGREGATES["COUNTIFS"] = lambda c, *pairs: Typed("number", F.count_if(meets(c, pairs)).cast("double"))


def sum_product(c: Compiler, *args):
    def as_number(x: Typed) -> Column:
        own = x.col.cast("double") if x.err is None else F.when(x.err.isNull(), x.col.cast("double"))
        return F.coalesce(own, F.lit(0.0)) if x.kind in ("number", "bool") else F.lit(0.0)

    return finite(Typed("number", F.coalesce(F.sum(_reduce(lambda a, b: a * b)([as_number(c.compile(a)) for a in args])), F.lit(0.0))))


_SUBTOTALS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEVP", 9: "SUM", 10: "VAR", 11: "VARP"}


def subtotal(c: Compiler, fn, *args):
    """Errors are skipped, the maximum is at least 0 and an empty product is 1."""
    k = int(fn.value) if isinstance(fn, Const) and isinstance(fn.value, float) else 0
    name = _SUBTOTALS.get(k - 100 if k > 100 else k)
    if name is None or len(args) != 1:
        raise Unsupported("SUBTOTAL takes a constant code and one column")
    x = c.compile(args[0])
    clean = Typed(x.kind, F.when(x.err.isNull(), x.col) if x.err is not None else x.col)
    own = Compiler(c.columns | {"\0": clean}, c.now)
    out = AGGREGATES[name](own, Name("\0"))
    if name == "MAX":
        return Typed("number", F.greatest(out.col, F.lit(0.0)), out.err)
    if name == "PRODUCT":
        return Typed("number", F.coalesce(F.product(numeric(clean)), F.lit(1.0)), out.err)
    return out


AGGREGATES |= {"SUMPRODUCT": sum_product, "SUBTOTAL": subtotal}


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, T.NumericType):
        return "number"
    return "bool" if isinstance(t, T.BooleanType) else "text" if isinstance(t, T.StringType) else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def columns_of(df: DataFrame) -> dict[str, Typed]:
    """A DataFrame's columns as a formula sees them; dates and timestamps are serial numbers."""
    out = {}
    for f in df.schema.fields:
        kind, col = kind_of(f.dataType), F.col(f"`{f.name}`")
        if kind == "number":
            out[f.name.upper()] = Typed("number", col.cast("double"))
        elif kind == "date":
            at = col.cast("timestamp")
            day = col.cast("date")
            out[f.name.upper()] = Typed("number", serial_of(day) + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400)
        elif kind:
            out[f.name.upper()] = Typed(kind, col)
    return out


def formula_column(df: DataFrame, formula: str, now: float = 0.0) -> Typed:
    """The typed column of a formula (with or without its ``=``) over a DataFrame."""
    try:
        tree = parse(formula.removeprefix("="))
    except FormulaError as e:
        return Typed("error", F.lit(None).cast("double"), F.lit(e.error.code))
    return Compiler(columns_of(df), now).compile(tree)


def with_formulas(df: DataFrame, formulas: dict[str, str], errors: bool = False, now: float = 0.0) -> DataFrame:
    """``df`` with a column for each formula, null where it is an error; with ``errors`` also ``<name>_error``."""
    made = {k: formula_column(df, f, now) for k, f in formulas.items()}
    return df.select("*", *outputs(made, errors))


def outputs(made: dict[str, Typed], errors: bool) -> list[Column]:
    out = []
    for k, x in made.items():
        out.append((F.when(x.err.isNull(), x.col) if x.err is not None else x.col).alias(k))
        if errors:
            out.append((x.err if x.err is not None else F.lit(None).cast("string")).alias(f"{k}_error"))
    return out


def aggregate_formulas(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None, errors: bool = False, now: float = 0.0) -> DataFrame:
    """One row, or one per group, with a column for each formula of aggregates.

    Medians are selected, not gathered: see :func:`gridloom.operators.lookup.median`.
    """
    if any("MEDIAN" in f.upper() for f in formulas.values()):
        return _with_medians(df, formulas, by or [], errors, now)
    made = {k: formula_column(df, f, now) for k, f in formulas.items()}
    return df.groupBy(*(by or [])).agg(*outputs(made, errors))


def _with_medians(df: DataFrame, formulas: dict[str, str], by: list[str], errors: bool, now: float) -> DataFrame:
    """Aggregates in one pass, each median by selection; the formulas are compiled over both, joined by group."""
    columns = columns_of(df)
    inner, known, aggregates, medians = Compiler(columns, now), {}, [], []

    def taken(node):
        if node in known:
            return known[node]
        if isinstance(node, Call) and node.name in AGGREGATES:
            own = f"__A{len(known)}"
            known[node] = Name(own)
            if node.name == "MEDIAN":
                given, err = whole_column(inner, node.args)
                if not given or any(isinstance(a, Const) for a in node.args):
                    raise Unsupported("MEDIAN of columns")
                medians.append((own, F.array(*[numeric(g) for g in given])))
                x = Typed("number", F.col(own), err)
            else:
                x = AGGREGATES[node.name](inner, *node.args)
                aggregates.append(x.col.alias(own))
            aggregates.append((x.err if x.err is not None else F.lit(None).cast("string")).alias(f"{own}_e"))
            bad = F.col(f"{own}_e")
            finals[own] = Typed("number", F.col(own), bad if node.name != "MEDIAN" else first_error(bad, code(F.col(own).isNull(), "#NUM!")))
            return known[node]
        if isinstance(node, Unary):
            return Unary(node.op, taken(node.of))
        if isinstance(node, Binary):
            return Binary(node.op, taken(node.left), taken(node.right))
        return Call(node.name, tuple(map(taken, node.args))) if isinstance(node, Call) else node

    finals: dict[str, Typed] = {}
    trees = {k: taken(parse(f.removeprefix("="))) for k, f in formulas.items()}
    keys = [f"__g{i}" for i in range(len(by))]
    grouped = df.select("*", *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)])
    out = grouped.groupBy(*keys).agg(*aggregates)
    for own, values in medians:
        found = selected_median(grouped.select(*keys, F.explode(values).alias("__v")), "__v", keys, own)
        if keys:
            own_keys = {k: f"{k}_{own}" for k in keys}
            found = found.withColumnsRenamed(own_keys)
            out = out.join(found, _reduce(lambda a, b: a & b)([F.col(k).eqNullSafe(F.col(n)) for k, n in own_keys.items()]), "left").drop(*own_keys.values())
        else:
            out = out.join(F.broadcast(found))  # one row
    made = {k: Compiler(finals, now).compile(t) for k, t in trees.items()}
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *outputs(made, errors))
