"""The formula language: text to a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gridloom.functions.cells import BY_CODE, NAME, NUM, REF, Err

MAX_ROW, MAX_COL, MAX_DEPTH = 1_048_576, 16_384, 128


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Cell:
    """``fixed``: whether row and column are written with a dollar sign."""

    row: int
    col: int
    sheet: str | None = None
    fixed: tuple[bool, bool] = field(default=(False, False), compare=False)


@dataclass(frozen=True)
class Area:
    row0: int
    col0: int
    row1: int
    col1: int
    sheet: str | None = None
    ends: tuple[Cell, Cell] | None = field(default=None, compare=False)

    @property
    def height(self) -> int:
        return self.row1 - self.row0 + 1

    @property
    def width(self) -> int:
        return self.col1 - self.col0 + 1


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


class FormulaError(ValueError):
    """A formula that does not parse; ``error`` is the value that its cell shows."""

    def __init__(self, error: Err):
        super().__init__(error.code)
        self.error = error


_TOKEN = re.compile(
    r"""[ \t\r\n]+
    | (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<str>"(?:[^"]|"")*")
    | (?P<err>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A))
    | (?P<quoted>'(?:[^']|'')*')
    | (?P<ident>[A-Za-z_$][A-Za-z0-9_.$]*)
    | (?P<op><>|<=|>=|[-+*/^&%(),:!=<>])""",
    re.VERBOSE | re.IGNORECASE | re.ASCII,
)
_A1 = re.compile(r"\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6})", re.IGNORECASE)
#: Left binding power of the infix operators; ``^`` alone groups to the right.
_POWER = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}
_UNARY = 6


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def column_name(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_a1(text: str) -> tuple[int, int] | None:
    """Row and column from 0, or None."""
    m = _A1.fullmatch(text)
    if not m:
        return None
    row, col = int(m[2]) - 1, column_index(m[1])
    return (row, col) if row < MAX_ROW and col < MAX_COL else None


def dollars(text: str) -> tuple[bool, bool]:
    """Whether a reference's row and column are fixed."""
    return "$" in text[1:], text.startswith("$")


def a1(row: int, col: int) -> str:
    return f"{column_name(col)}{row + 1}"


def area(a: Cell, b: Cell, sheet: str | None = None) -> Area:
    return Area(min(a.row, b.row), min(a.col, b.col), max(a.row, b.row), max(a.col, b.col), sheet, (a, b))


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(NAME)
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        kind, found = self.peek()
        if kind == "end" or text is not None and (kind, found) != ("op", text):
            raise FormulaError(NAME)
        self.at += 1
        return kind, found

    def expression(self, power: int = 0):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise FormulaError(NUM)
        left = self.operand()
        while True:
            kind, op = self.peek()
            if (kind, op) == ("op", "%"):
                self.take()
                left = Unary("%", left)
                continue
            if (kind, op) == ("op", ":"):
                self.take()
                right = self.expression(_UNARY + 1)
                left = area(left, right, left.sheet) if isinstance(left, Cell) and isinstance(right, Cell) else Const(REF)
                continue
            own = _POWER.get(op) if kind == "op" else None
            if own is None or own <= power:
                break
            self.take()
            left = Binary(op, left, self.expression(own - 1 if op == "^" else own))
        self.depth -= 1
        return left

    def operand(self):
        kind, text = self.take()
        if kind == "num":
            return Const(float(text))
        if kind == "str":
            return Const(text[1:-1].replace('""', '"'))
        if kind == "err":
            return Const(BY_CODE[text.upper()])
        if kind == "op" and text in "+-":
            return Unary(text, self.expression(_UNARY))
        if kind == "op" and text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind in ("ident", "quoted"):
            return self.named(text[1:-1].replace("''", "'") if kind == "quoted" else text, kind == "quoted")
        raise FormulaError(NAME)

    def named(self, text: str, quoted: bool):
        if self.peek() == ("op", "!"):
            self.take()
            first = self.cell()
            if self.peek() == ("op", ":"):
                self.take()
                return area(first, self.cell(), text)
            return Cell(first.row, first.col, text, first.fixed)
        if self.peek() == ("op", "(") and not quoted:
            self.take()
            args = []
            if self.peek() != ("op", ")"):
                args.append(self.expression())
                while self.peek() == ("op", ","):
                    self.take()
                    args.append(self.expression())
            self.take(")")
            return Call(text.upper(), tuple(args))
        if text.upper() in ("TRUE", "FALSE") and not quoted:
            return Const(text.upper() == "TRUE")
        at = None if quoted else parse_a1(text)
        return Cell(*at, fixed=dollars(text)) if at else Name(text.upper())

    def cell(self) -> Cell:
        kind, text = self.take()
        at = parse_a1(text) if kind == "ident" else None
        if at is None:
            raise FormulaError(REF if kind == "ident" else NAME)
        return Cell(*at, fixed=dollars(text))


def parse(text: str):
    """The tree of a formula without its leading ``=``."""
    p = _Parser(text)
    tree = p.expression()
    if p.at != len(p.tokens):
        raise FormulaError(NAME)
    return tree


def walk(node):
    """The node and all below it."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        if isinstance(n, Unary):
            stack.append(n.of)
        elif isinstance(n, Binary):
            stack += [n.left, n.right]
        elif isinstance(n, Call):
            stack += n.args
