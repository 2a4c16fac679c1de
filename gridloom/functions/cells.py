"""Cell values and their coercions.

A value is ``None`` (blank), ``float``, ``str``, ``bool``, :class:`Err` or :class:`Arr`.
Errors are values: they travel through expressions instead of being raised.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Err:
    code: str

    def __repr__(self) -> str:
        return self.code


NULL, DIV0, VALUE, REF, NAME, NUM, NA = ERRORS = tuple(Err(c) for c in ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"))
BY_CODE = {e.code: e for e in ERRORS}


class Arr:
    """A rectangle of values."""

    def __init__(self, rows: list[list]):
        self.rows = rows

    @property
    def flat(self) -> list:
        return [v for row in self.rows for v in row]

    @property
    def height(self) -> int:
        return len(self.rows)

    @property
    def width(self) -> int:
        return len(self.rows[0]) if self.rows else 0

    def __eq__(self, other) -> bool:
        return isinstance(other, Arr) and self.rows == other.rows

    def __repr__(self) -> str:
        return f"Arr({self.rows})"


#: What a number may look like as text, after trimming.
NUMBER_TEXT = re.compile(r"[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.IGNORECASE | re.ASCII)


def parse_number(text: str) -> float | None:
    text = text.strip()
    return float(text) if NUMBER_TEXT.fullmatch(text) else None


def top_left(v):
    while isinstance(v, Arr):
        v = v.rows[0][0] if v.rows and v.rows[0] else None
    return v


def to_number(v) -> float | Err:
    v = top_left(v)
    if v is None:
        return 0.0
    if isinstance(v, bool):
        return 1.0 if v else 0.0
    if isinstance(v, (float, Err)):
        return v
    text = v.strip()
    percent = text.endswith("%")
    n = parse_number(text[:-1] if percent else text)
    return VALUE if n is None else n / 100 if percent else n


def to_text(v) -> str | Err:
    v = top_left(v)
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return general(v) if isinstance(v, float) else v


def to_bool(v) -> bool | Err:
    v = top_left(v)
    if v is None:
        return False
    if isinstance(v, (bool, Err)):
        return v
    if isinstance(v, float):
        return v != 0
    return {"TRUE": True, "FALSE": False}.get(v.strip().upper(), VALUE)


def general(n: float) -> str | Err:
    """At most 15 significant digits, never an exponent."""
    if not math.isfinite(n):
        return NUM
    n = float(f"{n:.14e}")
    if n == 0:
        return "0"
    text = format(Decimal(repr(n)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def finite(n: float) -> float | Err:
    return n if math.isfinite(n) else NUM


def display(v) -> str:
    """What a cell shows: an error's code, an array's first value."""
    v = to_text(v)
    return v.code if isinstance(v, Err) else v


def literal(text: str):
    """A typed-in value: TRUE or FALSE, a finite number as a whole, else text; nothing for nothing."""
    if text == "":
        return None
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    n = parse_number(text)
    return n if n is not None and math.isfinite(n) else text


def compare(a, b) -> int:
    """-1, 0 or 1. Numbers before text before booleans; a blank is what the other side makes of it."""
    if a is None and b is None:
        return 0
    if a is None or b is None:
        other = b if a is None else a
        blank = False if isinstance(other, bool) else 0.0 if isinstance(other, float) else "" if isinstance(other, str) else None
        a, b = (blank, b) if a is None else (a, blank)
    kind = lambda v: 2 if isinstance(v, bool) else 1 if isinstance(v, str) else 0
    if kind(a) != kind(b):
        return (kind(a) > kind(b)) - (kind(a) < kind(b))
    if isinstance(a, str):
        a, b = a.lower(), b.lower()
    elif not (isinstance(a, float) and isinstance(b, float)) and not isinstance(a, bool):
        return 0  # errors and arrays equal any number
    return (a > b) - (a < b)


@dataclass(frozen=True)
class Criterion:
    """``op`` and an operand that is a number, a wildcard pattern or a boolean."""

    op: str
    number: float | None = None
    text: str | None = None
    flag: bool | None = None


def criterion(v) -> Criterion | None:
    """None matches nothing."""
    if isinstance(v, bool):
        return Criterion("=", flag=v)
    if isinstance(v, float):
        return Criterion("=", number=v)
    if not isinstance(v, str):
        return None
    text = v.strip()
    op = next((o for o in (">=", "<=", "<>", ">", "<", "=") if text.startswith(o)), "")
    rest = text[len(op) :]
    n = parse_number(rest)
    return Criterion(op or "=", number=n) if n is not None else Criterion(op or "=", text=rest)


def wildcard(pattern: str) -> str:
    """A regular expression for ``*`` and ``?`` over the whole text; nothing else is special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


_ORDER = {"=": (0,), "<>": (-1, 1), "<": (-1,), "<=": (-1, 0), ">": (1,), ">=": (0, 1)}


def matches(v, c: Criterion | None) -> bool:
    if c is None:
        return False
    if c.flag is not None:
        return isinstance(v, bool) and v == c.flag
    if c.number is not None:
        n = to_number(v)
        return c.op == "<>" if isinstance(n, Err) else ((n > c.number) - (n < c.number)) in _ORDER[c.op] if n == n else c.op == "<>"
    own = to_text(v)
    if c.op in ("=", "<>"):
        same = not isinstance(v, (Err, Arr)) and re.match(wildcard(c.text.lower()), own.lower()) is not None
        return same == (c.op == "=")
    own = "" if isinstance(own, Err) else own
    a, b = own.lower(), c.text.lower()
    return ((a > b) - (a < b)) in _ORDER[c.op]
