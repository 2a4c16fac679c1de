"""Number format codes: sections, conditions, colours, numbers, fractions, dates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache

from gridloom.functions.cells import Err, general
from gridloom.functions.serial import from_serial, time_of

# The format's month names and named colours.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
COLORS = ("black", "blue", "cyan", "green", "magenta", "red", "white", "yellow")
#: The built-in format ids that a workbook may use without declaring them.
BUILTIN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 37: "#,##0;(#,##0)", 38: "#,##0;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 44: "#,##0.00"}

_QUOTED = re.compile(r'"[^"]*"?|\\.')
_BRACKET = re.compile(r"\[([^\]]*)\]")
_CONDITION = re.compile(r"(>=|<=|<>|>|<|=)\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)")
_PIECE = re.compile(r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.?)|(?P<exp>[Ee][-+0#]*)|(?P<char>.)', re.DOTALL)
_DATE_PIECE = re.compile(r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.?)|(?P<run>y+|m+|d+|h+|s+)|(?P<char>.)', re.DOTALL | re.IGNORECASE)


@dataclass(frozen=True)
class Section:
    body: str
    color: str | None = None
    condition: tuple[str, float] | None = None

    @property
    def kind(self) -> str:
        if self.body.lower() == "general":
            return "general"
        bare = _QUOTED.sub("", self.body)
        if re.search("[ymdhs]", bare, re.IGNORECASE):
            return "date"
        return "fraction" if re.search(r"[?#0]\s*/\s*[?#0-9]", self.body) and re.search(r"^[^/]*[?#0]\s*/\s*[?#0-9]", self.body) else "number"


@lru_cache(4096)
def sections(code: str) -> tuple[Section, ...]:
    out = []
    for raw in code.split(";"):
        color = condition = None
        body = raw
        while m := re.match(r"\s*\[([^\]]*)\]", body):
            tag = m[1].strip()
            if c := _CONDITION.fullmatch(tag):
                condition = (c[1], float(c[2]))
            elif tag.lower() in COLORS or re.fullmatch(r"(?i)color\s*\d+", tag):
                color = tag
            elif tag.startswith("$"):
                body = f'"{tag[1:].split("-")[0]}"' + body[m.end() :]
                break
            body = body[m.end() :]
        body = _BRACKET.sub(lambda m: f'"{m[1][1:].split("-")[0]}"' if m[1].startswith("$") else "", body)
        out.append(Section(body, color, condition))
    return tuple(out)


def choose(parts: tuple[Section, ...], value: float) -> tuple[Section, bool]:
    """The section for a value, and whether it shows the value without its sign."""
    if any(p.condition for p in parts):
        test = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}
        return next((p for p in parts if not p.condition or test[p.condition[0]](value, p.condition[1])), parts[-1]), False
    if len(parts) == 1:
        return parts[0], False
    if value < 0:
        return parts[1], True
    return parts[2 if len(parts) > 2 and not value > 0 else 0], False


@dataclass(frozen=True)
class NumberCode:
    prefix: str
    suffix: str
    whole: int
    decimals: int
    thousands: bool
    percent: bool
    scientific: bool
    placeholder: bool


@lru_cache(4096)
def number_code(body: str) -> NumberCode:
    around, digits, decimal = ["", ""], False, False
    whole = decimals = 0
    thousands = percent = scientific = placeholder = False
    for m in _PIECE.finditer(body):
        c = m["char"]
        if m["exp"]:
            scientific = digits = placeholder = True
        elif c is None or c not in "0#?.,%":
            around[digits] += m["quoted"] or m["escaped"] or c or ""
        elif c in "0#?":
            digits = placeholder = True
            decimals += decimal and c == "0"
            whole += not decimal and c == "0"
        elif c == ".":
            digits = decimal = True
        elif c == ",":
            thousands = thousands or digits and not decimal
        else:
            percent = True
    return NumberCode(around[0], around[1], whole, decimals, thousands, percent, scientific, placeholder)


def format_number(value: float, body: str) -> str:
    f = number_code(body)
    if not f.placeholder:
        return f.prefix + f.suffix
    v = value * 100 if f.percent else value
    if not math.isfinite(v):
        return "#NUM!"
    if f.scientific:
        mantissa, exponent = f"{v:.{f.decimals}e}".split("e")
        return f"{f.prefix}{mantissa}e{int(exponent)}{f.suffix}"
    digits = format(Decimal(abs(v)).quantize(Decimal(1).scaleb(-f.decimals), rounding=ROUND_HALF_EVEN) if abs(v) < 1e27 else Decimal(abs(v)), "f")
    whole, _, rest = digits.partition(".")
    whole = (whole.lstrip("0") or "0").rjust(f.whole, "0")
    if f.thousands:
        whole = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", whole)
    return ("-" if v < 0 else "") + f.prefix + whole + (f".{rest}" if f.decimals else "") + "%" * f.percent + f.suffix


def format_fraction(value: float, body: str) -> str:
    """A whole part where the code has one, then the fixed or the closest denominator."""
    left, right = body.split("/", 1)
    right = right.strip()
    mixed = bool(re.search(r"[#0?]\s+[#0?]+\s*$", left))
    sign, v = "-" if value < 0 else "", abs(value)
    whole = math.floor(v) if mixed else 0
    part = v - whole
    if fixed := re.match(r"\d+", right):
        d = max(1, int(fixed[0]))
        n = math.floor(part * d + 0.5)
    else:
        most = 10 ** min(4, max(1, len(re.match(r"[?#0]+", right)[0]))) - 1
        n, d, best = 0, 1, math.inf
        for q in range(1, most + 1):
            p = math.floor(part * q + 0.5)
            gap = abs(part - p / q)
            if gap < best - 1e-12:
                n, d, best = p, q, gap
            if gap < 1e-12:
                break
    if mixed and n >= d:
        whole, n = whole + 1, n - d
    if mixed and n == 0:
        return f"{sign}{whole}"
    return f"{sign}{whole} {n}/{d}" if mixed and whole else f"{sign}{n}/{d}"


def format_date(value: float, body: str) -> str:
    y, mo, d = from_serial(value) if value >= 0 else (1900, 1, 1)
    hh, mi, ss = time_of(value)
    two = lambda n, run: f"{n:02}" if len(run) > 1 else str(n)
    out = ""
    for m in _DATE_PIECE.finditer(body):
        run = (m["run"] or "").lower()
        if not run:
            out += m["quoted"] or m["escaped"] or m["char"] or ""
        elif run[0] == "y":
            out += f"{y:04}" if len(run) > 2 else f"{y % 100:02}"
        elif run[0] == "m":
            before = re.search(r"[a-z](?=[^a-z]*$)", body[: m.start()], re.IGNORECASE)
            after = re.search(r"[a-z]", body[m.end() :], re.IGNORECASE)
            minute = before and before[0] in "hH" or after and after[0] in "sS"
            out += f"{mi:02}" if minute else two(mo, run) if len(run) < 3 else MONTHS[mo - 1][:3] if len(run) == 3 else MONTHS[mo - 1]
        else:
            out += two({"d": d, "h": hh, "s": ss}[run[0]], run)
    return out


def format_with(value: float, code: str) -> tuple[str, str | None]:
    """Text and colour of a number under a format code."""
    code = code.strip()
    section, bare = (Section("general"), False) if not code else choose(sections(code), value)
    v = abs(value) if bare else value
    if section.kind == "general":
        text = general(v)
        return text.code if isinstance(text, Err) else text, section.color
    return {"date": format_date, "fraction": format_fraction, "number": format_number}[section.kind](v, section.body), section.color
