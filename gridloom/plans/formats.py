"""Number format codes as columns: a code is read on the driver, each of its sections becomes one expression.

Sections, conditions, dates and fractions included; only scientific notation is left to
the library, as its rounding is not that of any built-in function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numfmt import _DATE_PIECE, MONTHS, Section, number_code, sections


def compiled(value: Column, code: str, general, parts_of_date) -> Column | None:
    """The text of a number under a code; None where the code has no column form.

    ``general`` shows a number without a code, ``parts_of_date`` gives year, month, day,
    hour, minute and second of a serial number.
    """
    code = code.strip()
    found = sections(code) if code else (Section("general"),)

    def shown(p: Section, v: Column) -> Column | None:
        if p.kind == "general":
            return general(v)
        if p.kind == "date":
            return date_text(v, p.body, parts_of_date)
        return fraction_text(v, p.body) if p.kind == "fraction" else number_text(v, p.body)

    if any(p.condition for p in found):
        last = next((i for i, p in enumerate(found) if not p.condition), len(found) - 1)
        chosen = [(condition(value, *p.condition), shown(p, value)) for p in found[:last]]
        other = shown(found[last], value)
    elif len(found) == 1:
        chosen, other = [], shown(found[0], value)
    else:
        chosen = [(value < 0, shown(found[1], F.abs(value)))]
        if len(found) > 2:
            chosen.append((~(value > 0), shown(found[2], value)))
        other = shown(found[0], value)
    if other is None or any(c is None for _, c in chosen):
        return None
    out = None
    for test, text in chosen:
        out = F.when(test, text) if out is None else out.when(test, text)
    return other if out is None else out.otherwise(other)


def condition(v: Column, op: str, bound: float) -> Column:
    return {">": v > bound, "<": v < bound, ">=": v >= bound, "<=": v <= bound, "=": v == bound, "<>": v != bound}[op]


def number_text(value: Column, body: str) -> Column | None:
    """Halves go to the even digit; a sign stands before the text around the digits."""
    f = number_code(body)
    if not f.placeholder:
        return F.lit(f.prefix + f.suffix)
    if f.scientific:
        return None
    n = value * 100 if f.percent else value
    whole = "0" * max(1, f.whole)
    if f.thousands:
        whole = "#," + whole.rjust(3, "#") if len(whole) <= 3 else whole[:-3] + "," + whole[-3:]
    shown = F.call_function("format_number", F.abs(n), F.lit(whole + ("." + "0" * f.decimals if f.decimals else "")))
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lit(f.prefix), shown, F.lit("%" * f.percent + f.suffix))


def whole(n: Column) -> Column:
    return n.cast("long").cast("string")


def fraction_text(value: Column, body: str) -> Column:
    """A whole part where the code has one, then the code's denominator or the closest of as many digits."""
    left, right = body.split("/", 1)
    right = right.strip()
    mixed = bool(re.search(r"[#0?]\s+[#0?]+\s*$", left))
    v = F.abs(value)
    integer = F.floor(v).cast("double") if mixed else F.lit(0.0)
    part = v - integer
    if fixed := re.match(r"\d+", right):
        d = F.lit(float(max(1, int(fixed[0]))))
        found = F.struct(F.floor(part * d + 0.5).cast("double").alias("p"), d.alias("q"))
    else:
        found = closest(part, 10 ** min(4, max(1, len(re.match(r"[?#0]+", right)[0]))) - 1)
    # One step binds the fraction to a name, so that it is not found again for each use.
    made = F.transform(F.array(found), lambda x: _fraction(value < 0, integer, x["p"], x["q"], mixed))
    return F.get(made, 0)


def _fraction(negative: Column, integer: Column, n: Column, d: Column, mixed: bool) -> Column:
    sign = F.when(negative, "-").otherwise("")
    plain = F.concat(sign, whole(n), F.lit("/"), whole(d))
    if not mixed:
        return plain
    over = n >= d
    integer, n = F.when(over, integer + 1).otherwise(integer), F.when(over, n - d).otherwise(n)
    return F.when(n == 0, F.concat(sign, whole(integer))).when(integer != 0, F.concat(sign, whole(integer), F.lit(" "), whole(n), F.lit("/"), whole(d))).otherwise(F.concat(sign, whole(n), F.lit("/"), whole(d)))


def closest(x: Column, most: int) -> Column:
    """The closest ``p/q`` to a number with ``q`` up to ``most``, the smaller ``q`` of two as close.

    A continued fraction: each step appends a term as long as the denominator allows; a
    step that would go beyond takes the largest term that does not, if that is closer.
    """
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), F.floor(x).cast("double").alias("p1"), F.lit(1.0).alias("q1"), (x - F.floor(x)).alias("rest"), F.lit(False).alias("done"))

    def step(s: Column, _) -> Column:
        gap = F.abs(x - s["p1"] / s["q1"])
        term = F.floor(1 / s["rest"]).cast("double")
        fits = term * s["q1"] + s["q"] <= most
        least = F.floor((most - s["q"]) / s["q1"]).cast("double")
        p2, q2 = F.when(fits, term).otherwise(least) * s["p1"] + s["p"], F.when(fits, term).otherwise(least) * s["q1"] + s["q"]
        better = F.when(fits, True).otherwise((least > 0) & (F.abs(x - p2 / q2) < gap - 1e-12))
        stop = s["done"] | (gap < 1e-12) | (s["rest"] < 1e-13)
        moved = F.struct(s["p1"].alias("p"), s["q1"].alias("q"), F.when(better, p2).otherwise(s["p1"]).alias("p1"), F.when(better, q2).otherwise(s["q1"]).alias("q1"), (1 / s["rest"] - term).alias("rest"), (~fits).alias("done"))
        return F.when(stop, s.withField("done", F.lit(True))).otherwise(moved)

    # Denominators grow at least as the Fibonacci numbers, of which the twentieth is over 9,999.
    made = F.aggregate(F.sequence(F.lit(1), F.lit(22)), start, step)
    return F.struct(made["p1"].alias("p"), made["q1"].alias("q"))


def date_text(value: Column, body: str, parts_of_date) -> Column:
    y, mo, d, hh, mi, ss = parts_of_date(value)
    two = lambda n, run: F.lpad(n.cast("string"), 2, "0") if len(run) > 1 else n.cast("string")
    out = []
    for m in _DATE_PIECE.finditer(body):
        run = (m["run"] or "").lower()
        if not run:
            out.append(F.lit(m["quoted"] or m["escaped"] or m["char"] or ""))
        elif run[0] == "y":
            out.append(F.lpad(y.cast("string"), 4, "0") if len(run) > 2 else F.lpad((y % 100).cast("string"), 2, "0"))
        elif run[0] == "m":
            before = re.search(r"[a-z](?=[^a-z]*$)", body[: m.start()], re.IGNORECASE)
            after = re.search(r"[a-z]", body[m.end() :], re.IGNORECASE)
            if before and before[0] in "hH" or after and after[0] in "sS":
                out.append(F.lpad(mi.cast("string"), 2, "0"))
            elif len(run) < 3:
                out.append(two(mo, run))
            else:
                out.append(F.get(F.lit([n[:3] if len(run) == 3 else n for n in MONTHS]), mo - 1))
        else:
            out.append(two({"d": d, "h": hh, "s": ss}[run[0]], run))
    return F.concat(F.lit(""), *out)
