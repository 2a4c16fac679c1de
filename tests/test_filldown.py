"""Formulas filled down a sheet, against the evaluator of single cells."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import Err
from gridloom.plans.compiler import Unsupported
from gridloom.plans.filldown import classes, fill_down
from gridloom.plans.workbook import Workbook

SHEET = [(i, (None, 1.0, 2.0, -3.5, 7.0)[i * 3 % 5], (4.0, 0.0, None, 2.0)[i % 4], ("x", None, "yy")[i % 3]) for i in range(30)]
OTHER = [(i, float(i * i), (1.0, None, 5.0)[i % 3]) for i in range(20)]
AT = 5
FORMULAS = {
    "d": "SUM(A$1:A6)", "e": "A6-A5", "f": "AVERAGE(A4:A6)", "g": "SUM(A$4:B6)", "h": "MAX(A6:B8)+$A$3", "i": "A6/B6", "j": "SUM(I$1:I6)", "k": "I5+1", "l": 'C4&"-"&C6', "m": "COUNT(A$1:B$9)+SUM(Other!A$1:A6)", "n": "Other!B6+Other!$A$4",
    "o": "Nope!A1+1", "p": "SUM(Other!A4:B7)", "q": "MIN(A5:A6,B$10:B6)", "r": "IFERROR(J6,0)+SUM(A6:A$20)", "s": "ZZ6+1",
}


def moved(formula: str, down: int) -> str:
    """The text of a formula further down; a reference above the first row breaks it."""

    def at(m) -> str:
        row = int(m[3]) + (0 if m[2] else down)
        return f"{m[1]}{m[2]}{row}" if row >= 1 else "#REF!"

    text = re.sub(r"(\$?\b[A-Z]{1,2})(\$?)([0-9]+)", at, formula)
    return "#REF!" if re.search(r"[:!]#REF!|#REF!:", text) else text


@pytest.fixture(scope="module")
def sheets(spark):
    return spark.createDataFrame(SHEET, "_row long, a double, b double, c string").repartition(3), spark.createDataFrame(OTHER, "_row long, p double, q double")


def test_a_filled_formula_is_each_cells_own(sheets):
    df, other = sheets
    got = fill_down(df, FORMULAS, AT, {"Other": other}, errors=True).collect()
    book = Workbook()
    for i, *values in SHEET:
        for c, v in enumerate(values):
            book.set_value(i, c, v)
        for c, text in enumerate(FORMULAS.values(), 3):
            book.set_input(i, c, "=" + moved(text, i - AT))
    book.add_sheet("Other", {(i, c): v for i, *values in OTHER for c, v in enumerate(values) if v is not None})
    want, wrong = book.evaluate_all(), []
    for r in got:
        for c, name in enumerate(FORMULAS, 3):
            w, v = want.get((r["_row"], c)), r[f"{name}_error"] or r[name]
            if not (v == w.code if isinstance(w, Err) else abs(v - w) < 1e-9 if isinstance(w, float) and isinstance(v, float) else v == w):
                wrong.append((r["_row"], FORMULAS[name], v, w))
    assert len(got) == len(SHEET) and wrong == []


def test_no_python_and_no_sweep_of_the_whole_sheet(sheets):
    df, other = sheets
    plan = fill_down(df, {"x": "SUM(A$1:A6)", "y": "A6-A5", "z": "Other!A6"}, AT, {"Other": other})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan


def test_classes_of_formulas():
    found = classes({(0, 2): "=A1+SUM(B$1:B1)", (1, 2): "=A2+SUM(B$1:B2)", (2, 2): "=A3+SUM($B$1:B3)", (3, 2): "=A3+1"})
    assert sorted(map(len, found.values())) == [1, 3]


def test_what_cannot_be_filled(sheets):
    df, _ = sheets
    for formula in ("D5+1", "SUM(D$1:D5)", "SUM(A$1:A7)"):
        with pytest.raises(Unsupported):
            fill_down(df, {"d": formula}, AT)
    assert fill_down(df.limit(0), {"d": "SUM(A$1:A6)+A5"}, AT).collect() == []


def test_an_area_down_to_a_fixed_row_is_swept_once(spark):
    n, end = 3000, 2500
    df = spark.range(n).select(F.col("id").alias("_row"), (F.col("id") % 7).cast("double").alias("a")).repartition(3)
    made = fill_down(df, {"x": f"SUM(A1:A${end})", "y": f"MAX(A1:A${end})+COUNT(A1:A${end})"}, 0)
    # A frame from the row to the end is summed anew for each row.
    assert "currentrow$(), unboundedfollowing$()" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    a, own = [float(i % 7) for i in range(n)], lambda i: slice(min(i, end - 1), max(i, end - 1) + 1)
    assert {r["_row"]: (r["x"], r["y"]) for r in made.collect()} == {i: (sum(a[own(i)]), max(a[own(i)]) + len(a[own(i)])) for i in range(n)}
