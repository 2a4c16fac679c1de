"""Formulas that look beyond their row, against the evaluator of single cells."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import Err
from gridloom.operators import lookup as L
from gridloom.plans.compiler import Unsupported
from gridloom.plans.relational import Table, spilled, with_table_formulas
from gridloom.plans.workbook import Workbook

CELLS = [(i, (None, 1.0, 2.0, 2.5, 3.0, -1.0, 10.0)[i * 5 % 7], (None, "", "a", "A", "ab", "abc", "b", "2", "2.5%", "x*y", "<3")[i * 3 % 11], (True, False, None)[i % 3], (None, 1.5, 2.0, -3.0, 7.0)[i * 2 % 5]) for i in range(40)]
ASKED = [(1.0, "a"), (2.0, "<2.5"), (None, None), (2.5, ">=a"), (7.0, "<>2"), (-1.0, "a*"), (0.0, "?b*"), (3.0, ""), (4.0, "??"), (5.0, "*"), (6.0, "<>"), (8.0, "=2"), (9.0, ">2"), (10.0, "<=2"), (11.0, "<b"), (12.0, "x*y"), (13.0, ">0")]
NAMES = "iKSLV".upper()


@pytest.fixture(scope="module")
def tables(spark):
    o = spark.createDataFrame(CELLS, "i int, k double, s string, l boolean, v double").repartition(3)
    return spark.createDataFrame([(i, *a) for i, a in enumerate(ASKED)], "id int, k double, s string"), {"o": Table(o, "i")}


def expected(formula: str, k, s) -> object:
    book = Workbook()
    for r, row in enumerate(CELLS):
        for c, v in enumerate(row):
            book.set_value(r, c, float(v) if type(v) is int else v)
    book.set_value(0, 10, k)
    book.set_value(0, 11, s)
    column = lambda m: (lambda a: f"{a}1:{a}{len(CELLS)}")("ABCDE"["IKSLV".index(m[1].upper())])
    formula = re.sub(r"\bo\.(\w)", column, formula)
    return book.eval_formula(re.sub(r"\bs\b", "L1", re.sub(r"\bk\b", "K1", formula)))


@pytest.mark.parametrize(
    "formula",
    [
        "SUMIF(o.k,k,o.v)", 'AVERAGEIF(o.k,"<"&k,o.v)', 'SUMIFS(o.v,o.k,">="&k,o.v,"<"&k)', "SUMIF(o.s,s,o.v)", 'MAXIFS(o.v,o.k,"<>"&k)', 'MINIFS(o.v,o.k,">"&k,o.i,"<"&k*4)', 'COUNTIFS(o.s,"a*",o.l,k>2)', 'COUNTIFS(o.i,">"&k,o.i,"<"&k*6,o.v,"<="&k)',
        "k/SUM(o.v)+COUNT(o.k)*MAX(o.v,o.k,3)", 'SUMIF(o.s,"a*",o.v)*k', "STDEV(o.v,o.k)-VARP(o.k,2)+PRODUCT(2,3)", "INDEX(o.s,k)", "LARGE(o.v,k)", "SMALL(o.k,k*2)", "MATCH(k,o.i,1)", "MATCH(s,o.s,0)",
    ],
)
def test_a_formula_is_what_the_evaluator_says(tables, formula):
    df, known = tables
    wrong = []
    for r in with_table_formulas(df, {"x": formula}, known, errors=True).collect():
        want = expected(formula, r["k"], r["s"])
        got = r["x_error"] or r["x"]
        if isinstance(want, Err):
            same = got == want.code
        elif isinstance(want, float):
            same = isinstance(got, float) and abs(got - want) <= 1e-9 * max(1.0, abs(want))
        else:
            same = got == want
        if not same:
            wrong.append((r["k"], r["s"], got, want))
    assert wrong == []


def test_places_downwards(spark):
    down = spark.createDataFrame([(i, x) for i, x in enumerate([9.0, 7.0, 7.0, 4.0, 1.0])], "i int, x double")
    asked = spark.createDataFrame([(x,) for x in (10.0, 9.0, 8.0, 7.0, 3.0, 1.0, 0.5)], "k double")
    book = Workbook()
    for r, x in enumerate([9.0, 7.0, 7.0, 4.0, 1.0]):
        book.set_value(r, 0, x)
    for r in with_table_formulas(asked, {"p": "MATCH(k,d.x,-1)"}, {"d": Table(down, "i")}, errors=True).collect():
        want = book.eval_formula(f"MATCH({r['k']},A1:A5,-1)")
        assert (r["p_error"] or r["p"]) == (want.code if isinstance(want, Err) else want)


def test_a_lookup_tells_a_blank_from_nothing_found(spark):
    t = spark.createDataFrame([(1.0, None), (2.0, "b")], "k double, v string")
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "k double")
    got = with_table_formulas(df, {"x": "VLOOKUP(k,t,2,FALSE)", "y": "LOOKUP(k,t.k,t.v)", "z": "INDEX(t,k,2)"}, {"t": Table(t, "k")}, errors=True).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(None, None, None, None, None, None), ("b", None, "b", None, "b", None), (None, "#N/A", "b", None, None, "#REF!")]


def test_what_has_no_join_form(tables):
    df, known = tables
    with pytest.raises(Unsupported):
        with_table_formulas(df, {"x": "SUM(o.v,k)"}, known)
    with pytest.raises(ValueError, match="no join form"):
        with_table_formulas(df, {"x": 'COUNTIF(o.s,"<>a*"&s)'}, known)


def test_no_plan_compares_all_with_all(tables):
    df, known = tables
    made = with_table_formulas(df, {"x": 'SUMIFS(o.v,o.k,k,o.i,"<"&k)', "y": "INDEX(o.s,MATCH(k,o.k,0))"}, known)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("NestedLoop") == 0


def test_cuts_by_halving(spark):
    df = spark.range(-3, 60).selectExpr("CAST(id AS DOUBLE) AS x", "id")
    for cuts in ([], [5.0], [1.0, 2.0, 3.5, 40.0], [float(i) for i in range(0, 50, 3)], [i / 2 for i in range(-4, 90)]):
        got = df.select("x", L.range_of(df["x"], cuts).alias("r")).collect()
        assert all(r["r"] == sum(c <= r["x"] for c in cuts) for r in got)


def test_a_sequence_may_have_more_cells_than_one_array(spark):
    made = L.sequence(spark, 400_000, 3, 10.0, 0.5)
    got = made.agg(F.count("*"), F.count_distinct("row", "col"), F.max("row"), F.max("col"), F.sum("value"), F.max(F.abs(F.col("value") - 10 - 0.5 * (F.col("row") * 3 + F.col("col"))))).first()
    assert tuple(got) == (1_200_000, 1_200_000, 399_999, 2, 10 * 1_200_000 + 0.25 * 1_200_000 * 1_199_999, 0.0)


def test_a_spilled_sequence_may_have_more_cells_than_one_array(spark):
    table = Table(spark.range(350_000).withColumnRenamed("id", "_at"), "_at")
    made = spilled(spark.range(1), "SEQUENCE(ROWS(long),3,10,-0.5)", "id", {"long": table})
    got = made.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place"), F.max(F.abs(F.col("value") - 10 + 0.5 * (F.col("place") - 1)))).first()
    assert tuple(got) == (1_050_000, 1_050_000, 1.0, 1_050_000.0, 0.0)
