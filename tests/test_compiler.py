"""Columns against the row-at-a-time library, value by value."""

from __future__ import annotations

import math
import time

import pytest

from gridloom.functions.cells import Err, general
from gridloom.plans.compiler import aggregate_formulas, with_formulas
from gridloom.plans.workbook import Workbook

ROWS = [
    (1, 2.5, 3.0, "hello world", "l", True),
    (2, -7.25, 2.0, "O'Neil  smith", "L", False),
    (3, 0.0, 0.0, "", "x", None),
    (4, None, 4.0, None, "", True),
    (5, 1234.5678, -3.0, "12.5%", "2", False),
    (6, 43890.75, 1.0, "2020-02-31", "-", True),
    (7, 255.0, 10.0, "FF", "F", None),
    (8, 60.0, 5.0, "1001", "1", False),
    (9, 0.1, 0.2, "北京市", "京", True),
]
FORMULAS = [
    "A+B", "A-B*2", "A/B", "A^B", "-A^2", "A%", "A&B", "S&A", "A>B", "A=B", "S=T", "S<T", "A<S", "S=A", "L=TRUE", "ABS(A)", "SIGN(A)", "INT(A)", "TRUNC(A,1)", "MOD(A,B)", "MOD(A,3)", "ROUND(A,1)", "ROUND(A*1.005,2)",
    "ROUNDUP(A,1)", "ROUNDDOWN(A,1)", "MROUND(A,2)", "CEILING(A,B)", "FLOOR(A,B)", "POWER(A,B)", "SQRT(A)", "EXP(B)", "LN(A)", "LOG(A)", "LOG(A,2)", "LOG(A,B)", "LOG10(A)", "SIN(A)", "COS(A)", "TAN(B)", "ASIN(B)", "ACOS(B)",
    "ATAN(A)", "ATAN2(A,B)", "DEGREES(B)", "RADIANS(A)", "PI()", "QUOTIENT(A,B)", "EVEN(A)", "ODD(A)", "FACT(B)", "COMBIN(10,B)", "GCD(A,B)", "LCM(A,B)", "ISEVEN(A)", "ISODD(B)", "LOWER(S)", "UPPER(S)", "LEN(S)", "TRIM(S)", "PROPER(S)",
    "EXACT(S,T)", "LEFT(S,3)", "LEFT(S)", "RIGHT(S,3)", "MID(S,2,3)", "MID(S,B,2)", "REPT(T,B)", "REPLACE(S,2,3,\"X\")", "SUBSTITUTE(S,T,\"_\")", "SUBSTITUTE(S,T,\"_\",2)", "FIND(T,S)", "SEARCH(T,S)", "FIND(T,S,3)", "CODE(S)", "CHAR(B+64)",
    "VALUE(S)", "CONCAT(S,A,L)", "TEXTJOIN(\"-\",TRUE,S,T,A)", "TEXTJOIN(\"-\",FALSE,S,T)", "T(S)", "TEXT(A,\"0.00\")", "TEXT(A,\"#,##0.0\")", "TEXT(A,\"0%\")", "TEXT(A,\"yyyy-mm-dd\")", "TEXT(A,\"# ?/?\")", "TEXT(A,\"$#,##0.00\")",
    "IF(A>B,S,T)", "IF(A>B,A)", "IF(S,1,2)", "IFS(A>100,\"big\",A>0,\"small\")", "IFERROR(A/B,0)", "IFERROR(A/B,\"bad\")", "IFNA(NA(),A)", "SWITCH(B,2,\"two\",3,\"three\",\"other\")", "SWITCH(T,\"l\",1,\"x\",2)", "CHOOSE(B,A,B,A+B)",
    "AND(A>0,B>0)", "OR(A>0,B>3)", "XOR(A>0,B>3)", "NOT(L)", "NOT(S)", "ISBLANK(A)", "ISBLANK(S)", "ISNUMBER(A)", "ISTEXT(S)", "ISNONTEXT(S)", "ISLOGICAL(L)", "ISERROR(A/B)", "ISERR(A/B)", "ISNA(A/B)", "N(A)", "N(S)", "N(L)", "TYPE(S)", "TYPE(A)",
    "TYPE(A/B)", "ERROR.TYPE(A/B)", "YEAR(A)", "MONTH(A)", "DAY(A)", "HOUR(A)", "MINUTE(A)", "SECOND(A)", "WEEKDAY(A)", "WEEKDAY(A,2)", "WEEKDAY(A,3)", "EDATE(A,B)", "EOMONTH(A,B)", "DATE(2020,B,31)", "DATE(B,1,1)", "TIME(B,30,0)", "DAYS(A,B)", "DATEVALUE(S)",
    "FV(0.05,B,-100)", "PV(0.05,B,-100,A)", "PMT(0.05,B,1000)", "PMT(0,B,1000)", "NPER(0.05,-200,B*100)", "DEC2BIN(B)", "DEC2HEX(B,4)", "DEC2OCT(A)", "BIN2DEC(S)", "HEX2DEC(S)", "OCT2DEC(S)", "BITAND(B,6)", "BITOR(B,6)", "BITXOR(B,6)", "BITLSHIFT(B,2)", "BITRSHIFT(A,1)",
    "S*2", "NOSUCH(A)", "UNKNOWN+1", "\"3\"+B", "TODAY()", "NOW()", "1/0", "S>=\"h\"", "LOG(B,1)", "1+#N/A",
]
NAMES = ("A", "B", "S", "T", "L")


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "k int, a double, b double, s string, t string, l boolean").repartition(1)


def expected(formula: str, row) -> object:
    book = Workbook(43831.75)
    for i, v in enumerate(row[1:]):
        book.set_value(0, i, v)
    for i, name in enumerate(NAMES):
        book.define(name, f"{'ABCDE'[i]}1")
    return book.eval_formula(formula)


def test_columns_agree_with_the_library(frame):
    made = with_formulas(frame, {f"f{i}": f for i, f in enumerate(FORMULAS)}, errors=True, now=43831.75).orderBy("k").collect()
    wrong = []
    for row, source in zip(made, ROWS, strict=True):
        for i, f in enumerate(FORMULAS):
            want, got, err = expected(f, source), row[f"f{i}"], row[f"f{i}_error"]
            if isinstance(want, Err):
                ok = err == want.code and got is None
            elif isinstance(want, float):
                ok = err is None and (float(got) if isinstance(got, (int, float)) and not isinstance(got, bool) else None) is not None and math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-12) or isinstance(got, str) and got == general(want)
            elif want is None:
                ok = err is None and got in (None, 0.0, "")
            else:
                ok = err is None and (got == want or isinstance(got, str) and isinstance(want, bool) and got == str(want).upper())
            if not ok:
                wrong.append((f, source, want, got, err))
    assert not wrong, wrong


def test_aggregates_agree_with_the_library(frame):
    formulas = [
        "SUM(A)", "PRODUCT(B)", "SUMSQ(A)", "AVERAGE(A)", "AVERAGEA(B)", "MAX(A)", "MIN(A)", "MEDIAN(A)", "STDEV(A)", "STDEVP(A)", "VAR(B)", "VARP(B)", "COUNT(A)", "COUNTA(S)", "COUNTBLANK(S)", "COUNTIF(A,\">1\")", "COUNTIF(A,0)", "COUNTIF(A,\"<5\")",
        "COUNTIF(S,\"*o*\")", "COUNTIF(S,\"<>x\")", "COUNTIF(T,\"L\")", "COUNTIF(S,\">=h\")", "SUMIF(T,\"l\",A)", "SUMIF(A,\">1\")", "SUMIFS(A,B,\">1\",T,\"?\")", "AVERAGEIF(A,\">0\")", "AVERAGEIFS(A,B,\">1\")", "AVERAGEIF(A,\">1e9\")", "MAXIFS(A,B,\">0\")", "MINIFS(A,B,\">0\")",
        "COUNTIFS(A,\">0\",B,\">0\")", "SUMPRODUCT(A,B)", "SUMPRODUCT(A,L)", "SUBTOTAL(9,A)", "SUBTOTAL(1,A)", "SUBTOTAL(104,A)", "SUBTOTAL(3,S)", "SUBTOTAL(6,B)", "SUM(S)", "MAX(S)", "AVERAGE(S)", "SUM(A)/COUNT(A)", "IF(SUM(A)>0,MAX(A),0)",
    ]
    got = aggregate_formulas(frame, {f"f{i}": f for i, f in enumerate(formulas)}, errors=True).first()
    book = Workbook()
    for r, row in enumerate(ROWS):
        for c, v in enumerate(row[1:]):
            book.set_value(r, c, v)
    for f_i, f in enumerate(formulas):
        where = f
        for i, name in enumerate(NAMES):
            book.define(name, f"{'ABCDE'[i]}1:{'ABCDE'[i]}{len(ROWS)}")
        want = book.eval_formula(where)
        v, err = got[f"f{f_i}"], got[f"f{f_i}_error"]
        if isinstance(want, Err):
            assert err == want.code, (f, want, v, err)
        else:
            assert err is None and math.isclose(v, want, rel_tol=1e-12), (f, want, v, err)


def test_an_error_in_a_column_is_the_aggregates_result(frame):
    got = aggregate_formulas(frame, {"x": "SUM(A/B)", "n": "COUNT(A/B)", "s": "SUBTOTAL(9,A/B)", "i": "IFERROR(SUM(A/B),-1)"}, errors=True).first()
    assert (got["x"], got["x_error"], got["n"], got["i"]) == (None, "#DIV/0!", 8.0, -1.0)
    assert got["s_error"] is None


def test_plans_grow_in_proportion_to_the_formula(frame):
    """Long chains, nested quotients and nested choices compile at once."""
    chain = "+".join("A*B" for _ in range(30))
    quotients = "A/(1+" * 6 + "B" + ")" * 6
    choices = "".join(f"IF(B>{k},A+{k}," for k in range(20)) + "0" + ")" * 20
    with_formulas(frame, {"c": chain})
    began = time.perf_counter()
    df = with_formulas(frame, {"c": chain, "q": quotients, "i": choices}, errors=True)
    sizes = len(df._jdf.queryExecution().analyzed().toString())
    assert time.perf_counter() - began < 2 and sizes < 400_000
    for row, source in zip(df.orderBy("k").collect(), ROWS, strict=True):
        for name, f in (("c", chain), ("q", quotients), ("i", choices)):
            want = expected(f, source)
            assert row[f"{name}_error"] == want.code if isinstance(want, Err) else math.isclose(row[name], want, rel_tol=1e-9), (name, source)


def test_infinite_values_are_errors_wherever_they_arise(frame):
    formulas = {"a": "1E300*1E300", "b": "1/(1E300*1E300)", "c": "1E300*1E300-1E300*1E300", "d": "IFERROR(A*1E300*1E300,-1)", "e": "ISERROR(EXP(1000)-EXP(1000))", "f": "LEFT(S,1E300*1E300)", "g": "ABS(-1E300*1E300)&S"}
    row = with_formulas(frame, formulas, errors=True).orderBy("k").first()
    assert [row[f"{k}_error"] for k in "abcfg"] == ["#NUM!"] * 5 and row["d"] == -1 and row["e"] is True
