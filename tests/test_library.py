"""Formulas, formats, dates and workbooks by example."""

from __future__ import annotations

import pytest

from gridloom.functions.cells import DIV0, NA, NAME, NUM, REF, VALUE, general, top_left
from gridloom.functions.library import FUNCTIONS
from gridloom.functions.numfmt import format_with
from gridloom.functions.serial import from_serial, to_serial
from gridloom.plans.workbook import Workbook, evaluate_grid, evaluate_workbooks


def test_the_whole_inventory_is_there():
    assert len(FUNCTIONS) == 161


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("1+2*3", 7.0), ("2^3^2", 512.0), ("-2^2", 4.0), ("2*3%", 0.06), ('"3"+2', 5.0), ("TRUE+1", 2.0), ('""&5', "5"), ('1+"abc"', VALUE), ("1/0", DIV0), ("(-1)^0.5", NUM), ('#N/A&"x"', NA), ('"abc"="ABC"', True), ("FOO()", NAME), ("IF(1,,2)", NAME),
        ("ROUND(2.345,2)", 2.35), ("ROUND(-2.5,0)", -3.0), ("MOD(-7,3)", 2.0), ("MOD(7,-3)", -2.0), ("MROUND(10,3)", 9.0), ("LOG(1000)", 3.0), ("EVEN(3)", 4.0), ("ODD(2)", 3.0), ("ODD(0)", 1.0), ("COMBIN(5,2)", 10.0), ("FACT(171)", NUM), ("SUM(1,TRUE,\"3\")", 5.0),
        ("PROPER(\"o'neil SMITH\")", "O'Neil Smith"), ('SUBSTITUTE("a-b-c","-","+",2)', "a-b+c"), ('FIND("l","hello",4)', 4.0), ('SEARCH("*","a*b")', 2.0), ('TEXT(1234.5,"#,##0.00")', "1,234.50"), ('VALUE("5%")', VALUE), ("CHAR(0)", VALUE), ('LEN("北京")', 2.0),
        ("DATE(1900,2,29)", 60.0), ("DATE(2020,13,1)", 44197.0), ("EDATE(DATE(2020,1,31),1)", 43890.0), ("WEEKDAY(DATE(2020,1,1),2)", 3.0), ("HOUR(0.999999)", 0.0), ('DATEVALUE("2021-02-31")', 44258.0), ("YEAR(-1)", NUM), ("DAY(60)", 29.0),
        ("DEC2BIN(-1)", "1111111111"), ('BIN2DEC("1111111111")', -1.0), ('HEX2DEC("FFFFFFFFFF")', float(0xFFFFFFFFFF)), ("BITAND(-1,3)", NUM), ("PMT(0,10,1000)", -100.0), ("NPV(-1,1)", DIV0), ("IF(FALSE,10)", False), ("SWITCH(9,1,\"a\",\"d\")", "d"),
        ("XOR(TRUE,TRUE,TRUE)", True), ("ERROR.TYPE(1/0)", 2.0), ("TYPE(1/0)", 16.0), ("ISREF(A1)", True), ("COUNTA(UNIQUE(SEQUENCE(5)))", 5.0), ("SEQUENCE(100000,100000)", NUM), ("SUM(A1:XFD1048576)", NUM), ("A:A", REF), ("SUM(A1:2)", REF),
    ],
)
def test_formulas(formula, want):
    got = top_left(Workbook().eval_formula(formula))
    assert got == pytest.approx(want) if isinstance(want, float) else got == want and type(got) is type(want)


def test_deep_nesting_is_a_number_error():
    assert Workbook().eval_formula("(" * 50_000 + "1" + ")" * 50_000) == NUM


@pytest.mark.parametrize(
    ("value", "code", "want"),
    [
        (2.71828, "0.000", "2.718"), (6.5, "0", "6"), (7.5, "0", "8"), (19.0, "00000", "00019"), (9876543.21, "#,##0.0", "9,876,543.2"), (0.0725, "0.0%", "7.2%"), (36.6, '0.0" degC"', "36.6 degC"), (-88.0, "0;0-", "88-"), (0.0, '0;-0;"calm"', "calm"),
        (45000.0, "d mmm yyyy", "15 Mar 2023"), (45000.75, "hh:mm", "18:00"), (0.25, "?/4", "1/4"), (3.75, "# ?/?", "3 3/4"), (0.3, "??/??", "3/10"), (0.2 + 0.4, "General", "0.6"), (-12.0, "[Green]0;[Magenta]-0", "-12"),
        (17.0, '[<20]0" low";0" high"', "17 low"), (21.0, '[<20]0" low";0" high"', "21 high"), (4.5, "[$£-809]0.00", "£4.50"), (8.0, "0.###", "8"),
    ],
)
def test_number_formats(value, code, want):
    assert format_with(value, code)[0] == want


def test_colours_come_with_the_section():
    assert format_with(-31.0, "0;[Cyan]0") == ("31", "Cyan") and format_with(31.0, "0;[Cyan]0") == ("31", None)


def test_general_text_and_serial_dates():
    assert [general(x) for x in (1 / 3, 1e20, 1e-7, -0.0, 1234567.0)] == ["0.333333333333333", "100000000000000000000", "0.0000001", "0", "1234567"]
    for serial in (0, 1, 59, 60, 61, 43831, 2958465):
        assert to_serial(*from_serial(serial)) == serial


def test_criteria_on_blanks_and_errors():
    book = Workbook()
    for i, v in enumerate([1.0, None, "x", DIV0, 7.0]):
        book.set_value(i, 0, v)
    assert book.eval_formula("COUNTIF(A1:A5,0)") == 1.0
    assert book.eval_formula('COUNTIF(A1:A5,"<5")') == 2.0
    assert book.eval_formula('COUNTIF(A1:A5,"<>x")') == 4.0
    assert book.eval_formula('SUMIF(A1:A5,">0")') == 8.0
    assert book.eval_formula("SUM(A1:A5)") == DIV0


def test_lookups_on_unsorted_and_mixed_input():
    book = Workbook()
    for i, (k, v) in enumerate([(1.0, "one"), (9.0, "nine"), (2.0, "two"), (None, "blank")]):
        book.set_value(i, 0, k)
        book.set_value(i, 1, v)
    assert book.eval_formula("VLOOKUP(2,A1:B4,2,TRUE)") == "one"
    assert book.eval_formula("VLOOKUP(0,A1:B4,2,FALSE)") == "blank"
    assert book.eval_formula("VLOOKUP(5,A1:B4,3,FALSE)") == REF
    assert book.eval_formula('XLOOKUP("2",A1:A4,B1:B4)') == "two"
    assert book.eval_formula("MATCH(9,A1:A4,0)") == 2.0
    assert book.eval_formula("HLOOKUP(1,A1:B1,1,FALSE)") == 1.0
    assert book.eval_formula("SUM(FILTER(A1:A3,A1:A3>1))") == 11.0


def test_recalculation_is_incremental_and_ordered():
    book = Workbook()
    for where, text in {"A1": "1", "A2": "2", "A3": "=A1+A2", "A4": "=A3*2", "B1": "=SUM(A1:A2)", "C1": "=B2"}.items():
        book.set(where, text)
    book.recalculate()
    book.set("A1", "10")
    assert book.dirty == {(2, 0), (3, 0), (0, 1)}
    assert book.recalculate() == [(0, 1), (2, 0), (3, 0)]
    assert (book.computed("A4"), book.computed("B1")) == (24.0, 12.0)
    assert book.precedents((3, 0)) == {(2, 0)} and book.dependents((0, 0)) == {(2, 0), (0, 1)}


def test_cycles_fail_or_converge():
    book = Workbook()
    for where, text in {"A1": "=B1", "B1": "=A1/2+3", "C1": "=IFERROR(A1,0)"}.items():
        book.set(where, text)
    book.recalculate()
    assert {book.computed(c) for c in ("A1", "B1", "C1")} == {REF}
    for method in ("gauss-seidel", "jacobi"):
        book.mark_dirty((0, 0))
        book.recalculate(iterate=True, method=method)
        assert book.computed("A1") == pytest.approx(6, abs=0.01)


def test_side_sheets_names_and_wide_ranges():
    book = Workbook()
    book.add_sheet("My Sheet", {(0, 0): 7.0})
    book.set("A1", "2")
    book.set("CM1", "3")
    book.define("Rate", "A1")
    assert book.eval_formula("'My Sheet'!A1*Rate") == 14.0
    assert book.eval_formula("Nowhere!A1") == REF
    book.set("A2", "=SUM(A1:CZ1)")
    book.recalculate()
    book.set("CM1", "5")
    book.recalculate()
    assert book.computed("A2") == 7.0


def test_grids_show_results_and_errors():
    shown, formulas = evaluate_grid([["1", "2", "=A1+B1"], ["x", "=A1*10", "=1/0"]])
    assert shown == [["1", "2", "3"], ["x", "10", "#DIV/0!"]] and [w for w, _ in formulas] == ["C1", "B2", "C2"]
    assert evaluate_grid([["1"]]) is None


def test_many_workbooks(spark):
    cells = [(f"b{i}", 0, 0, str(i)) for i in range(5)] + [(f"b{i}", 1, 0, "=A1/2") for i in range(5)] + [("b0", 2, 0, "=1/A1")]
    got = {(r["book"], r["row"]): (r["kind"], r["shown"]) for r in evaluate_workbooks(spark.createDataFrame(cells, "book string, row int, col int, input string")).collect()}
    assert got["b3", 1] == ("number", "1.5") and got["b0", 2] == ("error", "#DIV/0!")
