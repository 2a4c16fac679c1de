"""Format codes as columns, medians by selection, functions of a user's own."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.functions.numfmt import format_with
from gridloom.operators import lookup as L
from gridloom.plans import registry
from gridloom.plans.compiler import Unsupported, aggregate_formulas, with_formulas
from gridloom.plans.relational import spilled, with_table_formulas

NUMBERS = [0.0, 1.0, -1.0, 0.5, 2.5, -2.5, 1234567.891, -0.004, 59.0, 60.0, 60.75, 61.25, 43890.999999, 45000.5208333, 0.333333333333, 0.142857, 3.1415926535, -7.875, 99.99, 1e-9, 0.99999, 1234.0, -45.0, 12.3456]
NUMBERS += [random.Random(7).uniform(-50, 50) for _ in range(150)] + [p / q for q in (3, 7, 11, 97, 101, 997, 9973) for p in (1, 2, q - 1)] + [1 / 3 + 1e-7, 0.5 - 1e-10]
CODES = [
    "yyyy-mm-dd", "d mmm yy hh:mm:ss", "dddd m/d/yyyy h:m", "mmmm \"of\" yyyy", "mm:ss", "# ?/?", "# ??/??", "?/?", "# ????/????", "# ?/8", "??/16", "???/???", "0.00;(0.00)", "0;-0;\"zero\"", "#,##0.0;[Red]-#,##0.0;\"none\"", "[>=100]#,##0;[<0]\"neg \"0.0;0.00",
    "[<1]0.000;0", "[=0]\"nil\";General", "General", "", "00,000.0", "0,000", "$#,##0.00", "0%", "\"text\"", "[>50]yyyy;# ?/?", "0.00 \"kg\";-0.00 \"kg\"", "000",
]


def test_codes_agree_with_the_library_without_python(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double").repartition(2)
    wrong = []
    for k in range(0, len(CODES), 7):
        some = CODES[k : k + 7]
        made = with_formulas(df, {f"t{i}": 'TEXT(x,"' + c.replace('"', '""') + '")' for i, c in enumerate(some)})
        assert "Python" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
        wrong += [(r["x"], c, r[f"t{i}"], format_with(r["x"], c)[0]) for r in made.collect() for i, c in enumerate(some) if r[f"t{i}"] != format_with(r["x"], c)[0]]
    assert wrong == []


def test_scientific_codes_are_the_librarys(spark):
    df = spark.createDataFrame([(12345.678,)], "x double")
    assert with_formulas(df, {"t": 'TEXT(x,"0.00E+00")'}).first()["t"] == format_with(12345.678, "0.00E+00")[0]


def test_medians_are_exact(spark):
    rng = random.Random(2)
    groups = {None: [1.0], "a": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(1000)], "b": [rng.gauss(0, 1) for _ in range(20_001)], "c": [4.0, 1.0], "d": [None], "e": [float(i) for i in range(20_000)], "f": [3.0, None, 1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    want = {g: statistics.median(known) if (known := [v for v in vs if v is not None]) else None for g, vs in groups.items()}
    for accuracy in (100, 10_000):
        assert {r["g"]: r["median"] for r in L.median(df, "v", ["g"], accuracy=accuracy).collect()} == want
    got = {r["g"]: (r["m"], r["m_error"], r["s"]) for r in aggregate_formulas(df, {"m": "MEDIAN(v)*2", "s": "COUNT(v)-MEDIAN(v,v)"}, ["g"], errors=True).collect()}
    assert got == {g: (None if m is None else m * 2, "#NUM!" if m is None else None, None if m is None else sum(v is not None for v in groups[g]) - m) for g, m in want.items()}
    every = statistics.median(v for vs in groups.values() for v in vs if v is not None)
    assert aggregate_formulas(df, {"m": "MEDIAN(v)"}).first()["m"] == every
    assert with_table_formulas(df.where("g = 'c'"), {"x": "v-MEDIAN(v)"}).agg(F.sum("x")).first()[0] == 0
    assert aggregate_formulas(df.limit(0), {"m": "MEDIAN(v)"}, errors=True).first()["m_error"] == "#NUM!"
    with pytest.raises(Unsupported):
        aggregate_formulas(df, {"m": "MEDIAN(v,3)"})


def test_a_users_own_functions(spark):
    df = spark.createDataFrame([(1, 2.0, "ab"), (2, -3.0, None), (3, 4.0, "xyz")], "i int, x double, s string")
    registry.function("cube", "nn", "number", 1.0)(lambda x, k: x * x * x * k)
    registry.arrow_function("reversed", "t", "text")(lambda s: s.str[::-1])
    registry.aggregate_function("rangeof")(lambda x: F.max(x) - F.min(x))
    registry.table_function("everyother")(lambda rows, start: rows.where(F.col("__o") % 2 == int(start)))
    try:
        made = with_table_formulas(df, {"a": "CUBE(x)+cube(x,2)", "b": 'REVERSED(s)&"!"', "c": "x/RANGEOF(x)", "d": "CUBE()"}, ordinal="i", errors=True).orderBy("i").collect()
        assert [r["a"] for r in made] == [24.0, -81.0, 192.0] and [r["b"] for r in made] == ["ba!", "!", "zyx!"]
        assert [r["c"] for r in made] == [2 / 7, -3 / 7, 4 / 7] and made[0]["d_error"] == "#VALUE!"
        assert aggregate_formulas(df, {"r": "RANGEOF(x)*2"}).first()["r"] == 14.0
        assert sorted(r["value"] for r in spilled(df, "SORT(EVERYOTHER(x,1))", "i").collect()) == [2.0, 4.0]
        assert {(e.name, e.form) for e in registry.entries() if e.own} == {("CUBE", "row"), ("REVERSED", "row"), ("RANGEOF", "aggregate"), ("EVERYOTHER", "array")}
        with pytest.raises(ValueError, match="of the language"):
            registry.function("SUM", "n", "number")(lambda x: x)
    finally:
        for name in ("cube", "reversed", "rangeof", "everyother"):
            registry.remove(name)
    assert not registry.is_known("CUBE") and registry.is_known("vlookup") and len(registry.entries()) >= 161
    assert with_formulas(df, {"a": "CUBE(x)"}, errors=True).first()["a_error"] == "#NAME?"
