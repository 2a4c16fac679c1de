"""Lineage and rules over cell tables, and streams of edits, against one workbook after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import rules as R
from gridloom.operators.tiles import blocks, contained, covered, holding
from gridloom.plans import lineage
from gridloom.plans.workbook import Workbook, evaluate_workbooks
from gridloom.sources.csv import CsvError, parse, read_csv
from gridloom.streaming.edits import PROVIDER, changed_cells


def books(seed: int) -> dict[str, dict[tuple[int, int], str]]:
    rng = random.Random(seed)
    ref = lambda: f"{rng.choice(['', '$'])}{rng.choice('ABCDa')}{rng.choice(['', '$'])}{rng.randint(1, 12)}"
    piece = lambda: rng.choice([ref, lambda: f"SUM({ref()}:{ref()})", lambda: '"A1"', lambda: f"Other!{ref()}", lambda: f"'my sheet'!{ref()}:{ref()}", lambda: "LOG10(2)", lambda: f"{ref()} : {ref()}", lambda: "rate"])()
    return {b: {(r, c): rng.choice([str(rng.randint(0, 9)), "=" + "+".join(piece() for _ in range(rng.randint(1, 3)))]) for r in range(12) for c in range(4) if rng.random() < 0.7} for b in ("x", "y", "z")}


def test_closures_are_the_workbooks(spark):
    made = books(4)
    cells = spark.createDataFrame([(b, r, c, t) for b, cs in made.items() for (r, c), t in cs.items()], "book string, row int, col int, input string").repartition(3)
    start = cells.where("row = 1 AND col < 2")
    for upwards in (False, True):
        got = {(r["book"], r["row"], r["col"]): r["step"] for r in lineage.closure(cells, start, upwards).collect()}
        want = {}
        for b, cs in made.items():
            book = Workbook()
            for (r, c), t in cs.items():
                book.set_input(r, c, t)
            step, frontier, seen = 0, {at for at in cs if at[0] == 1 and at[1] < 2}, set()
            while frontier:
                step += 1
                frontier = {p for at in frontier for p in (book.precedents(at) & cs.keys() if upwards else book.dependents(at))} - seen
                seen |= frontier
                want |= {(b, *at): step for at in frontier}
        assert got == want
    direct = {(r["book"], r["row"], r["col"], r["reader_row"], r["reader_col"]) for r in lineage.edges(cells).collect()}
    assert len(direct) == lineage.edges(cells).count() and direct
    assert lineage.dirty(cells, cells.where("row = 0")).count() == len({(b, *at) for b, cs in made.items() for at in marked(cs, [p for p in cs if p[0] == 0])})
    assert lineage.closure(cells, cells.limit(0)).count() == 0


def marked(cells: dict, edited: list) -> set:
    book = Workbook()
    for (r, c), t in cells.items():
        book.set_input(r, c, t)
    book.dirty.clear()
    for at in edited:
        book.mark_dirty(at)
    return book.dirty


def test_cells_in_areas(spark):
    rng = random.Random(1)
    areas = [(i, *sorted((rng.randint(0, 300), rng.randint(0, 300))), *sorted((rng.randint(0, 40), rng.randint(0, 40)))) for i in range(60)] + [(60, 0, 1_048_575, 0, 16_383), (61, 5, 5, 5, 5)]
    df = spark.createDataFrame([(i, a, c, b, d) for i, a, b, c, d in areas], "rule int, r0 int, c0 int, r1 int, c1 int")
    cells = [(rng.randint(0, 300), rng.randint(0, 40)) for _ in range(400)] + [(5, 5)]
    got = contained(spark.createDataFrame(sorted(set(cells)), "row int, col int"), df)
    assert sorted((r["rule"], r["row"], r["col"]) for r in got.collect()) == sorted((i, r, c) for i, a, b, x, y in areas for r, c in set(cells) if a <= r <= b and x <= c <= y)


def test_the_later_rule_wins_and_large_areas_are_left_out(spark):
    cells = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(5) for c in range(3)], "row long, col int, value double")
    rules = [(0, 0, 0, 4, 2, "greaterThan", 20.0, None, "AA0000", None), (1, 1, 1, 3, 1, "scale", None, None, "000000", "FF8000"), (2, 2, 0, 2, 2, "equal", 21.0, None, "00BB00", None), (3, 0, 0, 999, 999, "notEqual", -1.0, None, "FFFFFF", None)]
    df = spark.createDataFrame(rules, "rule int, r0 int, c0 int, r1 int, c1 int, op string, a double, b double, color string, color2 string")
    got = {(r["row"], r["col"]): (r["rule"], r["color"]) for r in R.formatted(cells, df).collect()}
    want = {(r, c): (0, "AA0000") for r in range(5) for c in range(3) if r * 10 + c > 20} | {(1, 1): (1, "000000"), (2, 1): (2, "00BB00"), (3, 1): (1, "FF8000")}
    assert got == want


EDITS = "book string, row int, col int, input string, seq long"


def test_a_stream_of_edits_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"b{rng.randint(0, 3)}", rng.randint(0, 4), rng.randint(0, 2), rng.choice(["1", "2.5", "x", "", "=A1+1", "=SUM(A1:B3)", "=B1&C1", "=A2/0"]), k) for k in range(60)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        (tmp_path / "in").mkdir()
        stream = changed_cells(spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), now=5.0)
        for k in range(2):  # each time a new query on the same checkpoint
            for j in range(2):
                part = rows[30 * k + 15 * j : 30 * k + 15 * (j + 1)]
                spark.createDataFrame(part, EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            sink = lambda df, n, k=k: df.withColumn("n", F.lit(1000 * k + n)).write.mode("append").parquet(str(tmp_path / "out"))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(sink).start()
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    shown = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["n"]):
        shown[r["book"], r["row"], r["col"]] = (r["kind"], r["num"], r["shown"])
    last = {(b, r, c): t for b, r, c, t, _ in rows}
    cells = spark.createDataFrame([(*k, t) for k, t in last.items() if t], "book string, row int, col int, input string")
    want = {(r["book"], r["row"], r["col"]): (r["kind"], r["num"], r["shown"]) for r in evaluate_workbooks(cells, now=5.0).collect()}
    assert {k: v for k, v in shown.items() if v[0] != "blank"} == {k: v for k, v in want.items() if v[0] != "blank"}


def test_an_open_field_at_the_end_of_a_file(spark, tmp_path):
    for k, text in enumerate(('a,b\n4,"un\nclosed', 'a,b\n4,"un\nclosed\n', 'a,"b"\n1,2', "a,b\n1,2")):
        path = tmp_path / f"f{k}.csv"
        path.write_bytes(text.encode())
        rows = read_csv(spark, str(path))[0].orderBy("_row").collect()
        assert [[r["c0"], r["c1"]] for r in rows] == parse(text.encode())[0]


def test_a_folder_of_several_files_is_no_grid(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("1,2\n")
    with pytest.raises(CsvError, match="several_files"):
        read_csv(spark, str(tmp_path))


def test_areas_that_hold_any_cell_and_cells_in_any_area_make_no_pairs(spark):
    rng = random.Random(3)
    span = lambda n: sorted((rng.randint(0, n), rng.randint(0, n)))
    near = lambda: (r := rng.randint(0, 70_000), r + rng.randint(0, 40_000))
    areas = [(i, *(near() if i % 3 else span(300)), *(span(40) if i % 2 else [rng.randint(0, 5)] * 2)) for i in range(150)] + [(150, 0, 1_048_575, 3, 16_383), (151, 5, 5, 5, 5), (152, 0, 80_000, 50, 50)]
    areas = [(b, *a) for a in areas for b in "xyz"[a[0] % 2 :]]
    df = blocks(spark.createDataFrame([(b, i, r0, c0, r1, c1) for b, i, r0, r1, c0, c1 in areas], "book string, rule int, r0 int, c0 int, r1 int, c1 int"))
    levels, last = df.agg(F.collect_set("level"), F.max("r1")).first()
    cells = sorted({(b, rng.choice([rng.randint(0, 300), rng.randint(0, 120_000)]), rng.randint(0, 45)) for b in "xy" for _ in range(60)})
    held = spark.createDataFrame(cells, "book string, row int, col int").repartition(3)
    inside = lambda a, c: a[0] == c[0] and a[2] <= c[1] <= a[3] and a[4] <= c[2] <= a[5]
    for few in (areas, [a for a in areas if a[3] < 301]):
        own = df.where(F.lit(True) if few is areas else F.col("r1") < 301)
        for end in (last, 300) if few is not areas else (last,):
            got = {(r["book"], r["rule"]) for r in holding(own, held, ["book"], levels, end).collect()}
            assert got == {a[:2] for a in few if any(inside(a, c) for c in cells)}
            got = {tuple(r) for r in covered(held, own, ["book"], levels, end).collect()}
            assert got == {c for c in cells if any(inside(a, c) for a in few)}


def test_a_round_takes_as_many_rows_as_there_are_areas(spark):
    n = 2000
    cells = spark.range(n).select(F.lit("x").alias("book"), F.col("id").alias("row"), F.posexplode(F.array(F.lit("1"), F.concat(F.lit("=SUM(A1:A"), F.col("id") + 1, F.lit(")")))).alias("col", "input")).repartition(4)
    areas = blocks(lineage.reads(cells))
    for made, most in ((holding(areas, cells.where("col = 0").select(*lineage.CELL), ["book"], [0], n), n), (covered(cells.select(*lineage.CELL), areas, ["book"], [0], n), n)):
        assert made.count() == most
        plan, counts = [made._jdf.queryExecution().executedPlan()], []
        made.collect()
        while plan:
            p = plan.pop()
            if p.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",):
                plan.append(p.executedPlan())
                continue
            if p.getClass().getSimpleName().endswith("QueryStageExec"):
                plan.append(p.plan())
                continue
            if (m := p.metrics().get("numOutputRows")).isDefined():
                counts.append(m.get().value())
            plan += [p.children().apply(i) for i in range(p.children().size())]
        assert counts and max(counts) <= 3 * n
    got = lineage.closure(cells, cells.where("row = 0 AND col = 0"))
    assert got.count() == n


@pytest.mark.parametrize("upwards", [False, True])
def test_a_closure_sends_no_table_to_the_driver(spark, monkeypatch, upwards):
    plans, stored = [], lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    texts = F.array(F.lit("1"), F.concat(F.lit("=A"), F.col("id") + 1, F.lit("+SUM(B$2:B3)")), F.lit("=B2"))
    cells = stored(spark.range(40).select(F.lit("x").alias("book"), F.col("id").alias("row"), F.posexplode(texts).alias("col", "input")))
    lineage.closure(cells, cells.where("row = 2 AND col = 2" if upwards else "row = 1 AND col = 0"), upwards)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_references_are_told_from_functions_texts_and_other_sheets(spark):
    texts = ["=LOG10(A1)+zz10", '="B2:C3"&$C$3 : a$7&"x""A9"', "=Other!A1+'my A2'!B2:B3-XFD1048576", "=SUM(B$2:B2,B2)*25+rate_1A", "A1", "=A1B+1.5%(D4)"]
    cells = spark.createDataFrame([("x", k, 0, t) for k, t in enumerate(texts)], "book string, row int, col int, input string")
    got = sorted((r["reader_row"], r["r0"], r["c0"], r["r1"], r["c1"]) for r in lineage.reads(cells).collect())
    assert got == sorted([(0, 0, 0, 0, 0), (0, 9, 701, 9, 701), (1, 2, 0, 6, 2), (2, 1048575, 16383, 1048575, 16383), (3, 1, 1, 1, 1), (3, 1, 1, 1, 1), (5, 3, 3, 3, 3)])
