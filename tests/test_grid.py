"""Grid operators and lookups on small tables, against plain Python over the same rows."""

from __future__ import annotations

import random

import pytest

from gridloom.operators import grid as G
from gridloom.operators import lookup as L

#: A harbour's log: boat, crew, tonnes; some cells are blank, one is no number.
LOG = [("boat", "crew", "tonnes"), *[(f"{n} {k}" if k % 4 else "", f"{c}", t) for k, (n, c, t) in enumerate(zip(["Möwe", "heron", "Heron", "GULL", "海鸥"] * 4, [3, 12, 7, 7, 25] * 4, ["10", "9.5", "", "-2", "1e2", "25%", "n/a", " 4 "] * 2 + ["10"] * 4, strict=True))]]


@pytest.fixture(scope="module")
def log(spark):
    return G.Grid(spark.createDataFrame([(i, *r) for i, r in enumerate(LOG)], f"{G.ROW} long, c0 string, c1 string, c2 string").repartition(3), header_rows=1)


def labels(df):
    return [r[G.ROW] for r in df.collect()]


def as_number(cell: str) -> float | None:
    t = cell.strip()
    try:
        return float(t[:-1]) / 100 if t.endswith("%") else float(t)
    except ValueError:
        return None


def kept(test) -> list[int]:
    return [0, *(i for i, r in enumerate(LOG) if i and test(r))]


@pytest.mark.parametrize(
    ("spec", "test"),
    [
        ({"column": "c0", "kind": "values", "values": ["HERON 1", "gull 3"]}, lambda r: r[0].lower() in ("heron 1", "gull 3")), ({"column": "c0", "kind": "text", "op": "contains", "value": "ERON"}, lambda r: "eron" in r[0].lower()), ({"column": "c0", "kind": "text", "op": "not_contains", "value": "海"}, lambda r: "海" not in r[0]),
        ({"column": "c0", "kind": "text", "op": "begins", "value": "mö"}, lambda r: r[0].lower().startswith("mö")), ({"column": "c2", "kind": "blank", "blank": True}, lambda r: not r[2].strip()), ({"column": "c0", "kind": "blank", "blank": False}, lambda r: bool(r[0].strip())),
        *[({"column": "c2", "kind": "number", "op": op, "value": 4}, lambda r, f=f: (n := as_number(r[2])) is not None and f(n, 4)) for op, f in {"gt": float.__gt__, "ge": float.__ge__, "lt": float.__lt__, "le": float.__le__, "eq": float.__eq__}.items()],
        ({"column": "c1", "kind": "number", "op": "between", "value": 12, "value2": 5}, lambda r: 5 <= float(r[1]) <= 12),
    ],
)
def test_filters_keep_the_header_and_the_original_numbers(log, spec, test):
    if spec.get("op") in ("gt", "ge", "lt", "le", "eq"):
        spec = spec | {"value": 4.0}
    assert labels(log.filter(spec).view()) == kept(test)


def test_filters_add_up_and_clear(log):
    both = [{"column": "c1", "kind": "number", "op": "gt", "value": 5}, {"column": "c0", "kind": "text", "op": "ends", "value": "3"}]
    assert labels(log.filter(*both).view()) == kept(lambda r: float(r[1]) > 5 and r[0].endswith("3"))
    assert labels(log.filter(*both).clear_filter().view()) == list(range(len(LOG)))
    with pytest.raises(ValueError):
        log.filter({"column": "c0", "kind": "nosuch"}).view()


@pytest.mark.parametrize("way", ["asc", "desc", "none"])
def test_sort_puts_blanks_last_both_ways_and_keeps_order_otherwise(log, way):
    body = list(range(1, len(LOG)))
    if way != "none":
        # A percentage is text to the sort.
        value = {i: None if "%" in LOG[i][2] else as_number(LOG[i][2]) for i in body}
        blank = [i for i in body if not LOG[i][2].strip()]
        text = sorted((i for i in body if i not in blank and value[i] is None), key=lambda i: LOG[i][2].lower(), reverse=way == "desc")
        text = text if way == "asc" else sorted(text, key=lambda i: [-ord(c) for c in LOG[i][2].lower()])
        numbers = sorted((i for i in body if value[i] is not None), key=lambda i: value[i] * (1 if way == "asc" else -1))
        body = (numbers + text if way == "asc" else text + numbers) + blank
    assert labels(log.sort("c2", way).view()) == [0, *body]


def test_windows_gather_find_and_distinct(log):
    assert sorted(labels(log.window(2, 5))) == [2, 3, 4]
    assert [tuple(r) for r in log.window(3, 4, 1).collect()] == [(3, *LOG[3][1:])]
    assert [r["c0"] for r in log.gather([7, 2, 7]).collect()] == [LOG[7][0], LOG[2][0], LOG[7][0]]
    assert [tuple(r)[:2] for r in log.find("HERON", 50).collect()] == [(i, 0) for i, r in enumerate(LOG) if "heron" in r[0].lower()]
    assert log.find("", 10).collect() == []
    values, _ = log.distinct("c1", 3)
    assert [(r["value"], r["truncated"]) for r in values.collect()] == [("3", True), ("12", True), ("7", True)]
    assert [r["line"] for r in log.tsv(1, 3).orderBy(G.ROW).collect()] == ["\t".join(r) for r in LOG[1:3]]
    assert tuple(log.extent().first()) == (len(LOG), 3)
    # Chinese characters and full-width forms take two places, others one.
    assert log.widths().first().asDict() == {"c0": max(sum(2 if ch in "海鸥" else 1 for ch in r[0]) for r in LOG), "c1": 4, "c2": 6}


def test_hits_in_texts(spark):
    rows = [(1, "oar, Oar and oaroar"), (2, "none"), (3, None), (4, ""), (5, "a\\Eb \\E"), (6, "İoar")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = sorted((r["id"], r["n"], r["hit"], r["start"]) for r in G.find_in_texts(df, "id", "t", "OAR").collect())
    assert got[:4] == [(1, 4, 1, 0), (1, 4, 2, 5), (1, 4, 3, 13), (1, 4, 4, 16)] and got[4][:3] == (6, 1, 1)
    assert [(r["hit"], r["start"]) for r in G.find_in_texts(df, "id", "t", "\\E", case=True).orderBy("hit").collect()] == [(1, 1), (2, 5)]
    assert G.find_in_texts(df, "id", "t", "").count() == 0


def test_as_of_lookup_carries_over_ranges(spark):
    rng = random.Random(4)
    steps = [(float(rng.randrange(300)), f"v{k}", k) for k in range(120)]
    probes = [(k, rng.choice([None, -5.0, 1e6, rng.uniform(0, 300), float(rng.randrange(300)), 77.0])) for k in range(200)]
    got = {r["id"]: r["found"] for r in L.lookup_sorted(spark.createDataFrame(probes, "id int, x double"), "x", spark.createDataFrame(steps, "k double, v string, o int"), "k", "v", "found", "o").collect()}
    for k, x in probes:
        below = [s for s in steps if x is not None and s[0] <= x]
        assert got[k] == (max(below, key=lambda s: (s[0], s[2]))[1] if below else None)


def test_ranks_places_and_running_totals_over_ranges(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, float(rng.randrange(20)), rng.random()]), rng.choice("ab")) for k in range(150)]
    df = spark.createDataFrame(rows, "o int, x double, g string").repartition(3)
    for up in (False, True):
        want = {k: None if x is None else 1.0 + sum(y is not None and (y < x if up else y > x) for _, y, _ in rows) for k, x, _ in rows}
        assert {r["o"]: r["rank"] for r in L.rank(df, "x", up).collect()} == want
        order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1] if up else -r[1], r[0]))
        placed = {r["o"]: r["__place"] for r in L.sorted_places(df, "x", "o", not up).collect()}
        assert [placed[r[0]] for r in order] == sorted(placed[r[0]] for r in order) and all(placed[k] > placed[order[-1][0]] for k, x, _ in rows if x is None)
    assert {r["o"]: r["n"] for r in L.numbered(df, "o", "n").collect()} == {k: k + 1.0 for k, *_ in rows}
    for by in ([], ["g"]):
        got = {r["o"]: r["running"] for r in L.running_total(df, "x", "o", by).collect()}
        for k, _, g in rows:
            assert (got[k] or 0) == pytest.approx(sum(y for j, y, h in rows if j <= k and y is not None and (not by or h == g)))
    assert [r["value"] for r in L.large(df, "x", 3).collect()] == sorted((x for _, x, _ in rows if x is not None), reverse=True)[2:3]
    assert L.large(df, "x", 999).collect() == []


def test_divisors_of_a_column(spark):
    df = spark.createDataFrame([("a", 84.0), ("a", -126.0), ("a", None), ("b", 7.0), ("c", 0.0)], "g string, x double")
    assert {r["g"]: r["gcd"] for r in L.gcd(df, "x", ["g"]).collect()} == {"a": 42.0, "b": 7.0, "c": 0.0}


def test_color_scale_of_a_flat_region_takes_the_middle(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    assert {r["color"] for r in G.color_scale(df, "x", ["000000", "FFFFFF"]).collect()} == {"808080"}
