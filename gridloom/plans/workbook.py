"""Workbooks: cells, formulas, dependencies, recalculation.

The cell tier: for irregular formulas, whose dependencies are a graph rather than a
query plan. One workbook is evaluated in memory; many are evaluated in parallel by
:func:`evaluate_workbooks`, one per task group.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gridloom.functions.cells import DIV0, NAME, NUM, REF, Arr, Err, compare, display, finite, literal, to_bool, to_number, to_text, top_left
from gridloom.functions.library import FUNCTIONS, MAX_ELEMENTS, power
from gridloom.plans.language import MAX_COL, Area, Binary, Call, Cell, Const, FormulaError, Name, Unary, a1, area, parse, parse_a1, walk

MAX_EVAL_DEPTH = 256
#: Areas over more columns are indexed apart.
WIDE = 64


class Evaluator:
    """Evaluates trees; ``values`` holds finished cells, others are computed when they are asked for."""

    def __init__(self, book: Workbook, values: dict | None = None):
        self.book, self.values, self.now = book, {} if values is None else values, book.now
        self.open: set[tuple[int, int]] = set()
        self.at: tuple[int, int] | None = None
        self.depth = 0

    def cell(self, at: tuple[int, int]):
        if at in self.values:
            return self.values[at]
        content = self.book.cells.get(at)
        if not isinstance(content, Formula):
            return content
        if at in self.open:
            return REF
        self.open.add(at)
        before, self.at = self.at, at
        v = top_left(self.value(content.tree)) if not isinstance(content.tree, Err) else content.tree
        self.at = before
        self.open.discard(at)
        self.values[at] = v
        return v

    def value(self, node):
        if self.depth >= MAX_EVAL_DEPTH:
            return NUM
        self.depth += 1
        try:
            return self._value(node)
        finally:
            self.depth -= 1

    def _value(self, node):
        if isinstance(node, Const):
            return node.value
        if isinstance(node, Name):
            where = self.book.names.get(node.text)
            if where is None:
                return NAME
            return self.cell((where.row0, where.col0)) if where.height == where.width == 1 else self.rectangle(where)
        if isinstance(node, (Cell, Area)):
            if node.sheet is not None:
                sheet = self.book.sheets.get(node.sheet)
                if sheet is None:
                    return REF
                get = sheet.get
            else:
                get = self.cell
            if isinstance(node, Cell):
                return get((node.row, node.col))
            return Arr([[get((r, c)) for c in range(node.col0, node.col1 + 1)] for r in range(node.row0, node.row1 + 1)])
        if isinstance(node, Unary):
            n = to_number(self.value(node.of))
            return n if isinstance(n, Err) else {"-": -n, "+": n, "%": n / 100}[node.op]
        if isinstance(node, Binary):
            return self.binary(node.op, self.value(node.left), self.value(node.right))
        f = FUNCTIONS.get(node.name)
        return NAME if f is None else f(self, node.args)

    def rectangle(self, where: Area) -> Arr:
        return self._value(Area(where.row0, where.col0, where.row1, where.col1))

    def binary(self, op: str, a, b):
        a, b = top_left(a), top_left(b)
        for v in (a, b):
            if isinstance(v, Err):
                return v
        if op == "&":
            a, b = to_text(a), to_text(b)
            return a if isinstance(a, Err) else b if isinstance(b, Err) else a + b
        if op in ("=", "<>", "<", ">", "<=", ">="):
            order = compare(a, b)
            return {"=": order == 0, "<>": order != 0, "<": order < 0, ">": order > 0, "<=": order <= 0, ">=": order >= 0}[op]
        a, b = to_number(a), to_number(b)
        for v in (a, b):
            if isinstance(v, Err):
                return v
        if op == "/":
            return DIV0 if b == 0 else finite(a / b)
        return power(a, b) if op == "^" else finite({"+": a + b, "-": a - b, "*": a * b}[op])

    def is_reference(self, node) -> bool:
        return isinstance(node, (Cell, Area)) and node.sheet is None

    def flat(self, node) -> list:
        """All values of an argument, row by row."""
        if isinstance(node, Area) and node.sheet is None and node.height * node.width > MAX_ELEMENTS:
            return [NUM]
        v = self.value(node)
        return v.flat if isinstance(v, Arr) else [v]


class Formula:
    def __init__(self, source: str):
        self.source = source
        try:
            self.tree = parse(source[1:])
        except FormulaError as e:
            self.tree = e.error
        nodes = [] if isinstance(self.tree, Err) else list(walk(self.tree))
        self.cells = {(n.row, n.col) for n in nodes if isinstance(n, Cell) and n.sheet is None}
        self.areas = [n for n in nodes if isinstance(n, Area) and n.sheet is None]


class Workbook:
    """A sparse sheet of literals and formulas, with constant side sheets and named ranges."""

    def __init__(self, now: float = 0.0):
        self.cells: dict[tuple[int, int], object] = {}
        self.sheets: dict[str, dict[tuple[int, int], object]] = {}
        self.names: dict[str, Area] = {}
        self.now = now
        self.values: dict[tuple[int, int], object] = {}
        self.dirty: set[tuple[int, int]] = set()
        self.rows = self.cols = 0
        self._readers: dict[tuple[int, int], set] = defaultdict(set)
        self._column_areas: dict[int, set] = defaultdict(set)
        self._wide_areas: set = set()

    # Input

    def set_input(self, row: int, col: int, text: str) -> None:
        self._put((row, col), Formula(text) if text.startswith("=") else literal(text))

    def set_value(self, row: int, col: int, value) -> None:
        self._put((row, col), value)

    def set(self, where: str, text: str) -> None:
        self.set_input(*parse_a1(where), text)

    def define(self, name: str, where: str) -> None:
        first, _, last = where.partition(":")
        self.names[name.upper()] = area(Cell(*parse_a1(first)), Cell(*parse_a1(last or first)))

    def add_sheet(self, name: str, cells: dict[tuple[int, int], object]) -> None:
        self.sheets[name] = dict(cells)

    def _put(self, at: tuple[int, int], content) -> None:
        self._index(at, self.cells.get(at), False)
        if content is None:
            self.cells.pop(at, None)
        else:
            self.cells[at] = content
            self.rows, self.cols = max(self.rows, at[0] + 1), max(self.cols, at[1] + 1)
        self._index(at, content, True)
        self.mark_dirty(at)

    def _index(self, at, content, add: bool) -> None:
        if not isinstance(content, Formula):
            return
        change = lambda s, x: s.add(x) if add else s.discard(x)
        for c in content.cells:
            change(self._readers[c], at)
        for n in content.areas:
            entry = (n, at)
            if n.width > WIDE:
                change(self._wide_areas, entry)
            else:
                for c in range(n.col0, n.col1 + 1):
                    change(self._column_areas[c], entry)

    # Dependencies

    def dependents(self, at: tuple[int, int]) -> set[tuple[int, int]]:
        """Formulas that read the cell directly."""
        found = set(self._readers.get(at, ()))
        for n, reader in (*self._column_areas.get(at[1], ()), *self._wide_areas):
            if n.row0 <= at[0] <= n.row1 and n.col0 <= at[1] <= n.col1:
                found.add(reader)
        return found

    def precedents(self, at: tuple[int, int]) -> set[tuple[int, int]]:
        """Filled cells that the formula reads directly."""
        f = self.cells.get(at)
        if not isinstance(f, Formula):
            return set()
        found = set(f.cells)
        for n in f.areas:
            if n.height * n.width <= len(self.cells):
                found |= {(r, c) for r in range(n.row0, n.row1 + 1) for c in range(n.col0, n.col1 + 1)} & self.cells.keys()
            else:
                found |= {p for p in self.cells if n.row0 <= p[0] <= n.row1 and n.col0 <= p[1] <= n.col1}
        return found

    def mark_dirty(self, at: tuple[int, int]) -> None:
        stack, seen = [at], {at}
        while stack:
            for d in self.dependents(stack.pop()):
                if d not in seen:
                    seen.add(d)
                    stack.append(d)
        self.dirty |= {p for p in seen if isinstance(self.cells.get(p), Formula)}
        for p in seen:
            self.values.pop(p, None)

    def edges(self) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        for at in sorted(self.cells):
            for p in sorted(self.precedents(at)):
                yield p, at

    def order(self, of: Iterable[tuple[int, int]]) -> tuple[list, list]:
        """Topological order of the cells, smallest first where free; and those on or behind cycles."""
        of = set(of)
        below = {p: [d for d in self.dependents(p) if d in of] for p in of}
        waiting = {p: 0 for p in of}
        for ds in below.values():
            for d in ds:
                waiting[d] += 1
        heap = [p for p, n in waiting.items() if n == 0]
        heapq.heapify(heap)
        done = []
        while heap:
            p = heapq.heappop(heap)
            done.append(p)
            for d in below[p]:
                waiting[d] -= 1
                if waiting[d] == 0:
                    heapq.heappush(heap, d)
        return done, sorted(of - set(done))

    # Evaluation

    def eval_formula(self, body: str):
        try:
            tree = parse(body)
        except FormulaError as e:
            return e.error
        return Evaluator(self, dict(self.values)).value(tree)

    def eval_cell(self, where: str):
        return Evaluator(self).cell(parse_a1(where))

    def evaluate_all(self) -> dict[tuple[int, int], object]:
        ev = Evaluator(self)
        return {at: v for at in sorted(self.cells) if (v := ev.cell(at)) is not None}

    def recalculate(self, iterate: bool = False, rounds: int = 100, epsilon: float = 1e-3, method: str = "gauss-seidel") -> list[tuple[int, int]]:
        """Evaluates the dirty cells once each, in topological order; returns them.

        Cells on cycles or behind them are ``#REF!``, or with ``iterate`` the limit
        that repeated evaluation from 0 tends to.
        """
        done, cyclic = self.order(self.dirty)
        ev = Evaluator(self, self.values)
        for at in done:
            self.values.pop(at, None)
            ev.cell(at)
        if cyclic and not iterate:
            self.values.update(dict.fromkeys(cyclic, REF))
        elif cyclic:
            self._iterate(cyclic, rounds, epsilon, method)
        self.dirty.clear()
        return done + cyclic

    def _iterate(self, cells: list, rounds: int, epsilon: float, method: str) -> None:
        self.values.update(dict.fromkeys(cells, 0.0))
        for _ in range(rounds):
            old = {p: self.values[p] for p in cells}
            new = {}
            base = self.values if method == "gauss-seidel" else dict(self.values)  # every formula has a value, so reading adds none
            for p in cells:
                ev = Evaluator(self, base)
                ev.at = p
                f = self.cells[p].tree
                new[p] = f if isinstance(f, Err) else top_left(ev.value(f))
                if method == "gauss-seidel":
                    self.values[p] = new[p]
            self.values.update(new)
            moved = [abs(new[p] - old[p]) if isinstance(new[p], float) and isinstance(old[p], float) else 0.0 if new[p] == old[p] else math.inf for p in cells]
            if max(moved) <= epsilon:
                break

    def computed(self, where: str):
        at = parse_a1(where)
        if at in self.values and at not in self.dirty:
            return self.values[at]
        return Evaluator(self, {p: v for p, v in self.values.items() if p not in self.dirty}).cell(at)


def evaluate_grid(rows: list[list[str]], now: float = 0.0) -> tuple[list[list[str]], list[tuple[str, str]]] | None:
    """A text grid's displayed values and its formulas; None without any formula."""
    if not any(c.startswith("=") for r in rows for c in r):
        return None
    book = Workbook(now)
    for i, row in enumerate(rows):
        for j, text in enumerate(row):
            book.set_input(i, j, text)
    book.recalculate()
    shown = [[display(book.values[i, j]) if isinstance(book.cells.get((i, j)), Formula) else text for j, text in enumerate(row)] for i, row in enumerate(rows)]
    return shown, [(a1(*at), f.source) for at, f in sorted(book.cells.items()) if isinstance(f, Formula)]


CELLS = "book string, row int, col int, input string"


def evaluate_workbooks(cells: DataFrame, iterate: bool = False, now: float = 0.0) -> DataFrame:
    """Many workbooks at once: ``cells`` is (book, row, col, input), the result adds kind, value and error of each cell.

    A workbook is one group, as its cells depend on each other; the parallelism is
    over workbooks.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        book = Workbook(now)
        for r, c, text in zip(part["row"], part["col"], part["input"], strict=True):
            book.set_input(int(r), int(c), text or "")
        book.recalculate(iterate)
        out = []
        for at in sorted(book.cells):
            v = book.values.get(at, None if isinstance(book.cells[at], Formula) else book.cells[at])
            kind = "error" if isinstance(v, Err) else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "text" if isinstance(v, str) else "blank"
            out.append((part["book"].iloc[0], at[0], at[1], kind, v if kind == "number" else None, display(v)))
        return pd.DataFrame(out, columns=["book", "row", "col", "kind", "num", "shown"])

    return cells.groupBy("book").applyInPandas(run, "book string, row int, col int, kind string, num double, shown string")


__all__ = ["MAX_COL", "Call", "Evaluator", "Formula", "Workbook", "evaluate_grid", "evaluate_workbooks", "to_bool"]
