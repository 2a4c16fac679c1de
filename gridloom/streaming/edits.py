"""A stream of edits to workbooks: each book's cells are state, changed cells come out.

A book's state is its cells' inputs and what they showed last. A batch's edits of a book
are applied in their order, the book is evaluated, and cells that show something else
than before are given out, erased ones as blank. State that is not touched for the given
time is dropped. The state is in Spark's state store, so a query that starts again from
its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions.cells import Err, display
from gridloom.plans.workbook import Formula, Workbook

CHANGES = "book string, row int, col int, kind string, num double, shown string"
#: The state store that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Books(StatefulProcessor):
    def __init__(self, keep_ms: int | None, now: float):
        self.keep_ms, self.now = keep_ms, now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "row int, col int", "input string, shown string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, before = Workbook(self.now), {}
        for (row, col), (text, shown) in self.cells.iterator():
            book.set_input(row, col, text)
            before[row, col] = shown
        edits = pd.concat(rows).sort_values("seq", kind="stable")
        texts = {(int(r), int(c)): t if isinstance(t, str) else "" for r, c, t in zip(edits["row"], edits["col"], edits["input"], strict=True)}
        for (row, col), text in texts.items():
            book.set_input(row, col, text)
        book.recalculate()
        out = []
        for at in sorted(book.cells.keys() | before.keys()):
            content = book.cells.get(at)
            v = book.values.get(at) if isinstance(content, Formula) else content
            shown = display(v)
            if content is None:
                self.cells.removeKey(at)
            elif at in texts or shown != before.get(at):
                self.cells.updateValue(at, (texts.get(at, content.source if isinstance(content, Formula) else shown), shown))
            if shown != before.get(at, "") or at in texts and at not in before:
                kind = "error" if isinstance(v, Err) else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "text" if isinstance(v, str) else "blank"
                out.append((key[0], *at, kind, v if kind == "number" else None, shown))
        if out:
            yield pd.DataFrame(out, columns=["book", "row", "col", "kind", "num", "shown"])

    def close(self) -> None:
        pass


def changed_cells(edits: DataFrame, keep_ms: int | None = None, now: float = 0.0) -> DataFrame:
    """The changed cells (:data:`CHANGES`) of a stream of edits ``book, row, col, input, seq``; an empty input erases a cell.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` to be :data:`PROVIDER`.
    """
    return edits.groupBy("book").transformWithStateInPandas(statefulProcessor=Books(keep_ms, now), outputStructType=CHANGES, outputMode="Update", timeMode="None" if keep_ms is None else "ProcessingTime")
