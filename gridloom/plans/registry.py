"""Functions of the formula language by name: what there is, and a user's own.

A user's function is one of columns (stays in generated code), of Arrow batches, an
aggregate, or a table function, which makes an array's rows from another's. All are known
to formulas from then on, under their name in upper case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.library import FUNCTIONS
from gridloom.plans import compiler as P
from gridloom.plans import relational as R

_TYPES = {"number": "double", "text": "string", "bool": "boolean"}
_KINDS = {"n": "number", "t": "text", "b": "bool"}


@dataclass(frozen=True)
class Entry:
    name: str
    form: str
    own: bool


_own: dict[str, Entry] = {}


def entries() -> list[Entry]:
    """All functions, by name: of a row, aggregates, those that look beyond their row, arrays, and a user's own."""
    forms = {**dict.fromkeys(FUNCTIONS, "row"), **dict.fromkeys(P.ROWWISE, "row"), **dict.fromkeys(P.AGGREGATES, "aggregate"), **dict.fromkeys(R.CALLS, "join"), **dict.fromkeys(R.ARRAYS, "array")}
    return [_own.get(n, Entry(n, form, False)) for n, form in sorted(forms.items())]


def is_known(name: str) -> bool:
    return any(e.name == name.upper() for e in entries())


def _new(name: str, form: str) -> str:
    name = name.upper()
    if is_known(name) and name not in _own:
        raise ValueError(f"{name} is a function of the language")
    remove(name)
    _own[name] = Entry(name, form, True)
    return name


def remove(name: str) -> None:
    """Forgets a user's function."""
    if _own.pop(name.upper(), None) is not None:
        for table in (P.ROWWISE, P.AGGREGATES, R.ARRAYS):
            table.pop(name.upper(), None)


def function(name: str, kinds: str, result: str, *defaults):
    """Registers a function of columns: ``kinds`` is a letter (n, t or b) for each argument, the last may have defaults.

    It gives a Column; a null is the error ``#VALUE!``.
    """

    def register(f: Callable[..., Column]) -> Callable[..., Column]:
        own = _new(name, "row")
        P.rowwise(own, kinds, result, *defaults)(lambda *args: (lambda out: P.Typed(result, out, P.code(out.isNull(), "#VALUE!")))(f(*args)))
        return f

    return register


def arrow_function(name: str, kinds: str, result: str):
    """Registers a function of pandas Series, one for each argument, that gives a Series; a missing value is ``#VALUE!``."""

    def register(f: Callable[..., pd.Series]) -> Callable[..., pd.Series]:
        def batch(*args: pd.Series) -> pd.Series:
            return f(*args)

        batch.__annotations__ = {"args": pd.Series, "return": pd.Series}
        function(name, kinds, result)(F.pandas_udf(batch, _TYPES[result]))
        return f

    return register


def aggregate_function(name: str, empty: float | str = "#NUM!"):
    """Registers an aggregate of one column of numbers; ``empty`` is the result of none: a number or an error."""

    def register(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        P.aggregate(_new(name, "aggregate"), f, empty)
        return f

    return register


def table_function(name: str):
    """Registers a function of an array's rows (``value, __o``) and constants that gives such rows."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        R.ARRAYS[_new(name, "array")] = lambda b, inner, *args: f(R.array_rows(b, inner), *[R.constant_value(a) for a in args])
        return f

    return register
