"""Serial dates: days since 1899-12-31, with the day 60 (1900-02-29) that never was."""

from __future__ import annotations

from datetime import date, timedelta
from math import floor, isfinite

BASE = date(1899, 12, 31).toordinal()
LIMIT = 1e8


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a proleptic Gregorian date, any integer year."""
    cycle, year = divmod(y, 400)
    return date(2000 + year, m, 1).toordinal() + (d - 1) + (cycle - 5) * 146097 - date(1970, 1, 1).toordinal()


def civil_from_days(days: int) -> tuple[int, int, int]:
    cycle, rest = divmod(days + date(1970, 1, 1).toordinal() - date(2000, 1, 1).toordinal(), 146097)
    at = date(2000, 1, 1) + timedelta(days=rest)
    return at.year + 400 * cycle, at.month, at.day


EPOCH = days_from_civil(1899, 12, 31)


def to_serial(y: int, m: int, d: int) -> float:
    """Months beyond 1 to 12 and days beyond the month roll over."""
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    if (y, m, d) == (1900, 2, 29):
        return 60.0
    n = days_from_civil(y, m, 1) + d - 1 - EPOCH
    return float(n + 1 if n >= 60 else n)


def from_serial(serial: float) -> tuple[int, int, int]:
    n = floor(max(-LIMIT, min(LIMIT, serial))) if isfinite(serial) else 0
    if n == 60:
        return 1900, 2, 29
    return civil_from_days(n + EPOCH - (n > 60))


def time_of(serial: float) -> tuple[int, int, int]:
    """Hour, minute, second; rounded to seconds first."""
    if not isfinite(serial):
        return 0, 0, 0
    s = floor((serial - floor(serial)) * 86400 + 0.5) % 86400
    return s // 3600, s // 60 % 60, s % 60


def month_days(y: int, m: int) -> int:
    return days_from_civil(y + m // 12, m % 12 + 1, 1) - days_from_civil(y, m, 1)


def add_months(serial: float, months: int, last_day: bool = False) -> float:
    y, m, d = from_serial(serial)
    total = y * 12 + m - 1 + months
    y, m = total // 12, total % 12 + 1
    return to_serial(y, m, month_days(y, m) if last_day else min(d, month_days(y, m)))
