"""Frequencies such as `D`, `10min`, `6h`, `W`, `ME` and the bins that they cut time into.

A bin is labelled by its start, but a week by its closing Sunday and `ME`, `QE`, `YE` by the period's last day. Bins are those of the column's
own wall clock: for TIMESTAMP the session's zone, for TIMESTAMP_NTZ the values as they are. The label has the column's type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the fixed units.
SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400}
#: Months of the calendar units, and whether their label is the period's end.
MONTHS = {"MS": (1, False), "ME": (1, True), "QS": (3, False), "QE": (3, True), "YS": (12, False), "YE": (12, True)}
#: Other spellings.
ALIASES = {"S": "s", "T": "min", "H": "h", "d": "D", "W-SUN": "W", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE", "AS": "YS"}


@dataclass(frozen=True)
class Frequency:
    n: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Frequency:
        m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+(?:-SUN)?)\s*", text)
        unit = ALIASES.get(m[2], m[2]) if m else ""
        if unit not in (*SECONDS, *MONTHS, "W") or m[1] and int(m[1]) < 1:
            raise ValueError(f"unknown frequency {text!r}")
        n = int(m[1] or 1)
        if n > 1 and (unit == "W" or unit in MONTHS and MONTHS[unit][1]):
            raise ValueError(f"multiples of {unit} are not supported")
        return cls(n, unit)

    @property
    def seconds(self) -> int | None:
        """Length of a bin, where it is fixed."""
        return self.n * SECONDS[self.unit] if self.unit in SECONDS else None

    @property
    def needs_origin(self) -> bool:
        """Whether bins are counted from the first timestamp's day (or month) and not from each day's midnight."""
        return (86400 % self.seconds != 0) if self.seconds else self.n > 1

    def interval(self) -> Column:
        """A step from one label to the next, for sequence(). Not for ends of months."""
        if self.seconds:
            return F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {self.seconds})") if self.unit != "D" else F.expr(f"make_interval(0, 0, 0, {self.n})")
        return F.expr("make_interval(0, 0, 1)") if self.unit == "W" else F.expr(f"make_interval(0, {self.n * MONTHS[self.unit][0]})")


def _seconds_between(a: Column, b: Column) -> Column:
    return F.unix_micros(b.cast("timestamp")) / 1_000_000 - F.unix_micros(a.cast("timestamp")) / 1_000_000


def bin_start(column: Column, freq: Frequency, kind: str, origin: Column | None = None) -> Column:
    """Start of the bin that holds a time. kind: the column's type, `timestamp` or `timestamp_ntz`. origin: the first
    time of its data, for a frequency that needs it."""
    if freq.needs_origin and origin is None:
        raise ValueError("this frequency counts from the first timestamp")
    if freq.unit == "W":
        start = F.date_trunc("week", column)
    elif freq.unit in MONTHS:
        months, _ = MONTHS[freq.unit]
        number = lambda c: F.year(c) * 12 + F.month(c) - 1
        width = months * freq.n
        first = number(F.date_trunc({1: "month", 3: "quarter", 12: "year"}[months], origin)) if freq.n > 1 else F.lit(0)
        at = first + F.floor((number(column) - first) / width) * width
        start = F.make_date(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), F.lit(1))
    elif freq.unit == "D" and freq.n == 1:
        start = F.date_trunc("day", column)
    elif freq.unit == "D":
        days = F.datediff(column.cast("date"), origin.cast("date"))
        start = F.date_add(origin.cast("date"), (F.floor(days / freq.n) * freq.n).cast("int"))
    else:
        anchor = F.date_trunc("day", origin if freq.needs_origin else column)
        passed = F.floor(_seconds_between(anchor, column) / freq.seconds) * freq.seconds
        start = F.timestamp_micros(F.unix_micros(anchor.cast("timestamp")) + (passed * 1_000_000).cast("long"))
    return start.cast("timestamp").cast(kind)


def bin_label(column: Column, freq: Frequency, kind: str, origin: Column | None = None) -> Column:
    """Label of the bin that holds a time."""
    start = bin_start(column, freq, kind, origin)
    if freq.unit == "W":
        return F.date_add(start.cast("date"), 6).cast(kind)
    if freq.unit in MONTHS and MONTHS[freq.unit][1]:
        return F.last_day(F.add_months(start.cast("date"), MONTHS[freq.unit][0] - 1)).cast(kind)
    return start


def labels_between(first: Column, last: Column, freq: Frequency, kind: str) -> Column:
    """Array of all labels from one label to another."""
    if freq.unit in MONTHS and MONTHS[freq.unit][1]:
        months = MONTHS[freq.unit][0]
        starts = F.sequence(F.add_months(F.trunc(first.cast("date"), "month"), 1 - months), F.trunc(last.cast("date"), "month"), F.expr(f"make_interval(0, {months})"))
        return F.transform(starts, lambda x: F.last_day(F.add_months(x, months - 1)).cast(kind))
    return F.sequence(first, last, freq.interval())
