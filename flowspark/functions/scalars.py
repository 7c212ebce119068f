"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_if(condition: str | Column) -> Column:
    """Rows that meet a condition."""
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def finite(x: Column) -> Column:
    """Neither NaN nor infinite; null stays null."""
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def iso_seconds(ts: Column | str) -> Column:
    """A zone-less timestamp as text to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, rounded down; differences count passed second marks."""
    return F.unix_seconds(ts.cast("timestamp"))


def status(delta: Column, higher_is_better: Column | bool, within: float = 0.001) -> Column:
    """stable, improved or degraded."""
    return F.when(F.abs(delta) <= within, "stable").when((delta > 0) == higher_is_better, "improved").otherwise("degraded")
