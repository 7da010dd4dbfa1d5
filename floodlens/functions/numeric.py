"""Numeric helpers shared by operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


TIE_TOL = 1e-10


def q(c: Column | str, digits: int = 6) -> Column:
    """Round half up on the scaled double: ``floor(y + 0.5 + tol) / 10^d`` with
    ``y = x*10^d`` and ``tol = (|y| + 1) * 1e-10``.

    Written as plain IEEE arithmetic so Spark and the SQL oracle produce the
    same bits (``round`` differs between engines on binary near-ties).  Means
    and interpolations of already-rounded values often land exactly on a tie,
    where a different summation order moves the double by an ulp to either
    side; ``tol`` rounds such ties up in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    y = c * F.lit(s)
    return F.floor(y + F.lit(0.5) + (F.abs(y) + F.lit(1.0)) * F.lit(TIE_TOL)) / F.lit(s)


def q_sql(expr: str, digits: int = 6) -> str:
    s = f"CAST({float(10 ** digits)!r} AS DOUBLE)"
    y = f"(({expr}) * {s})"
    return (f"(floor({y} + CAST(0.5 AS DOUBLE) + (abs({y}) + CAST(1.0 AS DOUBLE)) * CAST({TIE_TOL!r} AS DOUBLE))"
            f" / {s})")


def pct(part: Column, whole: Column) -> Column:
    """100*part/whole, 0 when whole is 0 (ANSI division would raise)."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") * 100.0 / whole)
