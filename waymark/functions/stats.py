"""The percentile flavours; each has its own rank rule and none stands for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def nearest_rank(name: str, p: float) -> Column:
    """The value at 1-based rank ceil(n p), at least 1."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def interpolated(name: str, p: float) -> Column:
    """Linear interpolation between the ranks around (n - 1) p, over finite values."""
    return F.percentile(_finite(F.col(name)), F.lit(p))


def lower_rank(name: str, p: float) -> Column:
    """The value at 0-based rank floor((n - 1) p)."""
    values = F.sort_array(F.collect_list(name))
    return F.get(values, F.floor((F.size(values) - 1) * p).cast("int"))


def upper_rank(name: str, p: float) -> Column:
    """The value at 0-based rank ceil((n - 1) p)."""
    values = F.sort_array(F.collect_list(name))
    return F.get(values, F.ceil((F.size(values) - 1) * p).cast("int"))


def lower_of(values: Column, p: float) -> Column:
    """lower_rank of an array column."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) * p).cast("int"))


def half_up(c: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at a decimal place: halves go up, also below zero."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def fixed(c: Column, digits: int = 2) -> Column:
    """x to so many decimals (3 at most), halves of its exact binary value away from zero. Its fraction, as a count of 2**-52,
    is a whole number that is scaled and rounded without error."""
    whole = F.floor(F.abs(c))
    part = F.floor((F.abs(c) - whole) * float(1 << 52))
    units = F.shiftright(part * 10**digits + (1 << 51), 52)
    return F.signum(c) * (whole * 10**digits + units) / 10**digits
