"""The numeric contract of volumes: rounding, 16-bit stores, bins and medians as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity: -0.5 -> 0, 2.5 -> 3."""
    return F.floor(x + 0.5)


def wrap_int16(x: Column) -> Column:
    """What a signed 16-bit store keeps of an integer."""
    return F.pmod(x.cast("long") + 32768, F.lit(65536)) - 32768


def clamp_int16(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-32768)), F.lit(32767)).cast("long")


def clamp(x: Column, lo, hi) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.least(F.greatest(x, lo), hi)


def one_if_zero(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))


def gray(v: Column, window: float, level: float) -> Column:
    """Display value 0..255 of a scalar under a window (1 at least) and level."""
    w = max(1.0, float(window))
    return round_half_up(clamp((v - (level - w / 2)) / w, 0.0, 1.0) * 255)


def target_size(n: Column, src: float, dst: float) -> Column:
    return F.greatest(F.lit(1), round_half_up(n * src / dst))


def reflect_index(i: Column, n: int) -> Column:
    """Index into 0..n-1 of a signal mirrored at its end samples."""
    if n == 1:
        return F.lit(0)
    m = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(m < n, m).otherwise(2 * (n - 1) - m)
