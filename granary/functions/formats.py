"""How sizes, shares and times are shown."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _power(size: Column) -> Column:
    out = F.lit(0)
    for k in range(1, len(UNITS)):
        out = F.when(size >= 1024**k, k).otherwise(out)
    return out


def _shown(size: Column, rounded) -> Column:
    k = _power(size)
    unit = F.element_at(F.array(*map(F.lit, UNITS)), k + 1)
    value = size.cast("double") / F.pow(F.lit(1024.0), k)
    return F.when(k == 0, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", rounded(value)), F.lit(" "), unit))


def human_size(size: Column) -> Column:
    """1536 -> 1.5 KB: one decimal of the exact value, ties to even."""
    return _shown(size, lambda x: F.bround(x, 1))


def human_size_up(size: Column) -> Column:
    """As human_size(), with ties away from zero, as the graphical view shows it."""
    return _shown(size, lambda x: x)


def human(size: int, up: bool = False) -> str:
    k = 0
    while size >= 1024 ** (k + 1) and k < len(UNITS) - 1:
        k += 1
    if k == 0:
        return f"{size} B"
    return f"{(Decimal(size) / 1024**k).quantize(Decimal('0.1'), ROUND_HALF_UP if up else ROUND_HALF_EVEN)} {UNITS[k]}"


def duration(seconds: float) -> str:
    """Under a second in ms (cut), under a minute with one decimal, else minutes and rounded seconds."""
    if seconds < 1:
        return f"{int(seconds * 1000)} ms"
    if seconds < 60:
        return f"{seconds:.1f} s"
    m = math.floor(seconds / 60)
    return f"{m}m {seconds - m * 60:.0f}s"


def duration_ms(ms: float) -> str:
    """As duration(), from ms and with halves rounded up."""
    if ms < 1000:
        return f"{math.floor(ms + 0.5)} ms"
    if ms < 60_000:
        return f"{Decimal(ms / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)} s"
    m = math.floor(ms / 60_000)
    return f"{m}m {math.floor(ms / 1000 - m * 60 + 0.5)}s"


def percent_used(total: Column, free: Column) -> Column:
    """Whole percent of total that is not free; null where total is not positive."""
    used = F.greatest(total - free, F.lit(0))
    return F.when(total > 0, F.bround(used.cast("double") / total * 100, 0).cast("int"))


def bar_width(size: Column, largest: Column) -> Column:
    """Percent of the largest, at least 2."""
    return F.greatest(F.lit(2.0), 100.0 * size / largest)
