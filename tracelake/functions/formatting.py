"""Text for numbers, as Column expressions: decimals, percentages, memory, durations and hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.0 * 24 * 3600


def format_decimals(x: Column, decimals: int = 2) -> Column:
    """Fixed decimals, half to even on the exact binary value; none gives the floor. Infinities read inf and -inf."""
    x = x.cast("double")
    if decimals == 0:
        text = F.floor(x).cast("string")
    else:
        text = F.call_function("format_number", x, F.lit("0." + "0" * decimals))
    endless = F.abs(x) == float("inf")
    return F.when(endless, F.when(x < 0, "-inf").otherwise("inf")).when(F.isnan(x), "nan").otherwise(text)


def format_percentage(x: Column, decimals: int = 2) -> Column:
    return F.concat(format_decimals(x.cast("double") * 100, decimals), F.lit("%"))


def _scaled(size: Column, steps: list[tuple[float, float, str]], decimals: int) -> Column:
    """The first step that size reaches: (least size, factor, unit); the last step takes the rest."""
    out = F.concat(format_decimals(size * steps[-1][1], decimals), F.lit(steps[-1][2]))
    for least, factor, unit in reversed(steps[:-1]):
        out = F.when(size >= least, F.concat(format_decimals(size * factor, decimals), F.lit(unit))).otherwise(out)
    return out


def format_memory(x: Column, decimals: int = 2) -> Column:
    """Bytes by powers of 1024, up to TB; null for null."""
    x = x.cast("double")
    steps = [(1024.0**i, 1024.0**-i, f" {unit}") for i, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B"))]
    return F.concat(F.when(x < 0, "-").otherwise(""), _scaled(F.abs(x), steps, decimals))


def format_duration(x: Column, decimals: int = 2) -> Column:
    """Seconds as s, ms, us or ns; null beyond a thousand years."""
    x = x.cast("double")
    steps = [(1.0, 1.0, "s"), (1e-3, 1e3, "ms"), (1e-6, 1e6, "us"), (0.0, 1e9, "ns")]
    text = F.when(x == 0, "0s").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), _scaled(F.abs(x), steps, decimals)))
    return F.when(F.abs(x) <= 1000 * YEAR, text)


def format_human_duration(x: Column) -> Column:
    """Seconds by their two largest units of d, h, m, s, ms, us and ns; the second is left out if it is 0.

    Decimals are taken exactly, to a nanosecond; doubles by their shortest decimal text. What is no number, or reaches 10^23, gives null.
    """
    seconds = x.try_cast("decimal(32, 9)")
    size = F.abs(seconds)
    whole = lambda a, b: F.call_function("div", a, F.lit(b))
    ns = (size % F.lit(86_400) * F.lit(1_000_000_000)).cast("long")  # of the last day: more days than a bigint has nanoseconds for are right too
    units = [("d", 86_400_000_000_000), ("h", 3_600_000_000_000), ("m", 60_000_000_000), ("s", 1_000_000_000), ("ms", 1_000_000), ("us", 1_000), ("ns", 1)]

    def part(i: int) -> Column:
        return whole(ns % F.lit(units[i - 1][1]), units[i][1]) if i else whole(size, 86_400)

    text = F.lit("0s")
    for i in reversed(range(len(units))):
        first = F.concat(part(i).cast("string"), F.lit(units[i][0]))
        if i + 1 < len(units):
            second = part(i + 1)
            first = F.concat(first, F.when(second > 0, F.concat(F.lit(" "), second.cast("string"), F.lit(units[i + 1][0]))).otherwise(""))
        text = F.when(part(i) > 0, first).otherwise(text)
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def format_hex(x: Column) -> Column:
    """0x and hexadecimal digits; the sign stands after the prefix."""
    return F.concat(F.lit("0x"), F.when(x < 0, "-").otherwise(""), F.lower(F.hex(F.abs(x.cast("long")))))
