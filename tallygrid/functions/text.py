"""Number formatting for legends and labels, exact in the decimal sense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**26)


def two_decimals(value: Column) -> Column:
    """Text with two decimals, rounding the exact binary value, ties to even.

    ``format_string('%.2f')`` rounds the shortest decimal text instead (1.005 gives
    1.01 though the double lies below the tie). Here the fraction is split into a
    26-bit head and a tail: head * 100 and the comparison of the tail with what is
    left to the tie are both exact in double arithmetic.
    """
    size = F.abs(value)
    whole = F.floor(size)
    fraction = size - whole
    head = F.floor(fraction * F.lit(_SPLIT)) / F.lit(_SPLIT)
    tail = (fraction - head) * F.lit(100.0)
    scaled = head * F.lit(100.0)
    cents = F.floor(scaled)
    to_tie = F.lit(0.5) - (scaled - cents)
    up = (tail > to_tie) | ((tail == to_tie) & (cents % F.lit(2) == F.lit(1)))
    total = whole * F.lit(100) + cents + F.when(up, F.lit(1)).otherwise(F.lit(0))
    hundreds = F.floor(total / F.lit(100))
    text = F.concat(
        hundreds.cast("string"),
        F.lit("."),
        F.lpad((total - hundreds * F.lit(100)).cast("string"), 2, "0"),
    )
    # beyond 2**52 a double has no fraction left to round
    text = F.when(size >= F.lit(float(2**52)), F.format_string("%.2f", size)).otherwise(text)
    return F.concat(F.when(value < F.lit(0.0), F.lit("-")).otherwise(F.lit("")), text)


def plain_number(value: Column) -> Column:
    """Shortest text of a double without exponent and without a bare ``.0``, at every size.

    The digits of Spark's shortest text are kept; its exponent says where the point goes among them or how many
    zeros stand between. NaN and the infinities stay words.
    """
    short = value.cast("string")
    parts = F.split(short, "E")
    sign = F.when(F.startswith(short, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    # A mantissa has one digit before the point.
    digits = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), r"[-.]", "")
    before = F.get(parts, F.lit(1)).cast("int") + F.lit(1)
    shown = (
        F.when(before <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -before), digits))
        .when(before >= F.length(digits), F.rpad(digits, before, F.lit("0")))
        .otherwise(F.concat(F.left(digits, before), F.lit("."), F.substring(digits, before + 1, F.length(digits))))
    )
    plain = F.regexp_replace(short, r"\.0$", "")
    return F.when(F.contains(short, F.lit("E")), F.concat(sign, shown)).otherwise(plain)
