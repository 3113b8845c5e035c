"""Numeric view of a column, and tests for present and missing readings, as SQL text.

The catalogue has hundreds of small expressions. Written as text, a whole projection is
one call into the JVM instead of one per operator, which is most of the planning time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.specs import SENTINEL, Selection


def quoted(name: str) -> str:
    """Column name that may hold dots, spaces or backticks."""
    return "`" + name.replace("`", "``") + "`"


def double(value: float) -> str:
    """Literal of exactly this finite double."""
    return f"{float(value)!r}D"


def number(df: DataFrame, name: str) -> str:
    """The column as double; text that is no number becomes NULL and is then never counted.

    A column that is a double already is left bare, so that predicates on it still
    reach the Parquet reader.
    """
    if isinstance(df.schema[name].dataType, T.DoubleType):
        return quoted(name)
    return f"try_cast({quoted(name)} AS DOUBLE)"


#: Smallest and largest values of the whole-number types.
_WHOLE = {
    T.ByteType: (-(2**7), 2**7 - 1),
    T.ShortType: (-(2**15), 2**15 - 1),
    T.IntegerType: (-(2**31), 2**31 - 1),
    T.LongType: (-(2**63), 2**63 - 1),
}


def _steps(kind: T.DataType) -> tuple[int, int, Callable[[int], float], Callable[[int], str]] | None:
    """The values of a type in order, by number: the first and last, each as the double Spark casts it to, and as text."""
    if type(kind) in _WHOLE:
        word = kind.simpleString()
        return *_WHOLE[type(kind)], float, lambda n: f"CAST('{n}' AS {word})"
    if isinstance(kind, T.DecimalType):
        most = 10**kind.precision - 1

        def value(n: int) -> Decimal:
            return Decimal((n < 0, tuple(map(int, str(abs(n)))), -kind.scale))

        return -most, most, lambda n: float(value(n)), lambda n: f"CAST('{value(n):f}' AS {kind.simpleString()})"
    return None


@functools.lru_cache(maxsize=4096)
def own_bound(kind: T.DataType, operator: str, bound: float) -> str | None:
    """The comparison of a whole-number or decimal column with a double, in values of the column's own type.

    ``operator`` is one of < <= > >=. The double test casts the column, which keeps the order of its
    values, so the values that pass are all on one side of one of them, which is looked for. Returned is operator and
    literal; "none" if no value passes, None if all do or the type is another.
    """
    steps = _steps(kind)
    if steps is None or math.isnan(bound):
        return None
    low, high, as_double, text = steps
    passes = {
        "<": lambda n: as_double(n) < bound,
        "<=": lambda n: as_double(n) <= bound,
        ">": lambda n: as_double(n) > bound,
        ">=": lambda n: as_double(n) >= bound,
    }[operator]
    rising = operator[0] == ">"
    if passes(low if rising else high):
        return None
    if not passes(high if rising else low):
        return "none"
    inside, outside = (high, low) if rising else (low, high)
    while abs(inside - outside) > 1:
        middle = (inside + outside) // 2
        inside, outside = (middle, outside) if passes(middle) else (inside, middle)
    return f"{operator[0]}= {text(inside)}"


def compared(df: DataFrame, name: str, operator: str, bound: float) -> str:
    """The column, as double, compared with a finite double, so that the reader can skip by it.

    A predicate on a cast column never reaches the Parquet reader. For whole numbers and decimals the same
    comparison in the column's own type stands beside the double test.
    """
    test = f"{number(df, name)} {operator} {double(bound)}"
    own = own_bound(df.schema[name].dataType, operator, float(bound))
    if own is None:
        return test
    return f"({quoted(name)} IS NOT NULL AND false)" if own == "none" else f"({quoted(name)} {own} AND {test})"


def between(df: DataFrame, name: str, lo: float, hi: float) -> str:
    """``lo <= v < hi``. NaN sorts above every number in Spark, so the upper test drops it."""
    return f"({compared(df, name, '>=', lo)} AND {compared(df, name, '<', hi)})"


def valid(df: DataFrame, name: str, sentinel: float = SENTINEL) -> str:
    """True for a reading, NULL (so filtered out) for NULL, true for NaN."""
    return f"({number(df, name)} <> {double(sentinel)})"


def missing(df: DataFrame, name: str, sentinel: float = SENTINEL) -> str:
    """True for the sentinel. Other types than double are also bounded in their own values, for the reader."""
    test = f"{number(df, name)} = {double(sentinel)}"
    kind = df.schema[name].dataType
    own = [own_bound(kind, operator, float(sentinel)) for operator in (">=", "<=")]
    if "none" in own:
        return f"({quoted(name)} IS NOT NULL AND false)"
    return "(" + " AND ".join([f"{quoted(name)} {bound}" for bound in own if bound] + [test]) + ")"


def selected(df: DataFrame, selection: Selection, sentinel: float = SENTINEL) -> str | None:
    """The selection as one predicate; None when it keeps every row."""
    tests = [valid(df, c, sentinel) for c in selection.valid]
    tests += [missing(df, c, sentinel) for c in selection.missing]
    return " AND ".join(tests) or None


def as_double(df: DataFrame, name: str) -> Column:
    return F.expr(number(df, name))
