import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.readings import compared, missing, own_bound

VALUES = {
    T.ByteType(): [-128, -1, 0, 1, 127],
    T.LongType(): [-(2**63), -(2**53) - 1, -1_000_000, 0, 2**53, 2**53 + 1, 2**53 + 2, 2**62 + 1, 2**63 - 1],
    T.DecimalType(12, 2): [Decimal(f"{n}E-2") for n in (-999999999999, -1, 0, 1, 29, 115, 999999999999)],
    T.DecimalType(38, 10): [Decimal(f"{n}E-10") for n in (-(10**38 - 1), 1, 3 * 10**9, 10**17 + 1, 10**38 - 1)],
    T.DecimalType(5, 0): [Decimal(n) for n in (-99999, -7, 0, 7, 99999)],
}


@pytest.mark.parametrize("kind", VALUES, ids=str)
def test_own_bounds_keep_the_rows_of_the_double_test(spark, kind):
    """The comparison with and without the bound in the column's own type, around every value."""
    values = VALUES[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None]], T.StructType([T.StructField("v", kind)]))
    rng = random.Random(4)
    bounds = [0.0, -0.0, 0.5, -1e6, 1e30, -1e30, 1e300, 9007199254740993.0, 0.1, 0.29, 1.15]
    bounds += [float(v) * (1 + rng.choice([0, 2**-52, -(2**-53)])) for v in values]
    tests = [(op, b) for op in ("<", "<=", ">", ">=") for b in bounds]
    got = df.select(*(F.expr(compared(df, "v", op, b)).alias(f"a{i}") for i, (op, b) in enumerate(tests)))
    want = df.select(*(F.expr(f"CAST(v AS DOUBLE) {op} {b!r}D").alias(f"a{i}") for i, (op, b) in enumerate(tests)))
    assert [[bool(v) for v in r] for r in got.collect()] == [[bool(v) for v in r] for r in want.collect()]
    equal = df.select(*(F.expr(missing(df, "v", b)) for b in bounds)).collect()
    plain = df.select(*(F.expr(f"CAST(v AS DOUBLE) = {b!r}D") for b in bounds)).collect()
    assert [[bool(v) for v in r] for r in equal] == [[bool(v) for v in r] for r in plain]


def test_bounds_are_the_outermost_values():
    assert own_bound(T.LongType(), ">=", 0.5) == ">= CAST('1' AS bigint)"
    assert own_bound(T.LongType(), "<", 2.0**53) == "<= CAST('9007199254740991' AS bigint)"
    assert own_bound(T.ByteType(), "<", -500.0) == "none"
    assert own_bound(T.ByteType(), "<", 500.0) is None
    assert own_bound(T.DecimalType(12, 2), ">", 0.29) == ">= CAST('0.30' AS decimal(12,2))"
    assert own_bound(T.StringType(), ">", 0.0) is None
    assert own_bound(T.LongType(), ">", float("nan")) is None
