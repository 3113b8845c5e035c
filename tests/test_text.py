import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallygrid.functions.text import plain_number


def test_plain_numbers_at_every_size(spark):
    """Digits that give the double back, without an exponent, as Python's decimals write them.

    Java's text may have a digit more than the shortest one.
    """
    rng = random.Random(2)
    values = [0.0, 1.0, -1.0, 0.1, 1e7, 12345678.9, 1e-3, 9.99e-4, 1e22, 1e300, -1e300, 1e-300, -1.5e-300, 1.7976931348623157e308]
    values += [5e-324, 2.2250738585072014e-308, 123456789012345680.0, 1e28, 1e-20, 4.35e-21]
    values += [math.ldexp(rng.choice([-1, 1]) * rng.random(), rng.randint(-1070, 1020)) for _ in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for value, text in frame.select("v", plain_number(F.col("v"))).collect():
        want = f"{Decimal(repr(value)):f}"
        want = want.rstrip("0").rstrip(".") if "." in want else want
        assert text == want or (float(text) == value and len(text) <= len(want) + 1 and "E" not in text), (value, text)


def test_words_and_nulls_of_plain_numbers(spark):
    frame = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,), (-0.0,)], "v double")
    assert [r[0] for r in frame.select(plain_number(F.col("v"))).collect()] == ["NaN", "Infinity", "-Infinity", None, "-0"]
