"""Rounding, guarded logarithms and text at their edges."""

import math

import pytest
from pyspark.sql import functions as F

from binweave.functions.numeric import (
    bin_by_count,
    bin_by_width,
    half_even,
    log10_full,
    log2_full,
    neg_log10,
    signed_neg_log10,
    two_digits,
)
from binweave.functions.text import fill, fixed_text, one_decimal, plain_text, volcano_text, whole_text


def values(spark, column, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    return [r["v"] for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_half_even_ties(spark):
    assert values(spark, half_even, [0.5, 1.5, 2.5, -0.5, -1.5]) == [0, 2, 2, 0, -2]


def test_tile_ties(spark):
    # x + 20 = 25 and 75, half way between tiles.
    assert values(spark, lambda x: bin_by_width(x, 50, 20), [5.0, 55.0, 4.5, 105.5]) == [0, 100, 0, 150]


def test_negative_zero_has_no_sign(spark):
    for fn in (half_even, bin_by_width, bin_by_count, two_digits):
        (v,) = values(spark, fn, [-0.001])
        assert v == 0 and math.copysign(1, v) == 1
    (v,) = values(spark, neg_log10, [1.0])
    assert math.copysign(1, v) == 1


def test_count_bins(spark):
    assert values(spark, lambda x: bin_by_count(x, 4), [0.125, 0.375, 0.3, -0.125]) == [0, 0.5, 0.25, 0]


def test_logarithms_at_the_edges(spark):
    assert values(spark, neg_log10, [1.0, 0.0, 0.01]) == [0.0, math.inf, 2.0]
    assert values(spark, lambda p: log10_full(neg_log10(p)), [1.0, 0.1]) == [-math.inf, 0.0]
    assert values(spark, log2_full, [0.0, 8.0]) == [-math.inf, 3.0]
    assert values(spark, lambda fc: signed_neg_log10(fc, F.lit(0.01)), [-3.0, 0.0, 2.0]) == [-2.0, 0.0, 2.0]


def test_missing_values_stay_missing(spark):
    for fn in (half_even, neg_log10, log10_full, plain_text, whole_text, one_decimal):
        assert values(spark, fn, [None]) == [None]


def test_text(spark):
    assert values(spark, whole_text, [600.0, -0.0, 1e7]) == ["600", "0", "10000000"]
    assert values(spark, plain_text, [3 * 0.1, 600.0, 0.25, -0.0, math.inf, -math.inf, 1e9]) == [
        "0.3", "600", "0.25", "0", "Inf", "-Inf", "1000000000",
    ]
    assert values(spark, plain_text, [0.0001, -12345678.5, 2.9999999999, -0.0625, 1e-12, 1 - 2e-16]) == [
        "0.0001", "-12345678.5", "2.9999999999", "-0.0625", "0.000000000001", "1",
    ]
    # Bins of any width keep names of their own.
    assert values(spark, plain_text, [1e-10, 2e-10, 1e30, 1.5e-300, 123456.789012345]) == [
        "0.0000000001", "0.0000000002", "1" + "0" * 30, "0." + "0" * 299 + "15", "123456.789012345",
    ]
    assert values(spark, fixed_text, [2.0, 0.25]) == ["2.00", "0.25"]
    assert values(spark, lambda x: volcano_text(x, x), [0.5]) == ["logFC=0.5 -log10(p)=0.5"]


def test_fill_counts_its_values(spark):
    assert values(spark, lambda x: fill("a %d of %s", F.lit(2), x.cast("int")), [3.0, None]) == ["a 2 of 3", None]
    with pytest.raises(ValueError, match="2 values"):
        fill("%s", F.lit(1), F.lit(2))


@pytest.mark.parametrize("x,text", [(0.25, "0.2"), (0.35, "0.3"), (0.45, "0.5"), (-1.5, "-1.5"), (2.0, "2.0"), (-math.inf, "-Inf")])
def test_one_decimal_rounds_the_exact_value(spark, x, text):
    assert values(spark, one_decimal, [x]) == [text]
