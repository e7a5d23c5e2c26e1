"""Text made from numbers.

Whole numbers print without a decimal point and no value prints with an
exponent.  Group on the numbers and add the text last: it is for display and
for chunk names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a viewer matches selections by, or shows.
VOLCANO_NAME = "logFC=%s -log10(p)=%s"
LOG_LOG_NAME = "logFC=%s l-l(p)=%s"
SIZE_NAME = "tiles=%s log10(pixels)=%s"
LOG2_SIZE_NAME = "log2(tiles)=%s log10(pixels)=%s"
CLUSTER_LABEL = "Cluster %d: %d/%d pixels shown, logFC %s to %s, log10(p) %s to %s"
GRID_TITLE = "%d missing pixels out of %d possible in grid"
CLUSTER_LINE = "cluster %s"
ROWS_LINE = "%s rows= %s"
CORNERS_PART = " corners= %s"
PIXELS_PART = " pixels= %s"


def whole_text(x: Column) -> Column:
    """Text of a double that holds a whole number."""
    return F.rint(x).cast("bigint").cast("string")


def plain_text(x: Column) -> Column:
    """Plain text of ``x`` at 15 significant digits, without an exponent; Inf and -Inf by name.

    Fifteen digits drop the noise of a float product and tell any two other numbers apart.
    Whole and everyday numbers, nearly all there are, need no formatter.
    """
    short = F.rint(x * F.lit(1e9)) / F.lit(1e9)
    same = F.abs(short - x) <= F.abs(x) * F.lit(2.0**-51)
    return (
        F.when(x == F.lit(float("inf")), F.lit("Inf"))
        .when(x == F.lit(float("-inf")), F.lit("-Inf"))
        .when((x == F.rint(x)) & (F.abs(x) < 1e15), whole_text(x))
        .when(same & F.abs(short).between(1e-3, 1e6), _unpadded(short))
        .otherwise(_significant(x))
    )


def _unpadded(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _significant(x: Column, digits: int = 15) -> Column:
    """Text of ``x`` rounded to a number of significant digits."""
    text = F.format_string(f"%.{digits - 1}e", F.abs(x))
    number = F.regexp_replace(F.concat(F.substring(text, 1, 1), F.substring(text, 3, digits - 1)), "0+$", "")
    power = F.substring_index(text, "e", -1).try_cast("int")  # NULL gives no number
    size = F.length(number)
    plain = (
        F.when(power >= size - 1, F.rpad(number, power + 1, F.lit("0")))
        .when(power >= 0, F.concat(F.substr(number, F.lit(1), power + 1), F.lit("."), F.substr(number, power + 2)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), number))
    )
    return F.when(F.isnan(x), F.lit("NaN")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), plain))


def pair_text(a: Column, b: Column, sep: str = ",") -> Column:
    return F.concat_ws(sep, a, b)


def fill(template: str, *values: Column) -> Column:
    """A template's ``%s`` and ``%d`` filled with columns; NULL if one of them is.

    ``concat`` stays in generated code, where ``format_string`` runs a formatter per row.
    """
    parts = re.split("%[sd]", template)
    if len(parts) != len(values) + 1:
        raise ValueError(f"{len(values)} values for {template!r}")
    pieces = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        pieces += [value.cast("string"), F.lit(after)]
    return F.concat(*pieces)


def volcano_text(round_logfc: Column, round_p: Column, name: str = VOLCANO_NAME) -> Column:
    """Name of a volcano bin."""
    return fill(name, plain_text(round_logfc), plain_text(round_p))


def fixed_text(x: Column, digits: int = 2) -> Column:
    """``x`` with exactly ``digits`` decimals; meant for values with no ties there."""
    return F.format_string(f"%.{digits}f", x)


@F.pandas_udf(T.StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """One decimal, rounding the exact binary value as C's printf does.

    Java's formatter rounds the shortest decimal text instead (0.25 becomes 0.3), so this one
    runs over Arrow batches, formatted in one call each.
    """
    text = np.char.replace(np.char.mod("%.1f", x.fillna(0.0).to_numpy(float)), "inf", "Inf")
    return pd.Series(text, dtype=object).where(x.notna().to_numpy(), None)
