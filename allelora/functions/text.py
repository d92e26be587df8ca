"""Text and number expressions with C semantics, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def atof(text: Column) -> Column:
    """The number a text begins with, 0 if it begins with none; "inf" is infinite. Null for null and for "nan"."""
    lead = F.regexp_extract(text, NUMBER, 0)
    word = F.lower(F.regexp_extract(text, r"^\s*([+-]?(?i:inf|nan))", 1))
    number = F.coalesce(F.when(lead != "", lead).try_cast("double"), F.lit(0.0))
    infinite = F.when(word == "-inf", float("-inf")).when(word.endswith("inf"), float("inf"))
    return F.when(text.isNotNull() & ~word.endswith("nan"), F.coalesce(infinite, number))


def g6(x: Column) -> Column:
    """``%.6g`` of a number: six significant digits, no trailing zeros; "nan", "inf" and "-inf"; null for null."""
    x = x.cast("double")
    sci = F.format_string("%.5e", x)
    mantissa, power = F.substring_index(sci, "e", 1), F.substring_index(sci, "e", -1).try_cast("int")
    strip = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    fixed = strip(sci.try_cast("decimal(38,10)").cast("string"))
    wide = F.concat(strip(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    number = F.when(x == 0, "0").when((power >= -4) & (power < 6), fixed).otherwise(wide)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        .otherwise(number)
    )
