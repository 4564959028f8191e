"""String and number expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens import constants as K


def non_empty(col: Column) -> Column:
    """Null instead of the empty string, so that coalesce skips both."""
    return F.nullif(col, F.lit(""))


def principal(identity: str = "userIdentity") -> Column:
    """Who acted: the ARN, else the user name, else a fixed marker."""
    return F.coalesce(
        non_empty(F.col(f"{identity}.arn")),
        non_empty(F.col(f"{identity}.userName")),
        F.lit(K.UNKNOWN_PRINCIPAL),
    )


def strip_arn(col: Column) -> Column:
    """The bare name at the end of an ARN; null and '' give ''."""
    after_slash = F.substring_index(F.coalesce(col, F.lit("")), "/", -1)
    return F.substring_index(after_slash, ":", -1)


def lookup(col: Column, table: Mapping, default: Column | None = None) -> Column:
    """A lookup in a small fixed table, as one CASE inside the generated code."""
    case = None
    for key, value in table.items():
        hit = col == F.lit(key)
        case = F.when(hit, F.lit(value)) if case is None else case.when(hit, F.lit(value))
    return case if default is None else case.otherwise(default)


def class_label(col: Column) -> Column:
    return lookup(col, K.CLASS_LABELS)


def severity(col: Column) -> Column:
    return lookup(col, K.SEVERITIES, F.lit(K.DEFAULT_SEVERITY))


def describe_feature(col: Column) -> Column:
    return lookup(col, K.FEATURE_DESCRIPTIONS, F.replace(col, F.lit("_"), F.lit(" ")))


def whole_percent(share: Column) -> Column:
    """share*100 with no decimals; exact halves go to the even number."""
    return F.concat(F.rint(share * 100).cast("bigint").cast("string"), F.lit("%"))


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded on the exact binary value, halves up.

    For values in [0, 1024). Scaled by a power of two a double is a whole number
    (below 1/256, where it may not be, the text is 0.0 anyway), and whole-number
    arithmetic does the rounding.
    """

    def tenths(bits: int) -> Column:
        scaled = (value * F.lit(2.0**bits)).cast("bigint").cast("decimal(20,0)")
        half_up = scaled * F.lit(20) + F.lit(2**bits)
        return F.call_function("div", half_up, F.lit(2 ** (bits + 1)))

    n = F.when(value < 1, tenths(60)).otherwise(tenths(52))
    whole = F.call_function("div", n, F.lit(10)).cast("string")
    return F.concat(whole, F.lit("."), (n % 10).cast("string"))


def one_decimal_percent(share: Column) -> Column:
    return F.concat(one_decimal(share * 100), F.lit("%"))
