"""Text cleaning and identifier patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .. import rules


def strip_controls(text: Column) -> Column:
    """Text without the control characters that report cells cannot hold."""
    return F.regexp_replace(text, rules.CONTROL_CHARS, "")


def trim_ws(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^[{rules.WS}]+|[{rules.WS}]+$", "")


def has_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(rules.EMAIL)


def has_web(text: Column) -> Column:
    return text.rlike(rules.WEB)


def has_long_digits(text: Column) -> Column:
    """At least nine digits in one run of digits, dashes and white space."""
    return text.rlike(rules.NINE_DIGITS) & F.regexp_replace(
        text, rules.DIGIT_GAPS, " ").rlike(rules.LONG_DIGITS)


PATTERN_TESTS = {"email": has_email, "web": has_web, "long_digit": has_long_digits}


def is_prolific(text: Column) -> Column:
    return text.rlike(rules.PROLIFIC_ID)


def is_mturk(text: Column) -> Column:
    return text.rlike(rules.MTURK_ID)


def is_ip_shaped(text: Column) -> Column:
    return text.rlike(rules.IP_SHAPE)


def ip_class(text: Column) -> Column:
    """0 not an address, 1 address-shaped, 2 valid but private, 3 valid and public."""
    return (
        F.when(~F.coalesce(is_ip_shaped(text), F.lit(False)), 0)
        .when(~text.rlike(rules.IP_VALID), 1)
        .when(text.rlike(rules.IP_PRIVATE), 2)
        .otherwise(3)
    )


def plain_double(x: Column) -> Column:
    """A double as plain decimal digits: 5.0, 40.25, 12345678.0."""
    x = x.cast("double")
    digits = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    text = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.coalesce(text, x.cast("string"))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """The value of a column as the text that is counted, sampled and shown."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return col.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # a float goes through its own text, so that 0.1f shows as 0.1
        x = col if isinstance(dtype, T.DoubleType) else col.cast("string").cast("double")
        return F.when(~F.isnan(col), plain_double(x))
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def one_decimal(x: Column) -> Column:
    """A number in [0, 128) with one decimal, rounded by its exact binary value, ties to even.

    The number is compared with the midpoint of two tenths in whole numbers:
    scaled by a power of two, a double becomes a bigint without loss.
    """
    tenths = F.floor(x * 10).cast("bigint")
    bits = F.when(x < 1, F.lit(2.0 ** 62)).otherwise(F.lit(2.0 ** 56))
    scaled = (x * bits).cast("bigint").cast("decimal(20,0)") * F.lit(20)
    middle = bits.cast("bigint").cast("decimal(20,0)") * (tenths * 2 + 1).cast("decimal(6,0)")
    up = (scaled > middle) | ((scaled == middle) & (tenths % 2 == 1))
    rounded = tenths + up.cast("int")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def padded_row(value: Column, cnt: Column, pct: Column) -> Column:
    """One display line: value, count, share. Long values are never cut."""
    left = F.when(F.char_length(value) < 50, F.rpad(value, 50, " ")).otherwise(value)
    digits = cnt.cast("string")
    right = F.when(F.char_length(digits) < 6, F.lpad(digits, 6, " ")).otherwise(digits)
    return F.concat(F.lit("  "), left, F.lit(" "), right, F.lit(" ("), one_decimal(pct), F.lit("%)"))
