"""Exact numbers of any length from decimal text, as native expressions.

A number is a struct of sign, exponent and digits, its normal form: two texts give the same struct if and only if they
stand for the same number, and structs sort as the numbers do. No digit is ever rounded, so ids of any length stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?0*[0-9]{1,18})?$"
_PLAIN = r"^[0-9]+\z"
_DIGITS, _REVERSED = "0123456789", "9876543210"
_LAST = "~"  # sorts after every digit
PLAIN_ZEROS = 40  # beyond so many added zeros the text of a number has an exponent


def exact_number(col: Column) -> Column:
    """Decimal text (point and exponent allowed) as a number; other text becomes null.

    The struct is ``(sign, exponent, digits)``: the value is 0.digits times ten to the exponent, without outer zeros.
    For negative numbers exponent and digits are turned round, so that they sort backwards.
    """
    text = F.trim(col.cast("string"))
    body = F.lower(F.ltrim(text, F.lit("+-")))
    mantissa = F.substring_index(body, "e", 1)
    power = F.when(body.contains("e"), F.substring_index(body, "e", -1).try_cast("bigint")).otherwise(F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    fraction = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    every = F.concat(whole, fraction)
    inner = F.ltrim(every, F.lit("0"))
    digits = F.rtrim(inner, F.lit("0"))
    exponent = (F.length(whole) - F.length(every) + F.length(inner) + power).cast("bigint")
    negative = text.startswith("-")
    number = F.struct(
        F.when(digits == "", 0).when(negative, -1).otherwise(1).alias("sign"),
        F.when(digits == "", F.lit(0)).when(negative, -exponent).otherwise(exponent).cast("bigint").alias("exponent"),
        F.when((digits != "") & negative, F.concat(F.translate(digits, _DIGITS, _REVERSED), F.lit(_LAST)))
        .otherwise(digits)
        .alias("digits"),
    )
    # Mostly the text is digits alone. Such a number needs none of the above, which Spark would compute anew wherever it is named.
    significant = F.ltrim(text, F.lit("0"))
    plain = F.struct(
        F.when(significant == "", 0).otherwise(1).alias("sign"),
        F.length(significant).cast("bigint").alias("exponent"),
        F.rtrim(significant, F.lit("0")).alias("digits"),
    )
    return F.when(text.rlike(_PLAIN), plain).when(text.rlike(_DECIMAL), number)


def digit_number(col: Column) -> Column:
    """Text of ASCII digits as a number, anything else as zero: the row order of grouped reports."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return exact_number(F.when(text.rlike("^[0-9]+$"), text).otherwise(F.lit("0")))


def number_text(number: Column) -> Column:
    """The shortest plain text of a number; with an exponent where plain text would need very many zeros."""
    return F.transform(F.array(number), _text_of)[0]  # computes ``number`` once


def _text_of(number: Column) -> Column:
    sign = number["sign"]
    digits = F.when(sign < 0, F.translate(F.rtrim(number["digits"], F.lit(_LAST)), _DIGITS, _REVERSED)).otherwise(number["digits"])
    point = number["exponent"] * F.when(sign < 0, -1).otherwise(1)
    minus = F.when(sign < 0, "-").otherwise("")
    text = F.transform(F.array(F.struct(digits.alias("digits"), point.alias("point"))), lambda n: _unsigned(n["digits"], n["point"]))[0]
    return F.when(sign == 0, "0").when(number.isNotNull(), F.concat(minus, text))


def _unsigned(digits: Column, point: Column) -> Column:
    n, short = F.length(digits), point.cast("int")
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -short), digits))
        .when(point < n, F.concat(F.substring(digits, F.lit(1), short), F.lit("."), F.substring(digits, short + 1, n)))
        .otherwise(F.concat(digits, F.repeat(F.lit("0"), short - n)))
    )
    rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
    scientific = F.concat(F.substring(digits, 1, 1), rest, F.lit("E"), (point - 1).cast("string"))
    return F.when((point > -PLAIN_ZEROS) & (point - n < PLAIN_ZEROS), plain).otherwise(scientific)
