"""String rules of the compare path, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.values import try_number

# The cell texts that a delimited reader takes for "no value".
NA_TOKENS = (
    "", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "-NaN", "-nan", "None", "<NA>",
    "#N/A", "#N/A N/A", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Fixed patterns. (?U) gives Unicode classes; \x1c-\x1f are separators it leaves out.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
_NONE_WORD = r"(?U)\bnone\b"
_URI_PASSWORD = r"://([^:/@]+):([^/\s]+)@"


def na_to_empty(col: Column) -> Column:
    """Null and every NA token become the empty string."""
    return F.when(col.isNull() | col.isin(*NA_TOKENS), F.lit("")).otherwise(col)


def na_to_empty_sql(name: str) -> str:
    """:func:`na_to_empty` of a named column as SQL text."""
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return f"CASE WHEN `{name}` IS NULL OR `{name}` IN ({tokens}) THEN '' ELSE `{name}` END"


def normalize_text(col: Column, drop_none: bool = False) -> Column:
    """Lower-case, collapse blanks, turn ``_`` and ``-`` into blanks, trim; null gives ``""``.

    Blanks collapse before the replacement, so ``a__b`` keeps two blanks. ``drop_none`` first
    removes the word ``none``.
    """
    text = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    if drop_none:
        text = F.regexp_replace(text, _NONE_WORD, "")
    collapsed = F.trim(F.regexp_replace(text, _BLANKS, " "))
    return F.trim(F.translate(collapsed, "_-", "  "))


def normalize_without_none(col: Column) -> Column:
    """:func:`normalize_text` with the word ``none`` removed."""
    return normalize_text(col, drop_none=True)


def is_blank(col: Column) -> Column:
    """Null or empty string."""
    return F.coalesce(col.cast("string"), F.lit("")) == ""


def is_digits(col: Column) -> Column:
    """Only ASCII digits, at least one."""
    return F.coalesce(col.cast("string"), F.lit("")).rlike("^[0-9]+$")


def digits_or_zero(col: Column) -> Column:
    """Digit text as a double, anything else as 0; ``numbers.digit_number`` orders digits of any length exactly."""
    return F.when(is_digits(col), try_number(col)).otherwise(F.lit(0.0))


def json_flag(col: Column, field: str) -> Column:
    """True where JSON text holds ``"field": true``; blanks after the colon do not matter."""
    return F.coalesce(F.lower(col).rlike(field.lower() + r'":\s*true'), F.lit(False))


def redact_uri(col: Column) -> Column:
    """Replace the password of ``scheme://user:password@host`` by four stars."""
    return F.regexp_replace(col, _URI_PASSWORD, "://$1:****@")


def char_count(col: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def header_separator(header: Column, file_name: Column) -> Column:
    """Separator of a delimited file: pipe, then comma, then by extension."""
    return (
        F.when(char_count(header, "|") > 0, "|")
        .when(char_count(header, ",") > 0, ",")
        .when(F.lower(file_name).endswith(".csv"), ",")
        .otherwise("|")
    )


def join_messages(*parts: Column) -> Column:
    """Non-null messages joined with ``"; "``; the empty string if there are none."""
    return F.concat_ws("; ", *parts)


def counted_message(label: str, count: Column) -> Column:
    """``"label: n"`` where n is positive, else null."""
    return F.when(count > 0, F.concat(F.lit(label + ": "), count.cast("string")))
