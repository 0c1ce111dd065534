"""Text rules as column expressions: trimming, CSV quoting, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tab, the line breaks U+000A-U+000D and U+0085, and every
# Unicode separator (Zs, Zl, Zp).
WHITESPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def trim_whitespace(c: Column) -> Column:
    """Strip Unicode whitespace and line breaks from both ends."""
    return F.regexp_replace(c, f"^{WHITESPACE}++|{WHITESPACE}++$", "")


def is_blank(c: Column) -> Column:
    """Nothing but whitespace. A first byte of visible ASCII settles it without a pattern."""
    visible = (c >= "!") & (c < "\x7f")
    return ~(visible | c.rlike(f"[^{WHITESPACE[1:]}"))


def count_of(c: Column, char: str) -> Column:
    """How often one ASCII character occurs in ``c``."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def csv_escape(c: Column) -> Column:
    """Quote a value only when it holds a comma, a quote or a line feed."""
    needs_quotes = c.contains(",") | c.contains('"') | c.contains("\n")
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs_quotes, quoted).otherwise(c)


def csv_line(values: list[Column]) -> Column:
    """One CSV line from the given text columns; null, missing and empty are alike."""
    return F.concat_ws(",", *[csv_escape(F.coalesce(v, F.lit(""))) for v in values])


def csv_line_of(values: Column) -> Column:
    """One CSV line from an array of text values."""
    return F.array_join(
        F.transform(values, lambda v: csv_escape(F.coalesce(v, F.lit("")))), ","
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """Lower-case extension without the dot; '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def base_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
