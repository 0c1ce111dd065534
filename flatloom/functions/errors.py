"""Error texts and kinds. The messages are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID_INPUT = "Invalid input"
INTERNAL_ERROR = "Internal error"

EMPTY_CSV = "CSV is empty or missing a header row."
UNCLOSED_QUOTE = "CSV contains an unclosed quote."
NO_RECORDS = "JSON has no records to convert."
NOT_OBJECT_OR_ARRAY = "JSON must be an object or array of objects."
NOT_UTF8 = "Input is not valid UTF-8 text."

# Our own wording.
MALFORMED_JSON = "JSON is malformed."
LONG_RECORD = "A record is too long for one row."
SPLIT_STRAY_QUOTE = "CSV record has a stray quote and spans lines."

REJECT_COLUMNS = ["src_file", "rec_no", "error_kind", "error_msg"]


class InvalidInput(ValueError):
    """Raised in strict mode for the first rejected file or record."""


class Cancelled(RuntimeError):
    """Raised by a conversion that was given up; it is no failure."""


def message(text: Column | str, kind: str = INVALID_INPUT) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit(f"{kind}: "), text)


def nested_field(key: Column) -> Column:
    return F.concat(
        F.lit("Only flat JSON is supported. Field '"), key, F.lit("' contains a nested value.")
    )


def not_an_object(position: Column) -> Column:
    return F.concat(
        F.lit("Array item "), position.cast("string"), F.lit(" is not a JSON object.")
    )


def wrong_extension(extension: Column, label: Column) -> Column:
    return F.concat(
        F.lit("Selected file type '."), extension, F.lit("' is not valid for "), label, F.lit(".")
    )
