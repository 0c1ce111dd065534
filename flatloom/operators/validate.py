"""Checks on whole documents held in a text column: one error text, or null when sound.

The folder scans apply the same rules per file; these serve any DataFrame with a
document per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.json import is_nested, is_object, kind, let, nested_keys, parse_strict
from ..functions.text import count_of


def csv_error(text: Column) -> Column:
    """Error of a CSV document: encoding, unclosed quote, no header row."""
    return F.when(~F.is_valid_utf8(text), errors.message(errors.NOT_UTF8)).when(
        count_of(text, '"') % 2 == 1, errors.message(errors.UNCLOSED_QUOTE)
    ).when(~text.rlike(r"[^\r\n]"), errors.message(errors.EMPTY_CSV))


def unwrap(value: Column) -> Column:
    """Records of a document variant: the items of an array, or the one object."""
    return let(
        value,
        lambda v: F.when(
            kind(v).startswith("ARRAY<"), F.try_variant_get(v, "$", "array<variant>")
        ).otherwise(F.array(v)),
    )


def _item_error(item: Column, position: Column) -> Column:
    nested = F.get(nested_keys(item), F.lit(0))
    return F.when(~is_object(item), errors.not_an_object(position)).otherwise(
        errors.nested_field(nested)
    )


def first_record_error(value: Column) -> Column:
    """Message for the first record, in order, that is no flat object."""
    found = F.transform(unwrap(value), lambda item, i: _item_error(item, i + 1))
    return F.get(F.array_compact(found), F.lit(0))


def json_error(text: Column) -> Column:
    """Error of a JSON document: encoding, syntax, top-level shape, first bad record."""

    def judge(value: Column) -> Column:
        return (
            F.when(value.isNull(), errors.message(errors.MALFORMED_JSON))
            .when(~is_nested(value), errors.message(errors.NOT_OBJECT_OR_ARRAY))
            .otherwise(errors.message(first_record_error(value)))
        )

    return F.when(~F.is_valid_utf8(text), errors.message(errors.NOT_UTF8)).otherwise(
        let(parse_strict(text), judge)
    )


def no_records_error(text: Column) -> Column:
    """Error of a sound JSON document without any record, for JSON to CSV."""
    filled = F.filter(unwrap(parse_strict(text)), lambda i: kind(i) != "OBJECT<>")
    return F.when(F.size(filled) == 0, errors.message(errors.NO_RECORDS))
