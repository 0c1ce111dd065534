"""JSON rules as column expressions over the text of one record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Building blocks of the patterns below. All loops are possessive, so matching
# is linear and needs no stack however long the text is.
WS = r"[ \t\n\r]*+"
STRING = r'"(?:[^"\\]++|\\.)*+"'
FLAT_BODY = rf'(?s:(?:[^{{}}\[\]"]++|{STRING})*+)'
FLAT_OBJECT = rf"\{{{FLAT_BODY}\}}"
NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"

# A number literal that a variant may not hold as it is written.
_LONG_NUMBER = r"[0-9.]{17}|[eE][+-]?[0-9]{3}"
# The same where values stand, or text in a string that looks like it.
_LONG_VALUE = rf":{WS}-?+(?:[0-9.]{{17}}|[0-9.]*+[eE][+-]?[0-9]{{3}})"

# U+0001 cannot occur in valid JSON text, so it is a safe marker.
_MARK = "\u0001"
_ESCAPED_MARK = r"\u0001"

# Spark's JSON functions accept more than JSON by default.
# The parser's own limits would call long texts and numbers malformed. That on depth,
# 1000 levels, stays: the parser calls itself, and deeper values can end an executor.
LIMITS = {"maxStringLen": str(2**31 - 1), "maxNumLen": str(2**31 - 1)}
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", **LIMITS}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` but compute it once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r]++|[ \t\n\r]++$", "")


def lead_char(c: Column) -> Column:
    """First character that is not JSON whitespace."""
    return F.substring(F.ltrim(c, F.lit(" \t\n\r")), 1, 1)


def is_flat_object(c: Column) -> Column:
    """The text has the outline of one object without nested values."""
    return c.rlike(f"^{WS}{FLAT_OBJECT}{WS}$")


def parse_json(c: Column) -> Column:
    """Variant of the first JSON value, without the parser's limits on length and depth."""
    return F.from_json(c, "variant", STRICT)


def parse_strict(c: Column) -> Column:
    """Variant of exactly one JSON value; null when malformed or followed by more text.

    Spark's parser reads the first value and drops the rest, so the text is also
    parsed inside an array and inside an object: text after the value breaks at
    least one of the two.
    """
    in_array = parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = parse_json(F.concat(F.lit('{"d":'), c, F.lit("}")))
    only = let(
        in_array,
        lambda v: F.when(
            F.try_variant_get(v, "$[1]", "variant").isNull(),
            F.try_variant_get(v, "$[0]", "variant"),
        ),
    )
    return F.when(in_object.isNotNull(), only)


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def fields_of(v: Column) -> Column:
    """Fields of an object by key, null for other kinds. Unlike ``kind`` it looks no deeper."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(fields_of(v).isNotNull(), F.lit(False))


def is_nested(v: Column) -> Column:
    """Nested values are objects and arrays, empty ones included."""
    return fields_of(v).isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull()


def nested_keys(v: Column) -> Column:
    """Sorted keys of the fields of object ``v`` that hold a nested value."""
    fields = F.map_entries(v.cast("map<string,variant>"))
    hits = F.filter(fields, lambda e: is_nested(e["value"]))
    return F.array_sort(F.transform(hits, lambda e: e["key"]))


def numbers_as_text(c: Column) -> Column:
    """Put every number literal of a record in quotes, so its text survives parsing.

    Strings are matched first and left alone. A malformed number is not matched
    whole, which leaves the record malformed.
    """
    marked = F.regexp_replace(
        c, rf"({STRING})|({NUMBER})(?=[ \t\n\r]*+[,}}])", f"$1{_MARK}$2{_MARK}"
    )
    unmarked = F.replace(marked, F.lit(_MARK + _MARK), F.lit(""))
    return F.replace(unmarked, F.lit(_MARK), F.lit('"'))


def _loses_text(c: Column) -> Column:
    """The record may hold a number whose literal a parser would rewrite."""
    return c.rlike(r"[0-9][.eE]|-0|[0-9]{18}")


def scalar_texts(c: Column, schema) -> Column:
    """Parse one flat record to text values: literals as written, null as null."""
    return F.from_json(F.when(_loses_text(c), numbers_as_text(c)).otherwise(c), schema, STRICT)


def last_value(rec: Column, key: Column) -> Column:
    """Value of ``key`` in a parsed map; a repeated key gives its last value."""
    keys, values = F.reverse(F.map_keys(rec)), F.reverse(F.map_values(rec))
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def object_json(rec: Column) -> Column:
    """JSON object of a text map, keys in UTF-8 byte order, all values kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rec))))


def _long_numbers_marked(text: Column) -> Column:
    """The record with every long number as a string of its literal between two U+0001.

    U+0001 that strings hold already is doubled, so nothing else looks like a mark.
    """
    doubled = F.replace(text, F.lit(_ESCAPED_MARK), F.lit(_ESCAPED_MARK * 2))
    marked = F.regexp_replace(
        doubled, rf"({STRING})|((?=[-+0-9.eE]*?(?:{_LONG_NUMBER})){NUMBER})(?=[ \t\n\r]*+[,}}])", f"$1{_MARK}$2{_MARK}"
    )
    unmarked = F.replace(marked, F.lit(_MARK * 2), F.lit(""))
    escaped = _ESCAPED_MARK.replace("\\", "\\\\")
    return F.regexp_replace(unmarked, f"{_MARK}([^{_MARK}]*+){_MARK}", f'"{escaped}$1{escaped}"')


def is_broken(text: Column) -> Column:
    """The text of a flat record is malformed.

    The parser throws on its way through every long integer, so those are parsed as strings.
    """
    value = F.when(text.rlike(_LONG_VALUE), parse_json(_long_numbers_marked(text))).otherwise(parse_json(text))
    return value.isNull()


def _long_numbers_bare(json: Column) -> Column:
    """The text of a marked record with the literals of its long numbers as they were written."""
    escaped = _ESCAPED_MARK.replace("\\", "\\\\")
    bare = F.regexp_replace(json, rf'"{escaped}([-+.0-9eE]++){escaped}"', "$1")
    return F.replace(bare, F.lit(_ESCAPED_MARK * 2), F.lit(_ESCAPED_MARK))


def sorted_json(v: Column, text: Column) -> Column:
    """JSON text of a flat object variant, keys in UTF-8 byte order, types kept.

    A variant keeps its keys in UTF-16 order, which differs from byte order only
    for characters beyond U+FFFF; such records are put together key by key. It holds
    numbers of up to 38 digits; longer ones pass as strings and are written as they were.
    """
    # Digits within strings are no numbers; strings are taken out only where a number may be long.
    bare = F.regexp_replace(text, STRING, '""')
    long_number = text.rlike(_LONG_VALUE) & bare.rlike(_LONG_NUMBER)
    # Such characters take more than a byte or an escape; most records have neither.
    beyond_bmp = (F.octet_length(text) > F.length(text)) | (F.instr(text, "\\u") > 0)
    beyond_bmp &= text.rlike(r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]")

    def fields(rec: Column) -> Column:
        def field(k: Column) -> Column:
            key = F.regexp_extract(F.to_json(F.create_map(k, F.lit(0))), r"(?s)^\{(.*):0\}$", 1)
            return F.concat(key, F.lit(":"), F.to_json(F.element_at(rec, k)))

        return F.transform(F.array_sort(F.map_keys(rec)), field)

    def render(value: Column) -> Column:
        listed = F.array_join(let(value.cast("map<string,variant>"), fields), ",")
        return F.when(beyond_bmp, F.concat(F.lit("{"), listed, F.lit("}"))).otherwise(F.to_json(value))

    kept = _long_numbers_bare(render(parse_json(_long_numbers_marked(text))))
    return F.when(long_number, kept).otherwise(render(v))


def pretty(object_text: Column) -> Column:
    """Spread a compact flat object over lines, one field per line."""
    spread = F.regexp_replace(
        object_text, rf"({STRING}):({STRING}|[^,}}]++)(,?+)", "\n    $1 : $2$3"
    )
    return F.when(object_text == "{}", F.lit("  { }")).otherwise(
        F.concat(F.lit("  "), F.regexp_replace(spread, r"\}$", "\n  }"))
    )
