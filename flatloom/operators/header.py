"""Header rules of CSV files: names, positional binding, blank rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import let
from ..functions.text import WHITESPACE, trim_whitespace
from ..session import broadcast_if_small

_NAME = r'(?s),("(?:[^"]++|"")*+"(?=,|$)|[^,]*+)'
# Quoted first: a possessive loop does not come back to try the other form.
_BLANK = rf'(?:"{WHITESPACE}*+"|{WHITESPACE}*+)'


def header_names(text: Column) -> Column:
    """Trimmed names of a header record, as an array in file order."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_NAME), F.lit(1))

    def unquote(n: Column) -> Column:
        inner = F.regexp_replace(n, '(?s)^"(.*)"$', "$1")
        quoted = n.startswith('"') & n.endswith('"') & (F.length(n) > 1)
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(n)

    return F.transform(raw, lambda n: trim_whitespace(unquote(n)))


_VALUE = r'(?s),("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'
_IN_QUOTES = r'(?s)^"(?:[^"]++|"")*+"'


def fields_of_row(row: Column) -> Column:
    """All fields of a CSV row as an array, by the rules of the reader, however many there are."""

    def value(raw: Column) -> Column:
        quoted = F.regexp_extract(raw, _IN_QUOTES, 0)
        inner = F.replace(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit('""'), F.lit('"'))
        # Text behind the closing quote makes all of it data.
        more = raw.substr(F.length(quoted) + 1, F.length(raw))
        return (
            F.when(~raw.startswith('"') | (quoted == ""), raw)
            .when(quoted == raw, inner)
            .otherwise(F.concat(F.lit('"'), inner, F.lit('"'), more))
        )

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(_VALUE), F.lit(1)), value)


def blank_text(row: Column) -> Column:
    """Every field of the raw CSV row is blank."""
    return row.rlike(rf"^{_BLANK}(?:,{_BLANK})*+$")


def record_keys(names: Column) -> Column:
    """Distinct names in UTF-8 byte order."""
    return F.array_sort(F.array_distinct(names))


def last_positions(names: Column) -> Column:
    """For each record key, the 0-based position of its last column: the last one wins.

    Sorted by name and position, so that wide headers take no search per key.
    """
    places = F.array_sort(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at"))))

    def lasts(sorted_places: Column) -> Column:
        later = lambda i: F.get(sorted_places, i + 1)["name"]
        ends = F.filter(sorted_places, lambda p, i: later(i).isNull() | (later(i) != p["name"]))
        return F.transform(ends, lambda p: p["at"])

    return let(places, lasts)


def bind_fields(keys: Column, positions: Column, fields: Column) -> Column:
    """Map key -> field text; a missing trailing field is '', extra fields are dropped."""
    return F.map_from_arrays(
        keys, F.transform(positions, lambda i: F.coalesce(F.get(fields, i), F.lit("")))
    )


def _shared_cells(names: list[str]) -> list[tuple[str, Column]]:
    """Keys of a header that all files share, in byte order, with the cell each one takes."""
    last = {name: i for i, name in enumerate(names)}
    return [(k, F.col(f"_c{last[k]}")) for k in sorted(last, key=lambda k: k.encode())]


def bind(
    rows: DataFrame, width: int, files: DataFrame, shared: list[str] | None = None
) -> DataFrame:
    """Replace the cells ``_c0, _c1, ..`` by ``rec``, using the names of the row's own file.

    ``files`` has ``src_file`` and ``names``. A header ``shared`` by all files is a
    constant, and the rows are neither joined nor shuffled.
    """
    cells = [f"_c{i}" for i in range(width)]
    others = [c for c in rows.columns if c not in cells]
    if shared is not None:
        pairs = _shared_cells(shared)
        rec = F.map_from_arrays(
            F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[c for _, c in pairs])
        )
        return rows.select(*others, rec.alias("rec"))
    return bind_arrays(rows.select(*others, F.array(*cells).alias("fields")), files)


def bind_arrays(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Replace the array ``fields`` by ``rec``, using the names of the row's own file."""
    others = [c for c in rows.columns if c != "fields"]
    headers = files.select(
        "src_file",
        record_keys(F.col("names")).alias("keys"),
        last_positions(F.col("names")).alias("positions"),
    )
    return rows.join(broadcast_if_small(headers), "src_file").select(
        *others, bind_fields(F.col("keys"), F.col("positions"), F.col("fields")).alias("rec")
    )


def bind_json(
    rows: DataFrame, width: int, files: DataFrame, shared: list[str] | None = None
) -> DataFrame:
    """Like ``bind``, straight to JSON text; a struct renders faster than a map."""
    if shared is None:
        return bind(rows, width, files).withColumn("json", F.to_json("rec")).drop("rec")
    others = [c for c in rows.columns if not c.startswith("_c")]
    record = F.struct(*[c.alias(k) for k, c in _shared_cells(shared)])
    return rows.select(*others, F.to_json(record).alias("json"))
