"""CSV folders as records: checks per file, then a scan that splits wherever it can."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.text import count_of, is_blank
from ..operators.header import bind, bind_arrays, bind_json, blank_text, fields_of_row, header_names
from ..operators.numbering import number_rows, row_blocks, row_counts, running_sum
from ..session import broadcast_if_small, materialise, pin_splits
from .files import Paths, file_rejects, list_files, paths_of, text_pieces
from .stitch import acting_lines, ended, line_runs, stitch_lines

CSV_READ = {
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "maxCharsPerColumn": "-1",
    "maxColumns": "1000000",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "columnNameOfCorruptRecord": "_ragged",
}

# Files whose lines are records are scanned by the width of their header, so that one wide file
# does not widen the rows of all others. Beyond `COLUMNS` names, or where a line has more
# fields than the reader takes, files are stitched and their records cut to arrays.
LINES, WIDE_LINES, STITCH = "lines", "wide lines", "stitch"
NARROW, COLUMNS, READER_FIELDS = 64, 2_000, 1_000_000

# A field is quoted if it begins with a quote; text after its closing quote, and
# quotes in other fields, are data.
_QUOTED = r'"(?:[^"]++|"")*+'
_FIELD = rf'(?:{_QUOTED}"[^,]*+|[^",][^,]*+|)'
_OPENS = rf"^(?:{_FIELD},)*+{_QUOTED}$"
_TO_CLOSING_QUOTE = r'^(?:[^"]++|"")*+"[^,]*+'
# The bits of monotonically_increasing_id that count the rows of a task.
_ROW_OF_TASK = (1 << 33) - 1
# Lines of control characters, which Spark's reader takes for empty.
_READ_AS_EMPTY = r"^[\x00-\x20]*+$"


def _crowded(row: Column) -> Column:
    """The row has more fields than the reader takes. Short rows are not counted."""
    return (F.length(row) >= READER_FIELDS) & (F.regexp_count(row, F.lit(",")) >= READER_FIELDS)


@dataclass
class CsvScan:
    """``records``: src_file, split_start, ord, [rec_no], rec. ``files``: one verdict per file.

    ``counts`` has the number of records per file when they are numbered.
    """

    records: DataFrame
    files: DataFrame
    rejects: DataFrame
    counts: DataFrame


def _lines(spark: SparkSession, paths: Paths, keep_crlf: bool = False) -> DataFrame:
    """Lines as ``line`` with the break after it as ``sep``: LF, CRLF or a lone CR.

    ``opens`` tells whether a line that begins a record ends inside quotes, ``stays``
    whether one that begins inside quotes does.
    """
    piece = F.col("piece")
    body = F.regexp_replace(piece, "\r$", "")
    parts = F.when(F.instr(body, "\r") > 0, F.split(body, "\r", -1)).otherwise(F.array(body))
    rows = text_pieces(spark, paths, "\n").withColumn("parts", parts)
    rows = rows.select("*", F.posexplode("parts").alias("sub", "line"))
    end = F.when(piece.endswith("\r") & F.lit(keep_crlf), "\r\n").otherwise("\n")
    line = F.col("line")
    has_quote = F.instr(line, '"') > 0
    after = F.regexp_replace(line, _TO_CLOSING_QUOTE, "x")
    closes = line.rlike(_TO_CLOSING_QUOTE)
    return rows.select(
        "src_file", "split_start", "split_len", "file_size", "ord", "sub", "line",
        # Asked of the bytes as read; functions of text may replace bad ones.
        F.is_valid_utf8(piece).alias("valid"),
        F.when(F.col("sub") < F.size("parts") - 1, "\r").otherwise(end).alias("sep"),
        (has_quote & line.rlike(_OPENS)).alias("opens"),
        (~has_quote | ~closes | after.rlike(_OPENS)).alias("stays"),
        (~is_blank(line)).alias("filled"),
    )


def inspect_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per file: header names, how to scan it, and the error that rules it out."""
    return scan_csv(spark, paths).files


def _inspect(spark: SparkSession, paths: Paths) -> DataFrame:
    return _inspect_splits(spark, paths)[0]


def _inspect_splits(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Verdicts by one splittable pass with map-side sums; only one row per file split is
    shuffled. Files to stitch get their names later. The second result has what the lines of
    every split do to quotes, which stitching needs."""
    line = F.col("line")
    lines = _lines(spark, paths).select(
        "src_file", "split_start", "split_len", "file_size", "line", "ord", "sub", "opens", "stays",
        F.when(F.instr(line, '"') > 0, count_of(line, '"')).otherwise(0).alias("quotes"),
        F.when(~F.col("valid"), errors.NOT_UTF8).alias("fault"),
        "filled",
        ((line < "!") & line.rlike(_READ_AS_EMPTY) & F.col("filled")).alias("misread"),
        _crowded(line).alias("crowded"),
    )
    # A number of one type keeps Spark on hash aggregation. A split lies in one task, of which
    # the upper bits of `ord` are the number; the rest places the line within it.
    place = F.shiftleft(F.col("ord").bitwiseAND(F.lit(_ROW_OF_TASK)), 30) + F.col("sub")
    per_split = lines.groupBy("src_file", "split_start", "split_len").agg(
        F.max("file_size").alias("file_size"),
        F.sum("quotes").alias("quotes"),
        F.max("opens").alias("opens"),
        F.max("misread").alias("misread"),
        F.max("crowded").alias("crowded"),
        F.min(place).alias("first"),
        F.min(F.when(F.col("filled"), place)).alias("first_filled"),
        F.min_by(line, F.when(F.col("filled"), place)).alias("first_line"),
        # A collecting aggregate also keeps Spark on hash aggregation, which
        # min_by over text alone would turn into a sort of all lines.
        F.collect_set("fault").alias("faults"),
        acting_lines().alias("acting"),
    )
    per_split = materialise(per_split.withColumn("run", line_runs(F.col("acting"))).drop("acting"), "csv-splits")
    split = F.when(F.col("first_line").isNotNull(), F.col("split_start"))
    per_file = per_split.groupBy("src_file").agg(
        F.max("file_size").alias("file_size"),
        F.sum("quotes").alias("quotes"),
        F.max("opens").alias("opens"),
        F.max("misread").alias("misread"),
        F.max("crowded").alias("crowded"),
        F.min_by("first_line", split).alias("first_line"),
        F.min_by(F.col("first") == F.col("first_filled"), "split_start").alias("first_is_header"),
        F.flatten(F.collect_list("faults")).alias("faults"),
    )
    error = (
        F.when(F.size("faults") > 0, errors.NOT_UTF8)
        .when(F.col("quotes") % 2 == 1, errors.UNCLOSED_QUOTE)
        .when(F.col("first_line").isNull(), errors.EMPTY_CSV)
    )
    plain = ~F.col("opens") & ~F.col("misread") & ~F.col("crowded") & F.coalesce("first_is_header", F.lit(False))
    names = F.when(error.isNull() & plain, header_names(F.col("first_line")))
    width = F.size("names")
    route = F.when(width.between(0, NARROW), LINES).when(width.between(0, COLUMNS), WIDE_LINES).otherwise(STITCH)
    files = materialise(
        list_files(spark, paths)
        .join(per_file, "src_file", "left")
        .select(
            "src_file",
            F.coalesce("file_size", F.lit(0)).alias("file_size"),
            error.alias("error"),
            names.alias("names"),
        )
        .select("src_file", "file_size", "error", route.alias("route"), "names"),
        "csv-files",
    )
    return files, per_split.select("src_file", "split_start", "split_len", "run")


def scan_csv(
    spark: SparkSession,
    paths: Paths,
    *,
    numbered: bool = False,
    keep_crlf: bool = False,
    as_json: bool = False,
) -> CsvScan:
    """Records of every valid CSV file, bound to the file's own header.

    ``records`` have their text map ``rec`` or, with ``as_json``, its ``json`` text.
    Files whose lines are records are read by Spark's CSV reader. In all others the
    lines are stitched to records, by the same rules and at every size. A CRLF inside
    quotes becomes LF unless ``keep_crlf``.
    """
    pin_splits(spark)
    files, runs = _inspect_splits(spark, paths)
    fates = _fates(files)

    def of_route(files: DataFrame, route: str) -> Paths:
        good = files.filter(F.col("error").isNull() & (F.col("route") == route))
        return paths if len(fates) == 1 else paths_of(good)

    stitched, too_long = None, None
    if STITCH in fates:
        # Other paths may be cut into other splits.
        known = runs if len(fates) == 1 else None
        stitched, too_long, heads = _stitched(spark, of_route(files, STITCH), keep_crlf, fates[STITCH].largest, known)
        found = heads.withColumnRenamed("names", "stitched_names").withColumnRenamed("error", "stitched_error")
        files = files.join(found.drop("header_no", "crowded"), "src_file", "left").select(
            "src_file",
            "file_size",
            F.coalesce("error", "stitched_error").alias("error"),
            "route",
            F.coalesce("names", "stitched_names").alias("names"),
        )
        files = materialise(files, "csv-verdicts")
        fates = _fates(files)
    good = files.filter(F.col("error").isNull())
    headers = [h for f in fates.values() if f.names_min is not None for h in (f.names_min, f.names_max)]
    shared = headers[0] if headers and len(headers[0]) <= COLUMNS and all(h == headers[0] for h in headers) else None

    order = ["src_file", "split_start", "ord", *(["rec_no"] if numbered else [])]
    scans = []
    counts = spark.createDataFrame([], "src_file string, n_records bigint")
    for route in (LINES, WIDE_LINES):
        if route not in fates:
            continue
        width = fates[route].width
        reader = spark.read.options(**CSV_READ)
        rows = reader.csv(of_route(files, route), schema=_ddl(width), header=True).select(
            F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.spark_partition_id().alias("task"),
            *_cells(width),
            "_ragged",
        )
        rows = _filled(rows, width).withColumn("ord", F.monotonically_increasing_id())
        if numbered:
            blocks = row_blocks(rows)
            rows = number_rows(rows, blocks)
            counts = counts.unionByName(row_counts(blocks))
        rows = rows.select(*order, *_names_of_cells(width))
        scans.append((bind_json if as_json else bind)(rows, width, good, shared))
    if stitched is not None and STITCH in fates:
        sound = heads.filter(F.col("error").isNull())
        wide = F.col("crowded") | (F.size("names") > COLUMNS)
        widths = {r.wide: r.width for r in sound.groupBy(wide.alias("wide")).agg(F.max(F.size("names")).alias("width")).collect()}
        for is_wide, width in widths.items():
            own = sound.filter(wide if is_wide else ~wide).select("src_file", "header_no")
            rows = _stitched_rows(stitched, own, None if is_wide else width)
            if numbered:
                counts = counts.unionByName(
                    rows.groupBy("src_file").agg(F.count("*").alias("n_records"))
                )
                rows = running_sum(rows, "ord", F.lit(1), "rec_no")
            if is_wide:
                rows = bind_arrays(rows.select(*order, "fields"), good)
                scans.append(rows.withColumn("json", F.to_json("rec")).drop("rec") if as_json else rows)
            else:
                rows = rows.select(*order, *_names_of_cells(width))
                scans.append((bind_json if as_json else bind)(rows, width, good, shared))

    if scans:
        records = scans[0]
        for more in scans[1:]:
            records = records.unionByName(more)
    else:
        empty = "src_file string, split_start bigint, ord bigint, rec_no bigint, "
        empty += "json string" if as_json else "rec map<string,string>"
        records = spark.createDataFrame([], empty)
    rejects = file_rejects(files)
    if too_long is not None:
        rejects = rejects.unionByName(too_long)
    return CsvScan(records, files, rejects, counts)


def _fates(files: DataFrame) -> dict[str, Row]:
    """Per route or error: columns and the extremes of the headers."""
    return {
        r.fate: r
        for r in files.groupBy(F.coalesce("error", "route").alias("fate"))
        .agg(
            F.max("file_size").alias("largest"),
            F.max(F.size("names")).alias("width"),
            F.min("names").alias("names_min"),
            F.max("names").alias("names_max"),
        )
        .collect()
    }


def _ddl(width: int) -> str:
    return ", ".join([*(f"_c{i} string" for i in range(width)), "_ragged string"])


def _names_of_cells(width: int) -> list[str]:
    return [f"_c{i}" for i in range(width)]


def _cells(width: int, row: str = "") -> list[Column]:
    return [F.coalesce(F.col(f"{row}{c}"), F.lit("")).alias(c) for c in _names_of_cells(width)]


def _filled(rows: DataFrame, width: int) -> DataFrame:
    """Drop rows whose cells are all blank, cells beyond the header included."""
    cells = [F.col(c) for c in _names_of_cells(width)]
    if width <= 64:  # stays in generated code, and mostly ends at the first cell
        filled = reduce(lambda a, b: a | b, [~is_blank(c) for c in cells])
    else:
        filled = F.exists(F.array(*cells), lambda v: ~is_blank(v))
    more = F.col("_ragged").isNotNull() & ~blank_text(F.col("_ragged"))
    return rows.filter(filled | more).drop("_ragged")


def _stitched(
    spark: SparkSession, paths: Paths, keep_crlf: bool, largest_file: int, runs: DataFrame | None
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Records that are not blank, with the break behind them; rejects of records too long, and
    the header of each file."""
    records, too_long, unclosed = stitch_lines(_lines(spark, paths, keep_crlf), largest_file, runs)
    records = records.filter("filled").drop("filled")
    # Only numbers are aggregated; an aggregate of texts would sort all records.
    firsts = records.groupBy("src_file").agg(F.min("rec_no").alias("rec_no"), F.max(_crowded(F.col("text"))).alias("crowded"))
    firsts = materialise(firsts, "first-records")
    heads = records.join(broadcast_if_small(firsts), ["src_file", "rec_no"]).select(
        "src_file", F.col("rec_no").alias("header_no"), "crowded", ended(F.col("text")).alias("header")
    )
    heads = unclosed.join(heads, "src_file", "left").select(
        "src_file",
        "header_no",
        "crowded",
        header_names(F.col("header")).alias("names"),
        F.when(F.col("unclosed"), errors.UNCLOSED_QUOTE).when(F.col("header").isNull(), errors.EMPTY_CSV).alias("error"),
    )
    heads = materialise(heads, "csv-headers")
    if too_long is None:
        return records, None, heads
    after = F.col("rec_no") - F.coalesce("header_no", F.lit(0))
    rejects = too_long.join(heads, "src_file", "left").filter(F.col("error").isNull()).select(
        "src_file",
        after.alias("rec_no"),
        F.lit(errors.INVALID_INPUT).alias("error_kind"),
        errors.message(errors.LONG_RECORD).alias("error_msg"),
    )
    return records, rejects, heads


def _stitched_rows(records: DataFrame, heads: DataFrame, width: int | None) -> DataFrame:
    """Cells of the records after the header, or without a width their ``fields`` as an array."""
    body = records.join(broadcast_if_small(heads), "src_file").filter(F.col("rec_no") > F.col("header_no"))
    place = ["src_file", F.lit(0).cast("bigint").alias("split_start"), F.col("rec_no").alias("ord")]
    if width is None:
        rows = body.select(*place, fields_of_row(ended(F.col("text"))).alias("fields"))
        return rows.filter(F.exists("fields", lambda v: ~is_blank(v)))
    options = {**CSV_READ, "multiLine": "true", "lineSep": "\n"}
    rows = body.withColumn("row", F.from_csv(ended(F.col("text")), _ddl(width), options)).select(
        *place, *_cells(width, "row."), F.col("row._ragged").alias("_ragged")
    )
    return _filled(rows, width)
