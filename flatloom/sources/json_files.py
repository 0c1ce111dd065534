"""JSON folders as record texts: one flat object, or an array of them, per file.

A flat object ends at its first closing brace outside a string. So the files are
read as text cut at closing braces, which splits any file, also one huge array on
a single line. A file whose pieces all have the outline of flat objects needs no
more than that ("pieces"). Otherwise braces occur in strings or values are nested:
a file of moderate size with flat records only is cut by one task ("whole"), all
others have their pieces stitched to array elements ("stitch").
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.json import (
    FLAT_BODY,
    FLAT_OBJECT,
    WS,
    fields_of,
    is_broken,
    is_flat_object,
    is_nested,
    is_object,
    json_trim,
    lead_char,
    let,
    nested_keys,
    parse_strict,
)
from ..functions.text import count_of
from ..operators.numbering import number_rows, row_blocks, row_counts, running_sum
from ..session import broadcast_if_small, configure, materialise
from . import stitch as stitching
from .files import Paths, file_rejects, list_files, paths_of, text_pieces
from .stitch import stitch

# A file with braces in strings is read as one text up to this size.
WHOLE_FILE_LIMIT = 32 << 20

PIECES, WHOLE, STITCH = "pieces", "whole", "stitch"

_FIRST_OR_NEXT = rf"^{WS}[\[,]?+{WS}\{{{FLAT_BODY}$"
_LIST = rf"{FLAT_OBJECT}{WS}(?:,{WS}{FLAT_OBJECT}{WS})*+"
_FLAT_DOCUMENT = rf"^{WS}(?:{FLAT_OBJECT}|\[{WS}(?:{_LIST})?+\]){WS}$"
_BYTE_ORDER_MARK = 3  # bytes, dropped by the text scan


@dataclass
class JsonScan:
    """``records``: src_file, split_start, ord, [rec_no], text of one flat object.

    ``files`` holds one verdict per file, whether it is an array, and its numbers
    of records and of records with at least one key. ``firsts`` gives the first
    record kept per file where that may not be number 1.
    """

    records: DataFrame
    files: DataFrame
    rejects: DataFrame
    firsts: DataFrame


def _unescaped_quotes(piece: Column) -> Column:
    plain = F.when(F.instr(piece, "\\") > 0, F.regexp_replace(piece, r"(?s)\\.", "")).otherwise(piece)
    return count_of(plain, '"')


def _object_text(piece: Column) -> Column:
    return F.concat(F.substring(piece, F.instr(piece, "{"), F.length(piece)), F.lit("}"))


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("int"))


def _outline(piece: Column, order: Column) -> list[Column]:
    """Sums over pieces that tell whether they make up one flat document."""
    lead = lead_char(piece)
    shaped = piece.rlike(_FIRST_OR_NEXT)
    # Only a piece that begins so is looked at to its end.
    end = (lead == "]") & (F.btrim(piece, F.lit(" \t\n\r")) == "]")
    tail = (lead == "") | end
    return [
        _count(~shaped & ~tail).alias("odd_shape"),
        _count(shaped & (lead == "[")).alias("array_starts"),
        _count(shaped & (lead == "{")).alias("object_starts"),
        _count(shaped).alias("n_records"),
        _count(shaped & ~piece.rlike(r"\{[ \t\n\r]*+$")).alias("n_nonempty"),
        _count(shaped & is_broken(_object_text(piece))).alias("malformed"),
        _count(tail).alias("tails"),
        _count(end).alias("array_ends"),
        F.min(F.when(shaped & (lead != ","), order)).alias("start_ord"),
        F.max(F.when(tail, order)).alias("tail_ord"),
        F.min(order).alias("min_ord"),
        F.max(order).alias("max_ord"),
    ]


_OUTLINE_SUMS = ["odd_shape", "array_starts", "object_starts", "n_records", "n_nonempty"]
_OUTLINE_SUMS += ["malformed", "tails", "array_ends"]


def _is_flat_document(starts_first: Column, tail_last: Column) -> Column:
    """The outline is that of one flat object or one array of them, and nothing else."""
    one_tail = (F.col("tails") == 1) & tail_last & ~F.col("terminated")
    whole_object = (
        (F.col("object_starts") == 1)
        & (F.col("n_records") == 1)
        & (F.col("array_ends") == 0)
        & (((F.col("tails") == 0) & F.col("terminated")) | one_tail)
    )
    whole_array = (
        (F.col("array_starts") == 1)
        & (F.col("object_starts") == 0)
        & (F.col("array_ends") == 1)
        & one_tail
    )
    flat = (F.col("odd_shape") == 0) & starts_first & (whole_object | whole_array)
    return F.coalesce(flat, F.lit(False))


def inspect_json(
    spark: SparkSession, paths: Paths, whole_file_limit: int = WHOLE_FILE_LIMIT
) -> DataFrame:
    """One row per file: how to scan it, or the error that rules it out.

    One splittable pass that keeps fixed-size sums per file split.
    """
    piece = F.col("piece")
    per_split = (
        text_pieces(spark, paths, "}")
        .groupBy("src_file", "split_start")
        .agg(
            F.max("file_size").alias("file_size"),
            F.sum(F.octet_length(piece) + 1).alias("bytes"),
            _count(~F.is_valid_utf8(piece)).alias("not_utf8"),
            F.sum(_unescaped_quotes(piece)).alias("quotes"),
            *_outline(piece, F.col("ord")),
        )
    )
    per_file = per_split.groupBy("src_file").agg(
        F.max("file_size").alias("file_size"),
        *[F.sum(c).alias(c) for c in ["bytes", "not_utf8", "quotes", *_OUTLINE_SUMS]],
        F.min_by(F.col("start_ord") == F.col("min_ord"), "split_start").alias("starts_first"),
        F.max_by(F.col("tail_ord") == F.col("max_ord"), "split_start").alias("tail_last"),
    )
    # The scan gives one piece for '{"a":1}' and for '{"a":1'; the size tells them apart.
    beyond = F.col("file_size") - F.col("bytes")
    flat = _is_flat_document(F.col("starts_first"), F.col("tail_last"))
    return (
        list_files(spark, paths)
        .join(
            per_file.withColumn("terminated", beyond.isin(0, _BYTE_ORDER_MARK)), "src_file", "left"
        )
        .select(
            "src_file",
            F.when(F.col("bytes").isNull(), errors.MALFORMED_JSON)
            .when(F.col("not_utf8") > 0, errors.NOT_UTF8)
            .when(F.col("quotes") % 2 == 1, errors.MALFORMED_JSON)
            .when(flat & (F.col("malformed") > 0), errors.MALFORMED_JSON)
            .alias("error"),
            F.when(flat, PIECES)
            .when(F.col("file_size") <= whole_file_limit, WHOLE)
            .otherwise(STITCH)
            .alias("route"),
            F.coalesce("file_size", F.lit(0)).alias("file_size"),
            "terminated",
            (F.col("array_starts") == 1).alias("is_array"),
            "n_records",
            "n_nonempty",
        )
    )


def _whole_texts(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per file with its text and the texts of its flat objects."""
    text = F.regexp_replace("value", "^\ufeff", "")
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("src_file"),
        text.alias("document"),
        F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0)).alias("texts"),
    )


def _inspect_whole(spark: SparkSession, paths: Paths) -> DataFrame:
    """Verdicts on files read as one text; ``flat`` where that is enough to scan them."""
    document = F.col("document")
    broken = F.exists("texts", is_broken)
    return materialise(
        _whole_texts(spark, paths)
        .withColumn("flat", document.rlike(_FLAT_DOCUMENT))
        .select(
            "src_file",
            "flat",
            F.when(F.col("flat") & broken, errors.MALFORMED_JSON).alias("error"),
            (lead_char(document) == "[").alias("is_array"),
            F.size("texts").cast("bigint").alias("n_records"),
            F.size(F.filter("texts", lambda t: ~t.rlike(rf"^\{{{WS}\}}$")))
            .cast("bigint")
            .alias("n_nonempty"),
        ),
        "json-whole",
    )


_VERDICT = ["src_file", "error", "is_array", "n_records", "n_nonempty"]


def scan_json(
    spark: SparkSession,
    paths: Paths,
    *,
    numbered: bool = False,
    whole_file_limit: int = WHOLE_FILE_LIMIT,
    max_record_bytes: int | None = None,
) -> JsonScan:
    """Texts of all flat records; everything else becomes a reject.

    Of files that are stitched, elements of more than ``max_record_bytes`` are rejected unparsed,
    one by one; the other elements of their file come out with the numbers they have there.
    """
    configure(spark)
    files = materialise(inspect_json(spark, paths, whole_file_limit), "json-files")
    fate = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("route"))
    fates = {r.fate for r in files.select(fate.alias("fate")).distinct().collect()}
    limit = stitching.MAX_RECORD_BYTES if max_record_bytes is None else max_record_bytes
    good = files.filter(F.col("error").isNull())
    columns = ["src_file", "split_start", "ord", *(["rec_no"] if numbered else []), "text"]

    def of_route(route: str) -> Paths:
        return paths if fates == {route} else paths_of(good.filter(F.col("route") == route))

    verdicts = files.filter((F.col("error").isNotNull()) | (F.col("route") == PIECES)).select(
        *_VERDICT
    )
    scans, rejects = [], []
    firsts = spark.createDataFrame([], "src_file string, first_no bigint")
    if PIECES in fates:
        rows = (
            text_pieces(spark, of_route(PIECES), "}")
            .filter(F.instr("piece", "{") > 0)
            .withColumn("ord", F.monotonically_increasing_id())
            .withColumn("text", _object_text(F.col("piece")))
        )
        scans.append((number_rows(rows, row_blocks(rows)) if numbered else rows).select(*columns))
    to_stitch: Paths = of_route(STITCH) if STITCH in fates else []
    if WHOLE in fates:
        candidates = of_route(WHOLE)
        seen = _inspect_whole(spark, candidates)
        verdicts = verdicts.unionByName(seen.filter("flat").select(*_VERDICT))
        if seen.filter("not flat or error is not null").isEmpty():
            knotty, flat = [], candidates
        else:
            knotty = paths_of(seen.filter("not flat"))
            flat = paths_of(seen.filter("flat and error is null"))
        to_stitch = knotty + ([to_stitch] if isinstance(to_stitch, str) else to_stitch)
        if flat:
            rows = _whole_texts(spark, flat).select(
                "src_file", F.posexplode("texts").alias("pos", "text")
            )
            number = (F.col("pos") + 1).cast("bigint")
            scans.append(
                rows.select(
                    "src_file",
                    F.lit(0).cast("bigint").alias("split_start"),
                    number.alias("ord"),
                    number.alias("rec_no"),
                    "text",
                ).select(*columns)
            )
    if to_stitch:
        rows, bad, checked = _stitched(spark, to_stitch, good, limit)
        scans.append(rows.select(*columns))
        rejects.append(bad)
        firsts = rows.groupBy("src_file").agg(F.min("rec_no").alias("first_no"))
        verdicts = verdicts.unionByName(checked)

    empty = "src_file string, split_start bigint, ord bigint, rec_no bigint, text string"
    records = spark.createDataFrame([], empty).select(*columns)
    if scans:
        records = scans[0]
        for more in scans[1:]:
            records = records.unionByName(more)
    all_rejects = file_rejects(verdicts)
    for more in rejects:
        all_rejects = all_rejects.unionByName(more)
    return JsonScan(records, verdicts, all_rejects, firsts)


def _no_strings(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"?+', "")


def _brackets(text: Column) -> Column:
    """Brackets outside strings that a text opens, less those it closes."""
    bare = _no_strings(text)
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))


def _stand_in(head: Column, end: Column) -> Column:
    """What is left of a segment too long: how it begins, and whether it ends with a bracket."""
    begins = F.regexp_extract(head, rf"^{WS}[\[,]?+{WS}\{{?+", 0)
    return F.concat(begins, F.when(end.rlike(rf"\]{WS}$"), "]").otherwise(""))


def _stitched(
    spark: SparkSession, paths: Paths, files: DataFrame, limit: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, rejects and file verdicts of files that are not plain flat pieces.

    The segments between closing braces outside strings are the records already
    when values are flat; only files where they are not need the bracket depth.
    """
    pieces = text_pieces(spark, paths, "}")
    segments = stitch(
        pieces, _unescaped_quotes(F.col("piece")), "}", limit, _stand_in, _brackets
    )
    segments = materialise(segments, "json-segments")
    outline = segments.groupBy("src_file").agg(
        *_outline(F.col("text"), F.col("rec_no")),
        F.max("rec_no").alias("last_no"),
        F.max(F.when(F.col("rec_no") == 1, lead_char(F.col("text")))).alias("opening"),
    )
    outline = outline.join(broadcast_if_small(files.select("src_file", "terminated")), "src_file")
    flat = _is_flat_document(
        F.col("start_ord") == F.col("min_ord"), F.col("tail_ord") == F.col("max_ord")
    )
    outline = materialise(
        outline.withColumn("flat", flat).withColumn(
            "error", F.when(F.col("flat") & (F.col("malformed") > 0), errors.MALFORMED_JSON)
        ),
        "json-outline",
    )
    verdicts = (
        outline.filter("flat")
        .withColumn("is_array", F.col("array_starts") == 1)
        .select(*_VERDICT)
    )
    sound = outline.filter(F.col("flat") & F.col("error").isNull()).select("src_file")
    objects = segments.filter(F.instr("text", "{") > 0).join(
        broadcast_if_small(sound), "src_file", "left_semi"
    )
    rejects = objects.filter(F.col("long_size").isNotNull()).select(
        "src_file", "rec_no", *_long_error()
    )
    records = (
        objects.filter(F.col("long_size").isNull())
        .select(
            "src_file",
            F.lit(0).cast("bigint").alias("split_start"),
            F.col("rec_no").alias("ord"),
            "rec_no",
            _object_text(F.col("text")).alias("text"),
        )
    )
    deep = outline.filter("not flat")
    if deep.isEmpty():
        return records, rejects, verdicts
    more, bad, checked = _nested(
        segments, deep.select("src_file", "last_no", "opening", "terminated"), limit
    )
    return records.unionByName(more), rejects.unionByName(bad), verdicts.unionByName(checked)


def _nested(
    segments: DataFrame, outline: DataFrame, limit: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Array elements by bracket depth: records, rejects and verdicts."""
    base = F.when(F.col("opening") == "[", 1).otherwise(0)
    segments = segments.join(broadcast_if_small(outline.withColumn("base", base)), "src_file").withColumn(
        "is_tail", (F.col("rec_no") == F.col("last_no")) & ~F.col("terminated")
    )

    # Depth of brackets outside strings after each segment. The sums run over
    # numbers only; the texts are joined to their element afterwards.
    # The separator itself closes a bracket, except after the tail.
    opened = F.coalesce("long_weight", _brackets(F.col("text")).cast("bigint"))
    delta = opened - (~F.col("is_tail")).cast("int")
    marks = materialise(
        segments.select(
            "src_file",
            "rec_no",
            "base",
            "is_tail",
            delta.alias("delta"),
            F.coalesce("long_size", F.octet_length("text").cast("bigint")).alias("size"),
        ),
        "json-brackets",
    )
    deep = running_sum(marks, "rec_no", F.col("delta"), "depth").withColumn(
        "ends", (F.col("depth") == F.col("base")) & ~F.col("is_tail")
    )
    placed = running_sum(deep, "rec_no", F.col("ends").cast("int"), "n_ended").select(
        "src_file",
        "rec_no",
        "ends",
        "size",
        F.when(F.col("is_tail"), F.col("depth") == 0).otherwise(F.col("depth") >= F.col("base")).alias("in_depth"),
        (F.col("n_ended") - F.col("ends").cast("int") + 1).alias("elem_no"),
    )
    placed = materialise(placed, "json-places")
    sizes = placed.groupBy("src_file", "elem_no").agg(
        F.sum("size").alias("size"),
        F.min("rec_no").alias("rec_no"),
        F.max("rec_no").alias("end_no"),
        F.max("ends").alias("complete"),
        F.min("in_depth").alias("balanced"),
    )
    long = materialise(sizes.filter(F.col("size") > limit).drop("size"), "long-elements")
    texts = segments.withColumn(
        "text", F.when(F.col("is_tail"), F.col("text")).otherwise(F.concat("text", F.lit("}")))
    ).drop("long_size", "long_weight")
    placed = placed.join(broadcast_if_small(long.select("src_file", "elem_no")), ["src_file", "elem_no"], "left_anti")
    placed = texts.join(placed, ["src_file", "rec_no"])
    elements = placed.groupBy("src_file", "elem_no", "opening", "terminated").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rec_no", "text"))), lambda s: s["text"]
            ),
            "",
        ).alias("text"),
        F.max("is_tail").alias("is_tail"),
        F.max("ends").alias("complete"),
        F.min("in_depth").alias("balanced"),
    )
    rows, too_long = _long_elements(texts, long)
    elements = elements.withColumn("long", F.lit(False)).unionByName(rows)
    elements = materialise(_element_bodies(elements), "json-elements")

    checked = elements.groupBy("src_file").agg(
        F.max("malformed").alias("malformed"),
        F.max("scalar").alias("scalar"),
        F.max("is_array").alias("is_array"),
        F.sum("n_items").alias("n_records"),
        F.sum("n_keys").alias("n_nonempty"),
    )
    verdicts = checked.select(
        "src_file",
        F.when(F.col("malformed"), errors.MALFORMED_JSON)
        .when(F.col("scalar"), errors.NOT_OBJECT_OR_ARRAY)
        .alias("error"),
        "is_array",
        "n_records",
        "n_nonempty",
    )

    # A file that is malformed anyway is just that.
    verdicts = verdicts.join(broadcast_if_small(too_long), "src_file", "left")
    verdicts = verdicts.withColumn("error", F.coalesce("error", "long_error")).select(*_VERDICT)
    verdicts = materialise(verdicts, "json-verdicts")
    sound = verdicts.filter(F.col("error").isNull()).select("src_file")
    sizes = elements.select("src_file", "elem_no", "n_items").join(
        broadcast_if_small(sound), "src_file", "left_semi"
    )
    counted = running_sum(sizes, "elem_no", F.col("n_items"), "n_so_far").drop("n_items")
    items = elements.join(counted, ["src_file", "elem_no"]).select(
        "src_file",
        "n_items",
        "body",
        "long",
        (F.col("n_so_far") - F.col("n_items")).alias("n_before"),
        F.posexplode("items").alias("pos", "item"),
    ).select(
        "src_file",
        (F.col("n_before") + F.col("pos") + 1).alias("rec_no"),
        "long",
        # An object ends its element, so it is the last item and the text at its end.
        F.when(F.col("n_items") == 1, json_trim(F.col("body")))
        .when(F.col("item.is_object"), F.regexp_extract("body", rf"({FLAT_OBJECT}){WS}$", 1))
        .alias("text"),
        "item.is_object",
        "item.nested",
    )
    too_long = items.filter("long").select("src_file", "rec_no", *_long_error())
    items = items.filter("not long")
    records = items.filter(F.col("is_object") & F.col("nested").isNull()).select(
        "src_file",
        F.lit(0).cast("bigint").alias("split_start"),
        F.col("rec_no").alias("ord"),
        "rec_no",
        "text",
    )
    rejects = items.filter(~F.col("is_object") | F.col("nested").isNotNull()).select(
        "src_file", "rec_no", *_record_error(F.col("is_object"), F.col("nested"), F.col("rec_no"))
    )
    return records, rejects.unionByName(too_long), verdicts


def _long_elements(texts: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows like elements, with an empty object in place of each one too long, and the files where
    that is not possible.

    An element that begins with a brace is one object, so it counts as one. So does the rest of
    an array behind its last object. Where other items stand before a long object, they
    cannot be counted without their texts, and the file is rejected.
    """
    ends = long.select("src_file", "elem_no", F.explode(F.array_distinct(F.array("rec_no", "end_no"))).alias("rec_no"))
    ends = texts.join(broadcast_if_small(ends), ["src_file", "rec_no"]).groupBy("src_file", "elem_no", "opening", "terminated").agg(
        F.min_by(F.regexp_extract("text", rf"^({WS}[\[,]?+{WS})(\{{?+)", 1), "rec_no").alias("lead"),
        F.min_by(F.regexp_extract("text", rf"^({WS}[\[,]?+{WS})(\{{?+)", 2), "rec_no").alias("brace"),
        F.max_by(F.when(F.col("is_tail") & F.col("text").rlike(rf"\]{WS}$"), "]").otherwise(""), "rec_no").alias("end"),
        F.max("is_tail").alias("is_tail"),
    )
    found = ends.join(long.drop("rec_no", "end_no"), ["src_file", "elem_no"])
    counted = F.col("is_tail") | (F.col("brace") == "{")
    rows = found.select(
        "src_file",
        "elem_no",
        "opening",
        "terminated",
        F.concat("lead", F.lit("{}"), "end").alias("text"),
        "is_tail",
        "complete",
        "balanced",
        F.lit(True).alias("long"),
    )
    files = found.filter(~counted).select("src_file").distinct()
    return rows, files.withColumn("long_error", F.lit(errors.LONG_RECORD))


def _items(body: Column) -> Column:
    """What the values of a comma-separated list are; null when it is not one."""
    listed = F.concat(F.lit("["), body, F.lit("]"))

    def judged(fields: Column) -> Column:
        hits = F.filter(F.map_entries(fields), lambda e: is_nested(e["value"]))
        return F.struct(
            fields.isNotNull().alias("is_object"),
            F.coalesce(F.size(fields) > 0, F.lit(False)).alias("filled"),
            F.array_min(F.transform(hits, lambda e: e["key"])).alias("nested"),
        )

    values = F.try_variant_get(parse_strict(listed), "$", "array<variant>")
    return F.transform(values, lambda v: let(fields_of(v), judged))


def _element_bodies(elements: DataFrame) -> DataFrame:
    """Strip the array punctuation from each element and check it."""
    is_array, is_object_doc = F.col("opening") == "[", F.col("opening") == "{"
    first, tail = F.col("elem_no") == 1, F.col("is_tail")
    text = F.col("text")

    led = F.when(first, text.rlike(rf"^{WS}\[")).otherwise(
        text.rlike(rf"^{WS},") | (tail & text.rlike(rf"^{WS}\]{WS}$"))
    )
    ended = F.when(tail, text.rlike(rf"\]{WS}$")).otherwise(F.col("complete"))
    inner = F.regexp_replace(text, rf"^{WS}[\[,]", "")
    inner = F.when(tail, F.regexp_replace(inner, rf"\]{WS}$", "")).otherwise(inner)
    body = F.when(is_array, inner).otherwise(text)

    # A closing part such as ',]' promises an item it does not have.
    lacks_item = ~first & tail & text.rlike(rf"^{WS},{WS}\]{WS}$")
    broken_array = ~led | ~ended | lacks_item | (F.col("terminated"))
    broken_object = F.when(tail, text.rlike(r"[^ \t\n\r]") | first).otherwise(
        ~first | ~F.col("complete")
    )
    bodies = elements.withColumn("body", json_trim(body)).withColumn(
        "items", F.when(is_array | is_object_doc, _items(F.col("body")))
    )
    scalar = ~is_array & ~is_object_doc
    scalar_value = first & tail & parse_strict(text).isNotNull()
    n_items = F.coalesce(F.size("items"), F.lit(0))
    filled = F.filter("items", lambda i: i["filled"])
    malformed = (
        F.when(scalar, ~scalar_value)
        .when(~F.col("balanced") | F.col("items").isNull(), True)
        .when(is_array, broken_array)
        .otherwise(broken_object)
    )
    return bodies.select(
        "src_file",
        "elem_no",
        "body",
        "items",
        "long",
        F.greatest(n_items, F.lit(0)).alias("n_items"),
        F.greatest(F.coalesce(F.size(filled), F.lit(0)), F.lit(0)).alias("n_keys"),
        malformed.alias("malformed"),
        scalar.alias("scalar"),
        is_array.alias("is_array"),
    )


def scan_json_lines(spark: SparkSession, paths: Paths, *, numbered: bool = False) -> JsonScan:
    """JSON Lines: one document per line, only on request. Blank lines are skipped.

    Records have numbers only on request; rejects always do.
    """
    configure(spark)
    lines = (
        text_pieces(spark, paths, "\n")
        # Checked before trimming, which would replace a bad byte.
        .withColumn("valid", F.is_valid_utf8("piece"))
        .withColumn("text", json_trim(F.col("piece")))
        .filter(F.col("text") != "")
        .withColumn("ord", F.monotonically_increasing_id())
    )
    text, valid = F.col("text"), F.col("valid")
    plain = valid & is_flat_object(text) & ~is_broken(text)
    has_keys = plain & ~text.rlike(rf"^\{{{WS}\}}$")
    blocks = row_blocks(lines, n_bad=~plain, n_nonempty=has_keys)
    sums = [F.sum(c).alias(a) for c, a in (("n", "n_records"), ("n_bad", "n_bad"), ("n_nonempty", "n_nonempty"))]
    counts = materialise(blocks.groupBy("src_file").agg(*sums), "line-counts")
    columns = ["src_file", "split_start", "ord", "text"]
    none_bad = counts.filter("n_bad > 0").isEmpty()
    by_number = number_rows(lines, blocks) if numbered or not none_bad else lines
    if none_bad:
        failed = file_rejects(spark.createDataFrame([], "src_file string, error string"))
        records = by_number.select(*columns, *(["rec_no"] if numbered else []))
    else:
        value = parse_strict(text)
        failed = by_number.filter(~plain).withColumn("value", F.when(valid, value)).select(
            "src_file",
            "rec_no",
            F.lit(errors.INVALID_INPUT).alias("error_kind"),
            errors.message(
                F.when(~valid, F.lit(errors.NOT_UTF8))
                .when(F.col("value").isNull(), F.lit(errors.MALFORMED_JSON))
                .when(~is_object(F.col("value")), F.lit(errors.NOT_OBJECT_OR_ARRAY))
                .otherwise(errors.nested_field(F.get(nested_keys(F.col("value")), F.lit(0))))
            ).alias("error_msg"),
        )
        records = (by_number if numbered else lines).filter(plain)
        records = records.select(*columns, *(["rec_no"] if numbered else []))
    files = list_files(spark, paths).join(counts, "src_file", "left").select(
        "src_file",
        F.lit(None).cast("string").alias("error"),
        F.lit(True).alias("is_array"),
        "n_records",
        "n_nonempty",
    )
    firsts = spark.createDataFrame([], "src_file string, first_no bigint")
    if numbered:
        firsts = records.groupBy("src_file").agg(F.min("rec_no").alias("first_no"))
    return JsonScan(records, files, failed, firsts)


def _long_error() -> list[Column]:
    return [
        F.lit(errors.INVALID_INPUT).alias("error_kind"),
        errors.message(F.lit(errors.LONG_RECORD)).alias("error_msg"),
    ]


def _record_error(is_obj: Column, nested: Column, position: Column) -> list[Column]:
    return [
        F.lit(errors.INVALID_INPUT).alias("error_kind"),
        errors.message(
            F.when(is_obj, errors.nested_field(nested)).otherwise(errors.not_an_object(position))
        ).alias("error_msg"),
    ]
